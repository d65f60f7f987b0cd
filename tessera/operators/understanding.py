"""What each question asks: strategy, filters, search terms, weights, route.

Every rule is a column over the question table; a model's entity spans and
intent scores come in as tables of their own (see ``entities`` and ``intents``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import lexicon as lx
from ..functions.matching import contains_join
from ..functions.ranking import first_per_key
from ..functions.text import (blank_to_null, clean_tail, drop_doses, first_dose, first_tail, has_any, join_doses, let,
                              matches_any, ordered_distinct, spread_doses, squash, tokens)

EMPTY = "array<string>"


def _none(cast: str = EMPTY) -> Column:
    return F.array().cast(cast)


def has_digit(col: Column) -> Column:
    return F.rlike(col, F.lit(r"(?U)\d"))


# ---------------------------------------------------------------- strategy and action
def strategy(question: Column) -> Column:
    q = squash(question)
    return (
        F.when(matches_any(q, lx.COUNT_PATTERNS), "count")
        .when(matches_any(q, lx.LEADING_VERIFY), "verify")
        .when(matches_any(q, lx.LIST_PATTERNS), "list")
        .when(matches_any(q, lx.VERIFY_PATTERNS), "verify")
        .otherwise("retrieve"))


def tag_strategy(questions: DataFrame) -> DataFrame:
    return questions.withColumn("strategy", strategy(F.col("question")))


def is_compare(question: Column) -> Column:
    return matches_any(F.lower(F.trim(question)), lx.COMPARE_PATTERNS)


def is_greeting(question: Column) -> Column:
    q = F.lower(squash(question))
    return matches_any(q, lx.GREETING_PATTERNS) & (F.size(F.split(q, " ")) <= lx.GREETING_MAX_WORDS)


def tag_action(questions: DataFrame) -> DataFrame:
    """Add ``action``; needs ``strategy`` and ``is_ambiguous``."""
    q = F.col("question")
    return questions.withColumn(
        "action",
        F.when(is_compare(q), "compare")
        .when(F.col("strategy").isin("count", "list", "verify"), F.col("strategy"))
        .when(is_greeting(q) & F.coalesce("is_ambiguous", F.lit(False)), "unknown")
        .otherwise("lookup"))


# ---------------------------------------------------------------- filters
def product_id(question: Column) -> Column:
    return F.coalesce(
        blank_to_null(F.regexp_extract(question, lx.rx(lx.PREFIXED_ID), 1)),
        blank_to_null(F.regexp_extract(question, lx.rx(lx.BARE_ID), 0)))


def nlem_category(question: Column) -> Column:
    low = F.lower(question)
    return F.coalesce(*[F.when(matches_any(low, patterns), F.lit(letter))
                        for letter, patterns in lx.NLEM_CATEGORY_PATTERNS])


def extract_filters(questions: DataFrame) -> DataFrame:
    """Add ``id_lookup``, ``nlem_filter`` and ``nlem_category``; a category implies the flag."""
    q = F.trim("question")
    flagged = matches_any(F.lower(q), lx.NLEM_PATTERNS) | F.col("nlem_category").isNotNull()
    return (
        questions.withColumn("id_lookup", product_id(q))
        .withColumn("nlem_category", nlem_category(q))
        .withColumn("nlem_filter", F.when(flagged, F.lit(True))))


# ---------------------------------------------------------------- manufacturers
def build_manufacturer_dim(raw: DataFrame) -> DataFrame:
    """(manufacturer, folded): every name that is not blank or a hospital, as written and cleaned."""
    named = raw.where((F.trim("manufacturer") != "") & ~F.contains("manufacturer", F.lit(lx.HOSPITAL)))
    cleaned = squash(F.regexp_replace(
        F.regexp_replace("manufacturer", r",\s*[A-Z.]+$", ""), r"\s*\([^)]*\)\s*", " "))
    both = named.select("manufacturer").unionByName(named.select(cleaned.alias("manufacturer")))
    return both.where("manufacturer <> ''").distinct().withColumn("folded", F.lower("manufacturer"))


def match_manufacturer(questions: DataFrame, dim: DataFrame, text: str = "question") -> DataFrame:
    """(query_id, manufacturer): alias, else the first exact token, else the longest name in the text."""
    low = F.lower(F.col(text))
    alias = F.coalesce(*[F.when(F.contains(low, F.lit(a)), F.lit(name)) for a, name in lx.MANUFACTURER_ALIASES])
    base = questions.select("query_id", low.alias("low"), alias.alias("alias"))
    words = base.where("alias is null").select(
        "query_id", F.posexplode(F.split("low", r"[\s,./()]+")).alias("pos", "folded")).where(F.length("folded") >= 2)
    by_token = first_per_key(words.join(dim, "folded"), ["query_id"], [F.col("pos"), F.col("manufacturer")]).select(
        "query_id", F.col("manufacturer").alias("by_token"))
    names = dim.where(F.length("manufacturer") > 3).select(F.col("folded").alias("term")).distinct()
    inside = contains_join(names, base.where("alias is null").select("query_id", "low"), text="low", key="query_id")
    by_name = first_per_key(
        inside.select("query_id", F.col("term").alias("folded")).join(dim, "folded"), ["query_id"],
        [F.desc(F.length("manufacturer")), F.col("manufacturer")]).select("query_id", F.col("manufacturer").alias("by_name"))
    return (
        base.join(by_token, "query_id", "left").join(by_name, "query_id", "left")
        .select("query_id", F.coalesce("alias", "by_token", "by_name").alias("manufacturer")))


# ---------------------------------------------------------------- search term
def is_query_like(text: Column) -> Column:
    return F.rlike(F.lower(squash(text)), F.lit("^$|" + "|".join(rf"\Q{p}\E" for p in lx.QUERY_LIKE_PARTS)))


def _usable(text: Column) -> Column:
    return let(text, lambda t: F.when(~is_query_like(t), t))


def _latin_term(kept: Column) -> Column:
    """The first Latin word kept, with the amount and unit behind it."""
    def phrase(at: Column) -> Column:
        word, amount, unit = (F.try_element_at(kept, at + i) for i in (1, 2, 3))
        amount_ok = F.coalesce(F.rlike(amount, F.lit(r"(?U)^\d+(?:\.\d+)?$")), F.lit(False))
        unit_ok = amount_ok & F.coalesce(F.rlike(unit, F.lit(lx.rx(rf"^(?:{lx.DOSE_UNIT_ALT})$"))), F.lit(False))
        latin = F.when(unit_ok, F.concat_ws(" ", word, amount, unit)).when(amount_ok, F.concat_ws(" ", word, amount)).otherwise(word)
        return F.when(at.isNotNull(), latin)

    return let(F.array_min(F.filter(F.transform(
        kept, lambda t, i: F.when(F.rlike(t, F.lit(r"^[A-Za-z][A-Za-z0-9\-]{2,}$")), i)), lambda i: i.isNotNull())), phrase)


def build_search_term(questions: DataFrame) -> DataFrame:
    """Add ``query``; needs question, id_lookup, manufacturer_filter and the slot arrays brands, drugs.

    Candidates are tried in turn: each is worked out once, and only where none before it is usable.
    """
    slots = F.filter(F.transform(F.concat("brands", "drugs"), clean_tail), lambda c: ~is_query_like(c))
    stop = F.array(*[F.lit(w) for w in lx.EN_STOPWORDS + lx.THAI_QUERY_NOISE])

    def from_text(text: Column) -> Column:
        tails = [first_tail(text, group) for group in (lx.LOOKUP_PREFIX, lx.SUBSTANCE_TAIL, lx.MANUFACTURER_TAIL)]
        after = clean_tail(F.regexp_extract(text, lx.rx(lx.DRUG_AFTER_WORD), 1))
        dosed = clean_tail(F.concat_ws(" ", *[F.regexp_extract(text, lx.rx(lx.DRUG_WITH_DOSE), i) for i in (1, 2, 3)]))
        kept = let(tokens(F.lower(F.coalesce("manufacturer_filter", F.lit("")))), lambda makers: F.filter(tokens(text), lambda t: (
            ~F.array_contains(stop, F.lower(t)) & ~F.array_contains(makers, F.lower(t)) & ((F.length(t) >= 3) | has_digit(t)))))
        words = let(kept, lambda k: F.coalesce(_latin_term(k), F.when(F.size(k) > 0, F.concat_ws(" ", F.slice(k, 1, 8)))))
        return F.coalesce(*[_usable(c) for c in (*tails, after, dosed)], words, text)

    return questions.withColumn("query", F.coalesce("id_lookup", F.try_element_at(slots, F.lit(1)), let(squash("question"), from_text)))


# ---------------------------------------------------------------- entity profile and weights
def entity_profile(questions: DataFrame) -> DataFrame:
    """Add token_count, entity_token_count, entity_ratio, is_abstract.

    Needs question, manufacturer_filter, nlem_filter, nlem_category and
    ``entity_texts`` (array of the accepted entity and slot texts).
    """
    low = F.lower("question")
    words = tokens(low)
    stop = F.array(*[F.lit(w) for w in lx.EN_STOPWORDS])
    hints = F.array(*[F.lit(w) for w in lx.DOMAIN_HINTS])

    def telling(t: Column) -> Column:
        latin = F.rlike(t, F.lit("[A-Za-z]"))
        return (F.rlike(t, F.lit("(?iU)" + lx.UNIT_TOKEN)) | has_digit(t) | F.array_contains(hints, t)
                | (latin & (F.length(t) >= 3) & ~F.array_contains(stop, t)))

    doses = tokens(F.concat_ws(" ", F.regexp_extract_all(low, F.lit(lx.rx(lx.DOSE_PHRASE)), F.lit(0))))
    prefixed = F.regexp_extract("question", lx.rx(lx.PREFIXED_ID), 1)
    bare = F.regexp_extract_all(F.col("question"), F.lit(lx.rx(lx.BARE_ID)), F.lit(0))
    named = F.filter(tokens(F.lower(F.concat_ws(" ", F.coalesce("entity_texts", _none())))),
                     lambda t: (F.length(t) >= 2) | has_digit(t))
    found = F.concat(
        F.filter(words, telling), doses, F.filter(F.array(prefixed), lambda p: p != ""), bare,
        tokens(F.lower(F.coalesce("manufacturer_filter", F.lit("")))),
        F.when(F.col("nlem_filter"), F.array(F.lit("nlem"))).otherwise(_none()),
        F.when(F.col("nlem_category").isNotNull(), F.array(F.lower("nlem_category"))).otherwise(_none()), named)
    plain = ~F.rlike(low, F.lit("[A-Za-z0-9]"))
    out = (
        questions.withColumn("token_count", F.size(words))
        .withColumn("entity_token_count", F.least(F.size(F.array_distinct(found)), F.col("token_count"))))
    return (
        out.withColumn("entity_ratio", F.coalesce(
            F.col("entity_token_count") / F.nullif(F.col("token_count"), F.lit(0)), F.lit(0.0)))
        .withColumn("is_abstract", (F.col("token_count") > 0) & (
            ((F.col("token_count") >= 10) & plain) | has_any(low, lx.ABSTRACT_HINTS))))


def retrieval_profile(questions: DataFrame) -> DataFrame:
    """Add retrieval_mode, vector_weight, fulltext_weight; needs strategy, id_lookup and the entity profile."""
    ratio = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("entity_ratio")))
    abstract, kind = F.col("is_abstract"), F.col("strategy")

    def plan(mode: str, v: float, t: float) -> Column:
        return F.struct(F.lit(mode).alias("m"), F.lit(v).alias("v"), F.lit(t).alias("t"))

    chosen = (
        F.when(F.col("id_lookup").isNotNull(), plan("fulltext_heavy", 0.15, 0.85))
        .when(kind.isin("count", "list") & (ratio >= 0.60), plan("fulltext_heavy", 0.35, 0.65))
        .when(kind.isin("count", "list"), plan("balanced", 0.50, 0.50))
        .when((kind == "verify") & (ratio >= 0.60) & ~abstract, plan("fulltext_heavy", 0.40, 0.60))
        .when((kind == "verify") & (ratio >= 0.35) & (ratio < 0.60), plan("balanced", 0.50, 0.50))
        .when(kind == "verify", plan("vector_heavy", 0.60, 0.40))
        .when(abstract | (ratio < 0.30), plan("vector_heavy", 0.70, 0.30))
        .when(ratio < 0.60, plan("balanced", 0.55, 0.45))
        .otherwise(plan("fulltext_heavy", 0.40, 0.60)))
    return questions.withColumn("_p", chosen).select(
        *questions.columns, F.col("_p.m").alias("retrieval_mode"), F.col("_p.v").alias("vector_weight"),
        F.col("_p.t").alias("fulltext_weight"))


# ---------------------------------------------------------------- the structured question
def assemble_intent(questions: DataFrame, dim: DataFrame, slots: DataFrame | None = None,
                    intents: DataFrame | None = None) -> DataFrame:
    """One structured row per question: target, action, topics, slots, filters, weights.

    ``slots`` is what ``entities.slot_trust`` keeps; ``intents`` is what
    ``intents.classify_centroid`` returns. Either may be missing.
    """
    base = extract_filters(tag_strategy(questions.select("query_id", F.trim("question").alias("question"))))
    makers = match_manufacturer(base, dim).withColumnRenamed("manufacturer", "rule_maker")
    base = base.join(makers, "query_id", "left")
    singles = ("brand", "drug", "manufacturer", "strength", "form")
    lists = ("multi_brand", "multi_drug", "multi_manufacturer", "entity_texts")
    if slots is not None:
        base = base.join(slots.select("query_id", *singles, *lists), "query_id", "left")
    for c in singles:
        base = base.withColumn(c, (F.col(c) if slots is not None else F.lit(None)).cast("string"))
    for c in lists:
        base = base.withColumn(c, F.coalesce(F.col(c), _none()) if slots is not None else _none())
    if intents is not None:
        base = base.join(intents.select("query_id", "target", "target_margin", "is_ambiguous", "confidence", "top_targets"),
                         "query_id", "left")
    else:
        base = (base.withColumn("target", F.lit("general")).withColumn("target_margin", F.lit(0.0))
                .withColumn("is_ambiguous", F.lit(True)).withColumn("confidence", F.lit(0.0))
                .withColumn("top_targets", F.array().cast("array<struct<target:string,score:double>>")))

    def listed(name: str) -> Column:
        one = F.filter(F.array(F.col(name)), lambda v: v.isNotNull() & (v != ""))
        return F.when(F.size(f"multi_{name}") > 0, F.col(f"multi_{name}")).otherwise(one)

    base = (
        base.withColumn("manufacturer_filter", F.coalesce("rule_maker", "manufacturer"))
        .withColumn("brands", listed("brand")).withColumn("drugs", listed("drug")).withColumn("makers", listed("manufacturer")))
    base = base.withColumn("entity_texts", F.concat("entity_texts", F.filter(
        F.array(*singles), lambda v: v.isNotNull())))
    base = build_search_term(base)
    shaped = F.coalesce("strength", "form").isNotNull()
    target = (F.when(F.col("nlem_filter"), "nlem").when(F.col("manufacturer_filter").isNotNull(), "manufacturer")
              .when((F.coalesce("target", F.lit("general")) == "general") & shaped, "formula")
              .otherwise(F.coalesce("target", F.lit("general"))))
    base = base.withColumn("target_type", target).withColumn(
        "query", F.when((F.col("query") == "") & F.col("strategy").isin("count", "list"), lx.DEFAULT_LIST_TERM)
        .otherwise(F.col("query")))
    base = tag_action(retrieval_profile(entity_profile(base)))

    def slot(name: str, value: Column, confidence: float, source: str) -> Column:
        return F.struct(F.lit(name).alias("name"), squash(value).alias("value"),
                        F.lit(confidence).alias("confidence"), F.lit(source).alias("source"))

    def spans(name: str, values: str) -> Column:
        return F.transform(values, lambda v, i: F.struct(
            F.lit(name).alias("name"), squash(v).alias("value"),
            F.when(i == 0, 0.85).otherwise(F.when(F.size(f"multi_{name}") > 0, 0.82).otherwise(0.85)).alias("confidence"),
            F.lit("ner").alias("source")))

    rules = F.array(
        slot("tmtid", F.col("id_lookup"), 1.0, "rule"), slot("manufacturer", F.col("manufacturer_filter"), 0.95, "rule"),
        slot("nlem", F.col("nlem_filter").cast("string"), 0.95, "rule"),
        slot("nlem_category", F.col("nlem_category"), 0.95, "rule"))
    named = F.concat(spans("brand", "brands"), spans("drug", "drugs"), spans("manufacturer", "makers"),
                     F.array(slot("strength", F.col("strength"), 0.85, "ner"), slot("form", F.col("form"), 0.85, "ner")))

    def key(s: Column) -> Column:
        return F.concat_ws("\u0001", s["name"], F.lower(s["value"]))

    def distinct_slots(slots_: Column) -> Column:
        return let(slots_, lambda all_: let(F.transform(all_, key), lambda keys: F.filter(
            all_, lambda s, i: (s["value"] != "") & (F.array_position(keys, F.get(keys, i)) == i + 1))))

    out = base.withColumn("_named", F.concat(rules, named)).withColumn("_slots", distinct_slots(F.col("_named")))
    from_model = F.exists("_slots", lambda s: s["source"] == "ner")
    topics = F.array_distinct(F.array_compact(F.array(
        F.col("target_type"), F.when(F.col("id_lookup").isNotNull(), "id_lookup"),
        F.when(F.col("manufacturer_filter").isNotNull(), "manufacturer"),
        F.when(F.col("nlem_filter").isNotNull(), "nlem"), F.when(shaped, "formula"))))
    slots_out = F.when(from_model, F.col("_slots")).otherwise(distinct_slots(F.concat(
        "_slots", F.array(slot("query", F.col("query"), 0.70, "rule")))))
    dose = F.rlike("question", F.lit(lx.rx(lx.DOSE_PHRASE)))
    return out.select(
        "query_id", "question", "query", "target_type", "strategy", "action", topics.alias("topics"),
        slots_out.alias("slots"), "brands", "drugs", "makers", "strength", "form", "nlem_filter", "nlem_category",
        "manufacturer_filter", "id_lookup", "token_count", "entity_token_count", "entity_ratio", "is_abstract",
        dose.alias("has_dose_unit"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.coalesce("target_margin", F.lit(0.0)))).alias("ambiguity"),
        "retrieval_mode", "vector_weight", "fulltext_weight", "is_ambiguous", "confidence", "top_targets",
        F.when(from_model, "ner_primary").otherwise("fallback_rule").alias("query_slot_mode"),
        F.when(F.col("id_lookup").isNotNull(), F.array("id_lookup")).otherwise(_none()).alias("must_match"))


def slot_values(name: str) -> Column:
    """Distinct values of one slot of the structured row, in order."""
    values = F.transform(F.filter("slots", lambda s: s["name"] == name), lambda s: s["value"])
    return ordered_distinct(values)


# ---------------------------------------------------------------- text search terms, variants
def fulltext_terms(rows: DataFrame, text: str = "question") -> DataFrame:
    """Add ``terms``, the up to four most telling terms of ``text``; rows without any are dropped."""
    q = F.col(text)
    noise = F.array(*[F.lit(w) for w in lx.TERM_NOISE])
    thai_stop = F.array(*[F.lit(w) for w in lx.THAI_STOPWORDS])
    doses = F.regexp_extract_all(q, F.lit("(?iU)" + lx.DOSE_TERM), F.lit(0))
    latin = F.filter(F.regexp_extract_all(q, F.lit(lx.LATIN_TERM), F.lit(0)), lambda t: F.length(t) >= 2)
    numbers = F.filter(F.regexp_extract_all(q, F.lit("(?U)" + lx.NUMBER_TERM), F.lit(0)),
                       lambda n: ~F.exists("_doses", lambda d: F.contains(d, n)))
    thai = F.filter(F.regexp_extract_all(q, F.lit(lx.THAI_TERM), F.lit(0)),
                    lambda t: (F.length(t) > 1) & ~F.array_contains(thai_stop, t))

    def telling(values: Column) -> Column:
        return ordered_distinct(F.filter(F.transform(values, lambda t: F.trim(t)), lambda t: ~F.array_contains(noise, F.lower(t))))

    loose = F.regexp_extract_all(q, F.lit("(?U)" + lx.LOOSE_TERM), F.lit(0))
    found = rows.withColumn("_doses", doses).withColumn("_terms", telling(F.concat(F.col("_doses"), latin, numbers, thai)))
    found = found.withColumn("_terms", F.when(F.size("_terms") > 0, F.col("_terms")).otherwise(telling(loose)))

    def score(t: Column) -> Column:
        return (F.when(has_digit(t), 3).otherwise(0) + F.when(F.rlike(t, F.lit("[A-Za-z]")), 2).otherwise(0)
                + F.when(F.rlike(t, F.lit("[฀-๿]")), 2).otherwise(0) + F.least(F.lit(4), F.floor(F.length(t) / 4)))

    ranked = F.array_sort(F.transform("_terms", lambda t, i: F.struct(
        (-score(t)).alias("s"), i.alias("i"), t.alias("t"))))
    best = F.transform(F.slice(ranked, 1, lx.TERM_LIMIT), lambda r: r["t"])
    return found.withColumn("terms", best).where(F.size("terms") > 0).drop("_doses", "_terms")


def query_variants(rows: DataFrame, text: str = "question") -> DataFrame:
    """(query_id, variant_no, text): as asked, with doses joined, with doses spread; distinct, in order."""
    raw = squash(text)
    joined = join_doses(F.col(text))
    variants = ordered_distinct(F.array(raw, joined, squash(spread_doses(joined))))
    return rows.select("query_id", F.posexplode(variants).alias("variant_no", "text"))


# ---------------------------------------------------------------- routing
def route_operator(structured: DataFrame) -> DataFrame:
    """Add ``operator``; an id beats every action."""
    return structured.withColumn(
        "operator",
        F.when(F.col("id_lookup").isNotNull(), "id_lookup").when(F.col("action") == "verify", "verify")
        .when(F.col("action") == "count", "analyze_count").when(F.col("action") == "compare", "analyze_compare")
        .when(F.col("action") == "list", "list").otherwise("lookup"))


def compare_terms(structured: DataFrame) -> DataFrame:
    """(query_id, term_no, term): the one or two things compared."""
    def extend(have: Column, more: Column) -> Column:
        return F.when(F.size(have) >= 2, have).otherwise(F.concat(have, F.filter(more, lambda m: ~F.array_contains(have, m))))

    normal = join_doses(F.col("query"))
    parts = ordered_distinct(F.filter(F.transform(F.split(normal, lx.rx(lx.COMPARE_SPLIT)), join_doses),
                                      lambda p: F.length(p) >= 2))
    rows = (
        structured.withColumn("_d", slot_values("drug")).withColumn("_b", slot_values("brand")).withColumn("_p", parts))
    rows = rows.withColumn("_t", extend(F.col("_d"), F.col("_b")))
    rows = rows.withColumn("_t", extend(F.col("_t"), F.col("_p")))
    fallback = F.array(F.coalesce(blank_to_null(F.col("query")), F.lit(lx.DEFAULT_SEARCH_TERM)))
    terms = F.slice(F.when(F.size("_t") > 0, F.col("_t")).otherwise(fallback), 1, 2)
    return rows.select("query_id", F.posexplode(terms).alias("term_no", "term"))


def is_manufacturer_request(question: Column) -> Column:
    return has_any(F.lower(squash(question)), lx.MANUFACTURER_REQUEST)


def is_trade_name_request(question: Column) -> Column:
    return has_any(F.lower(squash(question)), lx.TRADE_NAME_REQUEST)


def anchor_hints(structured: DataFrame) -> DataFrame:
    """Add substance, maker, dose hints and the request flags used by the anchored lookup."""
    q = F.col("question")
    rows = structured.withColumns({
        "_named": join_doses(F.try_element_at(F.concat(slot_values("drug"), slot_values("brand")), F.lit(1))),
        "_makers": slot_values("manufacturer"), "_doses": slot_values("strength"),
        "_tail": F.coalesce(join_doses(first_tail(q, lx.LOOKUP_SUBSTANCE_TAIL)), F.lit("")),
        "_maker_tail": F.coalesce(join_doses(first_tail(q, lx.MANUFACTURER_TAIL)), F.lit("")),
        "_query": join_doses(F.col("query")), "wants_trade_name": is_trade_name_request(q), "wants_maker": is_manufacturer_request(q)})
    rows = rows.withColumn("_sub", F.coalesce(blank_to_null(F.col("_named")), blank_to_null(F.col("_tail")), F.col("_query")))
    anchored = (F.coalesce(F.col("_named") != "", F.lit(False)) | F.col("manufacturer_filter").isNotNull()
                | (F.col("_tail") != "") | (F.col("_maker_tail") != ""))
    return (
        rows.withColumn("_bare", drop_doses(F.regexp_replace("_sub", lx.rx(lx.REQUEST_PREFIX), "")))
        .withColumn("hint_substance", join_doses(F.col("_bare")))
        .withColumn("hint_maker", F.coalesce(
            blank_to_null(join_doses(F.col("manufacturer_filter"))), blank_to_null(join_doses(F.try_element_at("_makers", F.lit(1)))), F.col("_maker_tail")))
        .withColumn("hint_dose", F.coalesce(blank_to_null(join_doses(F.try_element_at("_doses", F.lit(1)))), first_dose(q)))
        .withColumn("has_anchor", anchored & (F.col("wants_trade_name") | F.col("wants_maker")))
        .drop("_named", "_makers", "_doses", "_tail", "_maker_tail", "_query", "_sub", "_bare"))
