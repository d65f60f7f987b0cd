"""Labelled token data: entity pools, rendered templates, BIO tags, splits, scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import lexicon as lx
from ..functions.ranking import seeded_hash, spread_rank
from ..functions.text import has_any, let, squash, with_once
from ..session import materialise
from .entities import label_runs

WORD_OR_MARK = r"(?U)\w+|[^\w\s]"
IGNORED = -100


# ---------------------------------------------------------------- entity pools
def entity_dictionaries(nodes: DataFrame) -> DataFrame:
    """Distinct (label, value): names by the levels and properties they come from."""
    def pool(label: str, levels: Sequence[str], value: Column) -> DataFrame:
        return nodes.where(F.col("level").isin(*levels)).select(F.lit(label).alias("label"), F.trim(value).alias("value"))
    parts = [
        pool("DRUG", ("SUBS", "VTM"), F.col("name")), pool("BRAND", ("TP",), F.coalesce("trade_name", "name")),
        pool("MANUFACTURER", ("TP",), F.col("manufacturer")), pool("FORM", ("GP",), F.col("dosageform")),
        pool("STRENGTH", ("GP",), F.col("strength"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("value <> ''").distinct()


def entity_report(pools: DataFrame) -> DataFrame:
    """(label, n, min_len, max_len, avg_len, tagged, combined) per label."""
    length = F.length("value")
    return pools.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.min(length).alias("min_len"), F.max(length).alias("max_len"),
        F.round(F.avg(length), 1).alias("avg_len"), F.count_if(has_any(F.col("value"), ("(SUBS)", "(VTM)"))).alias("tagged"),
        F.count_if(F.contains("value", F.lit("+"))).alias("combined"))


def pool_overlap(pools: DataFrame, first: str = "DRUG", second: str = "BRAND") -> DataFrame:
    """Values both pools hold."""
    def of(label: str) -> DataFrame:
        return pools.where(F.col("label") == label).select("value")
    return of(first).intersect(of(second))


def filter_entities(pools: DataFrame) -> DataFrame:
    """Values within their label's length bounds and with few enough plus signs; blanks normalised, distinct."""
    value, ok = F.col("value"), F.lit(False)
    plus = F.length("value") - F.length(F.replace("value", F.lit("+"), F.lit("")))
    for label, low, high, most in lx.ENTITY_RULES:
        rule = (F.col("label") == label) & F.length("value").between(low, high)
        ok = ok | (rule if most is None else rule & (plus <= most))
    return pools.select("label", squash("value").alias("value")).where((value != "") & ok).distinct()


# ---------------------------------------------------------------- templates
def templates(spark: SparkSession) -> DataFrame:
    """The template catalogue with the share of draws that falls to each: (lo, hi]."""
    weights = dict(lx.GROUP_WEIGHTS)
    rows, start = [], 0.0
    for group, weight in lx.GROUP_WEIGHTS:
        members = [t for t in lx.TEMPLATES if t[1] == group]
        for tid, grp, target, strategy, text in members:
            end = start + weight / len(members)
            rows.append((tid, grp, target, strategy, lx.TEMPLATE_PROFILE, text, start, end))
            start = end
    assert set(weights) == {r[1] for r in rows}
    return spark.createDataFrame(
        rows, "template_id string, group string, target_type string, strategy string, profile string, template string, lo double, hi double")


def uniform(seed: str, key: str) -> Column:
    """A reproducible number in [0, 1) from md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0


def sample_templates(keys: DataFrame, key: str = "record_id", seed: int | str = 42) -> DataFrame:
    """One template per key, drawn by group weight and evenly within a group.

    The bounds of all templates fit one expression, so this is a projection.
    """
    spark = keys.sparkSession
    catalogue = templates(spark)
    lows = [r["lo"] for r in catalogue.select("lo").orderBy("lo").collect()]  # one fixed row per template
    at = let(uniform(f"{seed}|template", key), lambda u: F.size(F.filter(F.array(*[F.lit(b) for b in lows]), lambda b: b <= u)))
    order = Window.partitionBy(F.lit(1)).orderBy("lo")
    numbered = catalogue.withColumn("_t", F.row_number().over(order)).drop("lo", "hi")
    return keys.withColumn("_t", F.coalesce(at, F.lit(0))).join(numbered, "_t").drop("_t")


def index_pools(pools: DataFrame) -> DataFrame:
    """Pools with a position per label: (label, value, pos from 0, group_size)."""
    ranked = spread_rank(pools.withColumn("_h", F.md5(F.concat_ws("|", "label", "value"))), ["label"], "value", "_h", "_p")
    return ranked.select("label", "value", (F.col("_p") - 1).alias("pos"), F.col("group_size").alias("pool_size"))


def render(drawn: DataFrame, pools: DataFrame, key: str = "record_id", seed: int | str = 42) -> tuple[DataFrame, DataFrame]:
    """(records, dropped): each template with its slots filled from the pools, and the records that could not be, with their reason.

    Records have (key, template columns, text, spans). A slot picks the value at a
    hashed position of its pool, an equi-join on (label, position). ``spans`` are
    (start, end, label) in characters. A template without slots, a slot without a
    pool, and a blank value are reasons: ``no_slots``, ``slot_pool_empty``, ``missing_slot_value``.
    """
    pools = materialise(index_pools(pools), "pools")
    sizes = pools.groupBy("label").agg(F.max("pool_size").alias("pool_size"))
    named = F.array_distinct(F.regexp_extract_all(F.col("template"), F.lit(r"\{(\w+)\}"), F.lit(1)))
    slots = drawn.select(key, F.explode(named).alias("label")).join(sizes, "label", "left")
    draw = F.floor(uniform(str(seed), "_k") * F.col("pool_size")).cast("bigint")
    picked = (
        slots.withColumn("_k", F.concat_ws("|", F.col(key).cast("string"), "label")).withColumn("pos", draw)
        .join(pools.select("label", "pos", "value"), ["label", "pos"], "left")
        .groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("label", "value"))).alias("fill"),  # at most 5 slots
                          F.bool_or(F.col("pool_size").isNull()).alias("_empty"), F.bool_or(F.coalesce("value", F.lit("")) == "").alias("_blank")))
    pieces = F.filter(F.split(F.regexp_replace("template", r"(\{\w+\})", "\u0001$1\u0001"), "\u0001"), lambda p: p != "")
    rows = drawn.join(picked, key, "left").withColumn("reason", F.when(F.size(named) == 0, "no_slots").when(
        F.col("_empty"), "slot_pool_empty").when(F.col("_blank"), "missing_slot_value"))
    filled = F.transform(pieces, lambda p: F.when(F.startswith(p, F.lit("{")), let(F.regexp_replace(p, r"[{}]", ""), lambda label: F.struct(
        F.try_element_at("fill", label).alias("t"), label.alias("l")))).otherwise(F.struct(p.alias("t"), F.lit(None).cast("string").alias("l"))))
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,label:string>>").alias("spans"))

    def spans(parts: Column) -> Column:
        return F.aggregate(parts, state, lambda a, p: let(a["at"] + F.length(p["t"]), lambda end: F.struct(end.alias("at"), F.when(
            p["l"].isNull(), a["spans"]).otherwise(F.concat(a["spans"], F.array(F.struct(a["at"].alias("start"), end.alias("end"), p["l"].alias("label"))))).alias("spans"))),
            lambda a: a["spans"])

    written = let(filled, lambda parts: F.struct(F.array_join(F.transform(parts, lambda p: p["t"]), "").alias("text"), spans(parts).alias("spans")))
    kept = with_once(rows.where("reason is null"), written).select(
        key, "template_id", "group", "target_type", "strategy", "profile", "text", "spans")
    return kept, rows.where("reason is not null").select(key, "reason")


def answerability_gate(rendered: DataFrame) -> DataFrame:
    """Add ``reason``: why the graph could not answer the text, or null."""
    low = F.lower("text")
    keywords = dict(lx.GROUP_KEYWORDS)
    owned = (F.col("strategy") == "verify") & F.contains(low, F.lit(lx.OWNED_BY))
    return rendered.withColumn(
        "reason",
        F.when(has_any(low, lx.BLACKLIST), "blacklist_keyword").when(F.size("spans") == 0, "no_entity_slot")
        .when((F.col("group") == "manufacturer.mix") & ~has_any(low, keywords["manufacturer.mix"]) & ~owned, "missing_manufacturer_keyword")
        .when((F.col("group") == "nlem.verify") & ~has_any(low, keywords["nlem.verify"]), "missing_nlem_keyword"))


# ---------------------------------------------------------------- BIO tags
def bio_align(rendered: DataFrame, key: str = "record_id") -> tuple[DataFrame, DataFrame]:
    """(records, dropped): tokens with BIO tags, and the texts that could not be aligned with their reason.

    Offsets run left to right; a token overlapping a span is B if it is the
    span's first and I otherwise. Everything happens inside the row.
    """
    words = F.regexp_extract_all(F.col("text"), F.lit(WORD_OR_MARK), F.lit(0))
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("o"))

    def placed(tokens: Column) -> Column:
        def step(a: Column, t: Column) -> Column:
            found = F.call_function("locate", t, F.col("text"), a["at"] + 1) - 1
            return let(F.struct(found.alias("start"), (found + F.length(t)).alias("end")), lambda o: F.struct(
                o["end"].alias("at"), F.concat(a["o"], F.array(o)).alias("o")))
        return F.aggregate(tokens, state, step, lambda a: a["o"])

    def overlap(o: Column, s: Column) -> Column:
        return F.greatest(o["start"], s["start"]) < F.least(o["end"], s["end"])

    def firsts(offsets: Column) -> Column:
        """The spans with the start of the first token that touches each."""
        return F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"), F.array_min(
            F.transform(F.filter(offsets, lambda o: overlap(o, s)), lambda o: o["start"])).alias("first")))

    def aligned(tokens: Column, offsets: Column, spans: Column) -> Column:
        tag = F.transform(offsets, lambda o: F.coalesce(F.try_element_at(F.transform(
            F.filter(spans, lambda s: overlap(o, s)),
            lambda s: F.concat_ws("-", F.when(s["first"] == o["start"], "B").otherwise("I"), s["label"])), F.lit(1)), F.lit("O")))
        reason = (
            F.when(F.size(tokens) == 0, "tokenization_empty").when(F.exists(offsets, lambda o: o["start"] < 0), "token_not_found")
            .when(F.exists(spans, lambda s: s["first"].isNull()), "span_token_miss")
            .when(F.exists(offsets, lambda o: F.size(F.filter(spans, lambda s: overlap(o, s))) > 1), "tag_collision"))
        return F.struct(tokens.alias("tokens"), offsets.alias("offsets"), tag.alias("ner_tags"), reason.alias("reason"))

    judged = with_once(rendered, let(words, lambda tokens: let(placed(tokens), lambda offsets: let(
        firsts(offsets), lambda spans: aligned(tokens, offsets, spans)))))
    kept = judged.where("reason is null").drop("reason")
    return kept, judged.where("reason is not null").select(key, "reason")


def valid_iob(tags: Column) -> Column:
    """True when every I- tag follows a tag of its own type."""
    before = F.concat(F.array(F.lit("O")), F.slice(tags, F.lit(1), F.greatest(F.size(tags) - 1, F.lit(0))))
    return F.forall(F.arrays_zip(tags.alias("t"), before.alias("b")), lambda x: (
        (x["t"] == "O") | F.startswith(x["t"], F.lit("B-"))
        | (F.startswith(x["t"], F.lit("I-")) & (F.regexp_replace(x["t"], "^I-", "") == F.regexp_replace(x["b"], "^[BI]-", "")))))


def validate_iob(records: DataFrame, key: str = "record_id") -> DataFrame:
    """(key, same_length, valid): whether tokens and tags pair up and the tag sequence is sound."""
    return records.select(key, (F.size("tokens") == F.size("ner_tags")).alias("same_length"), valid_iob(F.col("ner_tags")).alias("valid"))


def split_records(records: DataFrame, key: str = "record_id", seed: int | str = 42) -> DataFrame:
    """Add ``split``: seeded order cut at int(.8 n) and int(.9 n); ranked in hash buckets, never in one task."""
    ranked = spread_rank(records.withColumn("_h", seeded_hash(seed, key)).withColumn("_all", F.lit(1)), ["_all"], key, "_h", "_r")
    n = F.col("group_size")
    cut = F.when(F.col("_r") <= F.floor(n * 0.8), "train").when(F.col("_r") <= F.floor(n * 0.9), "validation").otherwise("test")
    return ranked.withColumn("split", cut).drop("_h", "_all", "_r", "group_size")


def split_manifest(split: DataFrame) -> DataFrame:
    return split.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- distributions
def distributions(records: DataFrame, dims: Sequence[str] = ("group", "target_type", "strategy", "template_id")) -> DataFrame:
    """(dimension, value, n, ratio) of the records' columns and of their tags."""
    cells = F.explode(F.concat(
        F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dims]),
        F.transform("ner_tags", lambda t: F.struct(F.lit("label").alias("dimension"), t.alias("value")))))
    counts = records.select(cells.alias("x")).groupBy("x.dimension", "x.value").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("dimension")  # one row per distinct value is left
    return counts.withColumn("ratio", F.round(F.col("n") / F.sum("n").over(whole), 6))


def distribution_check(dist: DataFrame, tolerance: float = 0.03) -> DataFrame:
    """(group, expected, actual, delta, within) of each template group's share."""
    expected = dist.sparkSession.createDataFrame(list(lx.GROUP_WEIGHTS), "value string, expected double")
    actual = dist.where("dimension = 'group'").select("value", "ratio")
    joined = expected.join(actual, "value", "left").withColumn("actual", F.coalesce("ratio", F.lit(0.0)))
    delta = F.abs(F.col("actual") - F.col("expected"))
    return joined.select(F.col("value").alias("group"), "expected", "actual", F.round(delta, 6).alias("delta"), (delta <= tolerance).alias("within"))


def discard_reasons(*dropped: DataFrame) -> DataFrame:
    """(reason, n) over the side outputs of the steps."""
    rows = None
    for df in dropped:
        part = df.where("reason is not null").select("reason")
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- encoding
def encode_tags(records: DataFrame, key: str = "record_id", labels: Sequence[str] = lx.BIO_LABELS) -> tuple[DataFrame, DataFrame]:
    """(encoded, rejected): tags as label ids, and the records that cannot be encoded with their reason."""
    known = F.array(*[F.lit(lb) for lb in labels])
    tags, words = F.col("ner_tags"), F.col("tokens")
    reason = (
        F.when(F.col(key).isNull() | words.isNull() | tags.isNull(), "missing").when((F.size(words) == 0) | (F.size(tags) == 0), "empty")
        .when(F.exists(tags, lambda t: ~F.array_contains(known, F.coalesce(t, F.lit("")))), "unknown_label")
        .when(F.size(words) != F.size(tags), "length_mismatch"))
    judged = records.withColumn("reason", reason)
    encoded = judged.where("reason is null").withColumn("tag_ids", F.transform(tags, lambda t: (F.array_position(known, t) - 1).cast("int"))).drop("reason")
    return encoded, judged.where("reason is not null").select(key, "reason")


def align_subwords(records: DataFrame) -> DataFrame:
    """Add ``labels``: the tag id on the first piece of each word, -100 on other pieces and special ones.

    ``word_ids`` gives each piece's word number from 0, null for special pieces.
    """
    w = F.col("word_ids")
    return records.withColumn("labels", F.transform(w, lambda x, i: F.when(
        x.isNull() | F.coalesce((i > 0) & (F.try_element_at("word_ids", i) == x), F.lit(False)), IGNORED).otherwise(
        F.try_element_at("tag_ids", (x + 1).cast("int")))))


# ---------------------------------------------------------------- entity scores
def spans_of(tags: DataFrame, column: str, key: str = "record_id") -> DataFrame:
    """(key, type, start, end) of the labelled runs in one tag sequence per row, by positions from 0; only span rows come out."""
    placed = F.transform(column, lambda t, i: F.struct(t.alias("label"), i.alias("start"), i.alias("end"), F.lit(1.0).alias("confidence")))
    return tags.select(key, F.explode(label_runs(placed)).alias("s")).select(
        key, F.col("s.label").alias("type"), F.col("s.start").alias("start"), F.col("s.end").alias("end"))


def entity_scores(pairs: DataFrame, key: str = "record_id") -> DataFrame:
    """(type, precision, recall, f1, support, tag_accuracy): per type and as micro, macro and weighted means.

    ``pairs`` has the arrays pred_tags and gold_tags; ignored positions have
    been left out of both.
    """
    pred = spans_of(pairs, "pred_tags", key).withColumn("pred", F.lit(1))
    gold = spans_of(pairs, "gold_tags", key).withColumn("gold", F.lit(1))
    both = pred.join(gold, [key, "type", "start", "end"], "full_outer")
    per = materialise(both.groupBy("type").agg(
        F.count_if(F.col("pred").isNotNull() & F.col("gold").isNotNull()).alias("tp"),
        F.count("pred").alias("called"), F.count("gold").alias("support")), "type_scores")

    def scored(df: DataFrame) -> DataFrame:
        p = F.when(F.col("called") > 0, F.col("tp") / F.col("called")).otherwise(0.0)
        r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
        df = df.withColumn("precision", p).withColumn("recall", r)
        return df.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall")
                                          / (F.col("precision") + F.col("recall"))).otherwise(0.0))

    types = scored(per).select("type", "precision", "recall", "f1", "support")
    micro = scored(per.agg(F.sum("tp").alias("tp"), F.sum("called").alias("called"), F.sum("support").alias("support"))
                   .withColumn("type", F.lit("micro avg"))).select(*types.columns)
    macro = types.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], F.sum("support").alias("support")).select(
        F.lit("macro avg").alias("type"), "precision", "recall", "f1", "support")
    weighted = types.agg(*[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in ("precision", "recall", "f1")],
                         F.sum("support").alias("support")).select(F.lit("weighted avg").alias("type"), "precision", "recall", "f1", "support")
    return types.unionByName(micro).unionByName(macro).unionByName(weighted)


def tag_accuracy(pairs: DataFrame) -> DataFrame:
    """One row: the share of equal tags over all positions."""
    same = F.size(F.filter(F.arrays_zip("pred_tags", "gold_tags"), lambda x: x["pred_tags"] == x["gold_tags"]))
    return pairs.agg((F.sum(same) / F.sum(F.size("gold_tags"))).alias("accuracy"))


def drop_ignored(labels: DataFrame, labels_col: str, *tag_cols: str) -> DataFrame:
    """Leave out the positions whose label is -100 from the given arrays."""
    return labels.withColumns({
        c: F.filter(c, lambda x, i: F.try_element_at(labels_col, i + 1) != IGNORED) for c in tag_cols})
