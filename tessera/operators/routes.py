"""The deterministic and hybrid routes a question can take, and the router over them.

List cascades ("try this, else that") run as one pass: every stage yields its
own short ranked list with a stage number, and each question keeps its lowest
stage. Searches are dearer: ``staged_search`` runs each stage only on the
questions that the one before it left without a result, and tells what it tried.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import lexicon as lx
from ..functions.matching import contains_join
from ..functions.members import likely_members
from ..functions.ranking import top_k, top_k_by_text
from ..functions.text import blank_to_null, drop_doses, first_dose, first_tail, folded, haystack, join_doses
from ..schema import LEVELS, NO_RANK
from ..session import fits, materialise
from ..sources.catalogue import Catalogue
from .counts import count_route, substance_generics
from .filters import final_cap, keep_strength, search_profile
from .retrieval import (Expansion, Vectors, channel_weights, expand_context, merge_first, overlap_score, rerank, route_plans,
                        search_general)
from .understanding import (anchor_hints, compare_terms, is_manufacturer_request, is_trade_name_request, route_operator,
                            slot_values)

@dataclass(frozen=True)
class Limits:
    """How much the routes search and keep; None is no limit. The defaults are those of the data model's original routes."""

    anchors_least: int = 10  # anchored matches of a lookup are at least so many
    attempt_least: int = 8  # a verify attempt or a compared term is searched to at least ...
    attempt_most: int | None = 20  # ... and at most so many
    maker_list_most: int | None = 80  # hybrid results of a list by manufacturer
    plain_list_most: int | None = 60  # hybrid results of any other list
    fallback_least: int = 25  # anchored matches that join a weak lookup: twice what is asked for, at least ...
    fallback_most: int | None = 50  # ... and at most so many
    id_matches: int = 10  # nodes of one id
    list_length: int = 50  # rows of a list in a batch
    rerank_length: int = 50  # lookup results that are ordered again

    def attempt(self, k: int) -> int:
        return max(self.attempt_least, at_most(k, self.attempt_most))

    def fallback(self, k: int) -> int:
        return at_most(max(2 * k, self.fallback_least), self.fallback_most)


def at_most(k: int, limit: int | None) -> int:
    return k if limit is None else min(k, limit)


LIMITS = Limits()

TP_TEXT = ("trade_name", "generic_name", "fsn", "active_substance", "active_substances")
GP_TEXT = ("name", "fsn", "active_substance", "active_substances")
SHOWN = ("node_id", "name", "fsn", "trade_name", "manufacturer")
TRUSTED_LIST_MODES = ("substance_manufacturer_tp_unique", "substance_trade_name_tp", "substance_gp_only",
                      "manufacturer_tp_only")


def shown(*columns: str) -> Column:
    return F.coalesce(*columns)


def lowest_stage(stages: DataFrame) -> DataFrame:
    """Keep, per question, the rows of its lowest ``stage``."""
    best = stages.groupBy("query_id").agg(F.min("stage").alias("stage"))
    return stages.join(best, ["query_id", "stage"])


# ---------------------------------------------------------------- text and tree matches
def text_matches(asked: DataFrame, nodes: DataFrame, level: str, columns: Sequence[str]) -> DataFrame:
    """Asked rows (query_id, substance, strength, ...) beside the level's nodes that contain the substance."""
    texts = nodes.where(F.col("level") == level).select(*SHOWN, haystack(columns).alias("hay"))
    terms = asked.select(F.lower("substance").alias("term")).where("term <> ''").distinct()
    return contains_join(terms, texts).drop("hay").join(
        asked.withColumn("term", F.lower("substance")), "term").where(
        keep_strength(F.col("strength"), F.col("fsn"))).drop("term")


def tree_products(asked: DataFrame, cat: Catalogue) -> DataFrame:
    """Asked rows beside the trade products below the substance of that exact name."""
    gp = substance_generics(asked.withColumn("substance", F.lower("substance")), cat.nodes, cat.edges).select(
        "query_id", "gp").distinct()
    step = cat.edges.where("type = 'HAS_TRADE_PRODUCT'").select(F.col("src_id").alias("gp"), F.col("dst_id").alias("node_id"))
    tp = gp.join(step, "gp").select("query_id", "node_id").distinct()
    return tp.join(cat.nodes.where("level = 'TP'").select(*SHOWN), "node_id").join(asked, "query_id").where(
        keep_strength(F.col("strength"), F.col("fsn")))


# ---------------------------------------------------------------- list routes
def _one_per_maker(matches: DataFrame, k: int) -> DataFrame:
    made = matches.where("manufacturer is not null and manufacturer <> ''")
    first = made.groupBy("query_id", F.lower("manufacturer").alias("mkey")).agg(
        F.min(F.struct("node_id", "manufacturer")).alias("n"))
    return top_k(first.select("query_id", "n.node_id", "n.manufacturer"), ["query_id"],
                 [F.col("manufacturer"), F.col("node_id")], k).select("query_id", "node_id", "rank")


def _named(matches: DataFrame, k: int, *columns: str) -> DataFrame:
    return top_k_by_text(matches.select("query_id", "node_id", shown(*columns).alias("shown")), "query_id",
                         ["shown", "node_id"], k).select("query_id", "node_id", "rank")


def _staged(*lists: DataFrame) -> DataFrame:
    out = None
    for i, df in enumerate(lists):
        df = df.withColumn("stage", F.lit(i))
        out = df if out is None else out.unionByName(df)
    return lowest_stage(out)


def once_per(asked: DataFrame, keys: Sequence[str], find: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``find`` lists for each distinct ``keys``, beside every question that asks for them.

    However many questions share a term, its matches are found and cut to length once; the questions meet only what is left.
    """
    keyed = asked.withColumn("asked_key", F.md5(F.to_json(F.struct(*keys))))
    found = find(keyed.select(F.col("asked_key").alias("query_id"), *keys).distinct())
    return keyed.select("query_id", "asked_key").join(found.withColumnRenamed("query_id", "asked_key"), "asked_key").drop("asked_key")


def list_manufacturers(asked: DataFrame, cat: Catalogue, k: int) -> DataFrame:
    """One trade product per manufacturer of a substance: by text, else through the tree."""
    return once_per(asked, ("substance", "strength"), lambda a: _staged(
        _one_per_maker(text_matches(a, cat.nodes, "TP", TP_TEXT), k), _one_per_maker(tree_products(a, cat), k)))


def list_trade_names(asked: DataFrame, cat: Catalogue, k: int) -> DataFrame:
    """Trade products of a substance by name: by text, else through the tree."""
    return once_per(asked, ("substance", "strength"), lambda a: _staged(
        _named(text_matches(a, cat.nodes, "TP", TP_TEXT), k, "trade_name", "fsn", "name"),
        _named(tree_products(a, cat), k, "trade_name", "fsn", "name")))


def list_substance_gp(asked: DataFrame, cat: Catalogue, k: int) -> DataFrame:
    """Generic products of a substance: through the tree, else by text."""
    def find(a: DataFrame) -> DataFrame:
        tree = substance_generics(a.withColumn("substance", F.lower("substance")), cat.nodes, cat.edges).select(
            "query_id", F.col("gp").alias("node_id")).distinct().join(cat.nodes.where("level = 'GP'").select(*SHOWN), "node_id")
        plain = a.select("query_id", "substance", F.lit("").alias("strength"))
        return _staged(_named(tree, k, "fsn", "name", "trade_name"),
                       _named(text_matches(plain, cat.nodes, "GP", GP_TEXT), k, "fsn", "name", "trade_name"))

    return once_per(asked, ("substance",), find)


def _products_of(terms: DataFrame, tp: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The names (maker, term) that contain a term, and the first ``k`` trade products (maker, node_id, shown) of each.

    A list of ``k`` needs no more than that of any one name, so no more is shuffled to be joined; a name contains itself.
    """
    names = materialise(contains_join(terms.select("term").distinct(), tp.select("maker").distinct(), text="maker", key="maker").select("maker", "term"), "makers")
    products = likely_members(tp.select("maker", "node_id", shown("trade_name", "fsn", "name").alias("shown")), "maker", names)
    return names, materialise(top_k_by_text(products, "maker", ["shown", "node_id"], k).drop("rank"), "maker_products")


def _near(names: DataFrame, products: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """Trimmed per term before the questions are attached."""
    return top_k_by_text(products.join(names, "maker").select("term", "node_id", "shown"), "term", ["shown", "node_id"], k).join(terms, "term")


def list_by_manufacturer(asked: DataFrame, cat: Catalogue, k: int) -> DataFrame:
    """Trade products of a manufacturer: the exact name, else names that contain it."""
    tp = cat.nodes.where("level = 'TP' and manufacturer is not null").withColumn("maker", folded("manufacturer"))

    def find(a: DataFrame) -> DataFrame:
        terms = a.select("query_id", F.lower("manufacturer").alias("term")).where("term <> ''")
        names, products = _products_of(terms, tp, k)
        exact = top_k_by_text(products.join(terms.withColumnRenamed("term", "maker"), "maker").select("query_id", "node_id", "shown"),
                              "query_id", ["shown", "node_id"], k)
        near = _near(names, products, terms, k)
        return _staged(exact.select("query_id", "node_id", "rank"), near.select("query_id", "node_id", "rank"))

    return once_per(asked, ("manufacturer",), find)


LIST_HINTS = ("list_substance", "list_strength", "list_maker", "wants_trade", "wants_makers")


def list_hints(structured: DataFrame) -> DataFrame:
    """Add what a list question names: substance, strength, manufacturer, and what it wants back."""
    if set(LIST_HINTS) <= set(structured.columns):
        return structured
    q = F.col("question")
    rows = structured.withColumns({
        "_drugs": slot_values("drug"), "_doses": slot_values("strength"),
        "_tail": F.coalesce(join_doses(first_tail(q, lx.SUBSTANCE_TAIL)), F.lit("")),
        "list_maker": F.coalesce(blank_to_null(join_doses(F.col("manufacturer_filter"))), join_doses(first_tail(q, lx.MANUFACTURER_TAIL)), F.lit("")),
        "wants_trade": (F.col("target_type") == "formula") | is_trade_name_request(q)})
    rows = rows.withColumn("_sub", F.when(F.size("_drugs") > 0, join_doses(F.try_element_at("_drugs", F.lit(1)))).otherwise(F.col("_tail")))
    rows = rows.withColumns({
        "list_strength": F.coalesce(blank_to_null(join_doses(F.try_element_at("_doses", F.lit(1)))), blank_to_null(first_dose(q)), first_dose(F.col("_sub"))),
        "wants_makers": is_manufacturer_request(q) & (F.col("list_maker") == ""), "_bare": drop_doses(F.col("_sub"))})
    rows = rows.withColumn("_bare", F.coalesce(blank_to_null(F.col("_bare")), F.col("_sub")))
    return rows.withColumn("list_substance", F.when(
        (F.col("_bare") == "") & (F.col("wants_trade") | F.col("wants_makers")), join_doses(F.col("query"))).otherwise(F.col("_bare"))
    ).drop("_drugs", "_doses", "_tail", "_sub", "_bare")


def prepare(structured: DataFrame) -> DataFrame:
    """Route every question and work out, once and stored, all that its route may ask for."""
    rows = search_profile(anchor_hints(list_hints(route_operator(structured))))
    return materialise(rows.withColumn("own_terms", own_terms()), "routed")


def prepared(rows: DataFrame) -> DataFrame:
    return rows if "own_terms" in rows.columns else prepare(rows)


def own_terms() -> Column:
    """The question's own words to start a graph walk from."""
    return F.concat(slot_values("drug"), slot_values("brand"), slot_values("manufacturer"), slot_values("query"), F.col("must_match"))


def list_deterministic(structured: DataFrame, cat: Catalogue, k: int) -> DataFrame:
    """(query_id, node_id, rank, mode) from the first list route that finds anything."""
    k = max(1, k)
    asked = list_hints(structured).select(
        "query_id", F.col("list_substance").alias("substance"), F.col("list_strength").alias("strength"),
        F.col("list_maker").alias("manufacturer"), "wants_trade", "wants_makers")
    named = asked.select("query_id", "substance", "strength", "wants_trade", "wants_makers").where("substance <> ''")
    terms = named.select("query_id", "substance", "strength")
    stages = [
        list_manufacturers(named.where("wants_makers").select(*terms.columns), cat, k).withColumn("mode", F.lit(TRUSTED_LIST_MODES[0])),
        list_trade_names(named.where("wants_trade").select(*terms.columns), cat, k).withColumn("mode", F.lit(TRUSTED_LIST_MODES[1])),
        list_substance_gp(terms, cat, k).withColumn("mode", F.lit(TRUSTED_LIST_MODES[2])),
        list_by_manufacturer(asked.select("query_id", "manufacturer"), cat, k).withColumn("mode", F.lit(TRUSTED_LIST_MODES[3])),
    ]
    return _staged(*[s.drop("stage") for s in stages]).drop("stage")


# ---------------------------------------------------------------- lookup anchors
def lookup_anchor(hints: DataFrame, cat: Catalogue, k: int, limits: Limits = LIMITS) -> DataFrame:
    """(query_id, node_id, rank, mode): trade products, else generic products, else the manufacturer's products.

    ``hints`` is what ``understanding.anchor_hints`` adds.
    """
    k = max(limits.anchors_least, k)
    asked = hints.select(
        "query_id", F.col("hint_substance").alias("substance"), F.col("hint_dose").alias("strength"),
        F.lower("hint_maker").alias("maker"), "wants_trade_name", "wants_maker")
    tp = once_per(asked, ("substance", "strength", "maker"), lambda a: _named(text_matches(a, cat.nodes, "TP", TP_TEXT).where(
        (F.col("maker") == "") | F.contains(folded("manufacturer"), F.col("maker"))), k, "trade_name", "fsn", "name"))
    gp = once_per(asked, ("substance", "strength"), lambda a: _named(text_matches(a, cat.nodes, "GP", GP_TEXT), k, "fsn", "name"))
    mode = F.when(F.col("wants_maker"), "lookup_anchor_tp_manufacturer").when(
        F.col("wants_trade_name"), "lookup_anchor_tp_trade_name").otherwise("lookup_anchor_tp_substance")
    makers = list_by_manufacturer_contains(asked.select("query_id", "maker"), cat, k)
    staged = _staged(
        tp.join(asked.select("query_id", mode.alias("mode")), "query_id"),
        gp.withColumn("mode", F.lit("lookup_anchor_gp_substance")),
        makers.withColumn("mode", F.lit("lookup_anchor_tp_manufacturer_only")))
    return staged.drop("stage")


def list_by_manufacturer_contains(asked: DataFrame, cat: Catalogue, k: int) -> DataFrame:
    """(query_id, node_id, rank): trade products whose manufacturer contains ``maker``."""
    tp = cat.nodes.where("level = 'TP' and manufacturer is not null").withColumn("maker", folded("manufacturer"))
    terms = asked.select("query_id", F.col("maker").alias("term")).where("term <> ''")
    return _near(*_products_of(terms, tp, k), terms, k).select("query_id", "node_id", "rank")


def lookup_confidence(seeds: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, low_confidence, reason) of each asked question, from its ranked seeds."""
    few = max(3, min(6, k))
    support = sum((F.when(F.col(r) < NO_RANK, 1).otherwise(0) for r in ("v_rank", "t_rank", "g_rank", "exact_rank")), F.lit(0))
    stats = seeds.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("rank") == 1, F.col("rrf_score"))).alias("top"),
        F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("rrf_score"))), F.lit(0.0)).alias("second"),
        F.max(F.when(F.col("rank") == 1, support)).alias("support"))
    reason = (
        F.when(F.coalesce("n", F.lit(0)) == 0, "empty_seed").when(F.col("n") < few, "few_seed_candidates")
        .when((F.col("support") <= 1) & (F.col("top") - F.col("second") < 0.003), "weak_top_support").otherwise("stable"))
    return asked.select("query_id").distinct().join(stats, "query_id", "left").select(
        "query_id", (reason != "stable").alias("low_confidence"), reason.alias("reason"))


# ---------------------------------------------------------------- requests
def build_requests(rows: DataFrame, *, strategy: str, k: int, hops: int, text: Column | None = None,
                   levels: Column | None = None, v: Column | None = None, t: Column | None = None,
                   g: Column | None = None, filters: dict[str, Column] | None = None) -> DataFrame:
    """Search requests from structured questions; overrides replace the question's own plan."""
    filters = filters or {}
    text = F.col("query") if text is None else text
    rows = prepared(rows)
    weights = channel_weights(
        F.lit(strategy), F.col("target_type"), F.col("vector_weight") if v is None else v,
        F.col("fulltext_weight") if t is None else t, F.lit(None).cast("double") if g is None else g)
    return (
        rows.withColumn("_w", weights)
        .select(
            "query_id", text.alias("text"),
            (F.array(*[F.lit(x) for x in LEVELS]) if strategy == "lookup" else F.col("allowed_levels")
             if levels is None else levels).alias("levels"),
            filters.get("nlem", F.col("nlem_filter")).cast("boolean").alias("f_nlem"),
            filters.get("nlem_category", F.col("nlem_category")).cast("string").alias("f_nlem_category"),
            filters.get("manufacturer", F.col("manufacturer_filter")).cast("string").alias("f_manufacturer"),
            filters.get("tmtid", F.col("id_lookup")).cast("string").alias("f_tmtid"),
            F.col("own_terms").alias("seed_terms"), F.col("_w.v_weight").alias("v_weight"), F.col("_w.t_weight").alias("t_weight"),
            F.col("_w.g_weight").alias("g_weight"), F.lit(strategy).alias("strategy"), F.lit(k).alias("k"),
            F.lit(hops).alias("hops")))


def policy_weights(rows: DataFrame) -> dict[str, Column] | None:
    """Weights of rows that carry a policy: their own vector and text weights, and ``policy_g``."""
    if "policy_g" not in rows.columns:
        return None
    return dict(v=F.col("vector_weight"), t=F.col("fulltext_weight"), g=F.col("policy_g"))


def lookup_requests(rows: DataFrame, k: int, depth: int, graph_weight: float | None = 0.35) -> DataFrame:
    g = None if graph_weight is None else F.lit(graph_weight)
    if policy_weights(rows) is not None:
        g = F.coalesce("policy_g", F.lit(0.35))
    return build_requests(rows, strategy="lookup", k=k, hops=min(3, max(1, depth)), g=g)


def verify_requests(rows: DataFrame, k: int, attempt: int, limits: Limits = LIMITS) -> DataFrame:
    """The search of one of the ``VERIFY_ATTEMPTS``: strict, one filter less, all levels."""
    rows = prepared(rows)
    n = limits.attempt(k)
    null = F.lit(None)
    has_maker, has_cat = F.col("manufacturer_filter").isNotNull(), F.col("nlem_category").isNotNull()
    relaxed = {
        "manufacturer": null,
        "nlem_category": F.when(has_maker, F.col("nlem_category")),
        "nlem": F.when(has_maker | has_cat, F.col("nlem_filter")),
    }
    own = policy_weights(rows)
    if attempt == 0:
        return build_requests(rows, strategy="verify", k=n, hops=1, **(own or {}))
    even = own or dict(v=F.lit(0.33), t=F.lit(0.33), g=F.lit(0.34))
    levels = F.array(*[F.lit(x) for x in LEVELS]) if attempt == 2 else None
    return build_requests(rows, strategy="verify", k=n, hops=1, filters=relaxed, levels=levels, **even)


def compare_requests(rows: DataFrame, k: int, depth: int, limits: Limits = LIMITS) -> DataFrame:
    """One request per compared term, as ``query_id@n``."""
    rows = prepared(rows)
    n = limits.attempt(k)
    levels = F.array(*[F.lit(x) for x in dict((t, lv) for t, lv, _, _ in lx.SEARCH_PROFILES)["substance"]])
    null = F.lit(None)
    termed = rows.join(compare_terms(rows), "query_id")
    named = termed.withColumn("query_id", F.concat("query_id", F.lit("@"), F.col("term_no").cast("string")))
    weights = policy_weights(rows) or dict(v=F.lit(0.35), t=F.lit(0.30), g=F.lit(0.35))
    return build_requests(named, strategy="compare", k=n, hops=min(2, max(1, depth)), text=F.col("term"), levels=levels,
                          filters={"manufacturer": null, "tmtid": null}, **weights)


def list_fallback_requests(rows: DataFrame, k: int, limits: Limits = LIMITS) -> DataFrame:
    """Hybrid search for list questions no deterministic route answered."""
    k = max(1, k)
    hinted = prepared(rows)
    null = F.lit(None)
    by_maker = build_requests(
        hinted.where("list_maker <> ''"), strategy="list", k=at_most(k, limits.maker_list_most), hops=1, text=F.col("list_maker"),
        levels=F.array(F.lit("TP")), g=F.lit(0.45),
        filters={"manufacturer": F.col("list_maker"), "nlem": null, "nlem_category": null, "tmtid": null})
    plain = build_requests(hinted.where("list_maker = ''"), strategy="list", k=at_most(k, limits.plain_list_most), hops=1, g=F.lit(0.45))
    return by_maker.unionByName(plain)


def id_fallback_requests(rows: DataFrame, k: int = 10) -> DataFrame:
    return build_requests(rows, strategy="id_lookup_fallback", k=k, hops=1, g=F.lit(0.45))


# ---------------------------------------------------------------- the routes
@dataclass
class Results:
    """Seeds, routes and counts of a batch, the context around the seeds, and the plan of every search made."""

    seeds: DataFrame
    routes: DataFrame
    counts: DataFrame | None = None
    context: Expansion | None = None
    plans: DataFrame | None = None


SEED_COLUMNS = ("query_id", "node_id", "rank", "rrf_score", "v_rank", "t_rank", "g_rank", "exact_rank", "found_by_query")


def _flat_seeds(df: DataFrame, found_by: Column) -> DataFrame:
    """Seeds of a deterministic route: score 1, no channel ranks."""
    return df.select("query_id", "node_id", "rank", F.lit(1.0).alias("rrf_score"),
                     *[F.lit(NO_RANK).alias(r) for r in ("v_rank", "t_rank", "g_rank", "exact_rank")],
                     found_by.cast("string").alias("found_by_query"))


def _route(df: DataFrame, operator: str, mode: Column, fallback: Column, tier: Column | None = None) -> DataFrame:
    return df.select("query_id", F.lit(operator).alias("operator"), mode.cast("string").alias("mode"),
                     fallback.alias("fallback_used"), (F.lit(None) if tier is None else tier).cast("int").alias("fallback_tier"))


def id_matches(rows: DataFrame, cat: Catalogue, limits: Limits = LIMITS) -> DataFrame:
    """The nodes per question whose id is the one asked for, up to the limit."""
    asked = rows.select("query_id", F.col("id_lookup").alias("tmtid"))
    return top_k(likely_members(cat.nodes.select("node_id", "tmtid"), "tmtid", asked).join(asked, "tmtid"), ["query_id"], [F.col("node_id")], limits.id_matches)


def split_attempts(found: DataFrame) -> DataFrame:
    """Undo ``query_id@n``: the question's id and the number of the attempt or term."""
    return (found.withColumn("part_no", F.regexp_extract("query_id", r"@(\d+)$", 1).cast("int"))
            .withColumn("query_id", F.regexp_replace("query_id", r"@\d+$", "")))


def merge_lookup_fallback(primary: DataFrame, fallback: DataFrame, k: int) -> DataFrame:
    """Add the anchors' boosts to the hybrid seeds and rank again; ``fallback`` is 1-ranked."""
    idx = F.col("f_rank") - 1
    boost = F.greatest(F.lit(0.08), 0.22 - idx * 0.01)
    joined = primary.join(fallback.select("query_id", "node_id", F.col("rank").alias("f_rank")), ["query_id", "node_id"], "full_outer")
    merged = joined.select(
        "query_id", "node_id", F.col("rank").alias("p_rank"), "f_rank",
        F.round(F.coalesce("rrf_score", F.lit(0.0)) + F.coalesce(boost, F.lit(0.0)), 12).alias("rrf_score"),
        *[F.coalesce(r, F.lit(NO_RANK)).alias(r) for r in ("v_rank", "t_rank", "g_rank", "exact_rank")],
        F.coalesce("found_by_query", F.lit("lookup_fallback")).alias("found_by_query"))
    order = [F.desc("rrf_score"), F.asc_nulls_last("p_rank"), F.asc_nulls_last("f_rank"), F.col("node_id")]
    return top_k(merged, ["query_id"], order, max(3 * k, 24)).select(*SEED_COLUMNS)


def _lookup_results(rows: DataFrame, found: DataFrame, cat: Catalogue, k: int, limits: Limits = LIMITS) -> Results:
    primary = found.select(*SEED_COLUMNS)
    hints = prepared(rows)
    confidence = lookup_confidence(primary, rows, k)
    tried = materialise(hints.join(confidence, "query_id").withColumn(
        "attempted", F.col("low_confidence") | F.col("has_anchor")), "lookup_tried")
    weak = tried.where("attempted")
    k2 = limits.fallback(k)
    anchors = lookup_anchor(weak.where("hint_substance <> '' or hint_maker <> ''"), cat, k2, limits)
    lists = list_deterministic(weak, cat, k2)
    both = materialise(_staged(anchors, lists.select(*anchors.columns)), "lookup_fallback")
    used = both.groupBy("query_id").agg(F.first("mode").alias("mode"))
    merged = merge_lookup_fallback(primary, both, k)
    routes = tried.join(used, "query_id", "left").select(
        "query_id", F.lit("lookup").alias("operator"), "mode", F.col("mode").isNotNull().alias("fallback_used"),
        F.lit(None).cast("int").alias("fallback_tier"), "attempted", "reason", "has_anchor")
    return Results(merged, routes)


def lookup_route(rows: DataFrame, cat: Catalogue, vectors: Vectors | None, k: int, depth: int,
                 graph_weight: float | None = 0.35, limits: Limits = LIMITS) -> Results:
    """Hybrid search, then anchored matches where it looks weak or the question asks for names or makers."""
    rows = prepared(rows)
    found = materialise(search_general(lookup_requests(rows, k, depth, graph_weight), cat, vectors), "lookup_found")
    return _lookup_results(rows, found, cat, k, limits)


@dataclass
class Staged:
    """Seeds of each question's first stage with a result, as stage ``part_no``, and the plan of every search that was made."""

    found: DataFrame
    plans: DataFrame


def staged_search(rows: DataFrame, stages: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]], cat: Catalogue, vectors: Vectors | None,
                  first: tuple[DataFrame, DataFrame] | None = None) -> Staged:
    """Searches for the questions ``rows`` stage by stage, each stage for those that the stages before it left without seeds.

    A stage is a name and a function from questions to their search requests.
    ``first`` are the requests and seeds of the first stage where a caller has made that search already.
    """
    left, staged = rows, None
    for no, (name, build) in enumerate(stages):
        if no or first is None:
            requests = materialise(build(left), f"stage_{no}_requests")
            seeds = materialise(search_general(requests, cat, vectors), f"stage_{no}_found")
        else:
            requests, seeds = first
        plans = route_plans(requests, seeds).select("query_id", F.lit(no).alias("part_no"), F.lit(name).alias("name"), *PLAN_COLUMNS)
        seeds = seeds.withColumn("part_no", F.lit(no))
        staged = Staged(seeds, plans) if staged is None else Staged(staged.found.unionByName(seeds), staged.plans.unionByName(plans))
        left = materialise(left.join(seeds.select("query_id").distinct(), "query_id", "left_anti"), f"stage_{no}_left")
        if fits(left, 0):
            break
    return staged


VERIFY_ATTEMPTS = ("strict", "relax_one_filter", "broaden_scope")
PLAN_COLUMNS = ("query", "filters", "allowed_levels", "vector_weight", "fulltext_weight", "graph_weight", "depth", "seed_count", "channel_hits")


def verify_stages(k: int, limits: Limits = LIMITS) -> list[tuple[str, Callable[[DataFrame], DataFrame]]]:
    return [(name, lambda rows, no=no: verify_requests(rows, k, no, limits)) for no, name in enumerate(VERIFY_ATTEMPTS)]


def _verify_results(staged: Staged) -> Results:
    seeds = staged.found.select(*SEED_COLUMNS)
    tries = staged.plans.groupBy("query_id").agg(F.max("part_no").alias("tier"), F.array_sort(F.collect_list(F.struct("part_no", "name"))).alias("tried"))
    tries = tries.withColumn("mode", F.array_join(F.transform("tried", lambda t: t["name"]), ">"))
    routes = _route(tries, "verify", F.col("mode"), F.col("tier") > 0, F.when(F.col("tier") > 0, F.col("tier")))
    return Results(seeds, routes, plans=staged.plans)


def verify_route(rows: DataFrame, cat: Catalogue, vectors: Vectors | None, k: int, limits: Limits = LIMITS) -> Results:
    """Strict search, else one filter less, else all levels: the first attempt that finds anything; ``plans`` lists the attempts."""
    return _verify_results(staged_search(prepared(rows), verify_stages(k, limits), cat, vectors))


def _spread(vectors: Vectors | None, parts: int) -> Vectors | None:
    """The question's vector for each of its ``query_id@n`` requests, unless every text has one of its own."""
    if vectors is None or callable(vectors):
        return vectors
    return vectors.select(F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.concat("query_id", F.lit("@"), i.cast("string")))).alias("query_id"), "embedding")


def _compare_results(found: DataFrame, rows: DataFrame) -> Results:
    parts = split_attempts(found).withColumnRenamed("part_no", "group_no")
    merged = merge_first(parts).select(
        "query_id", "node_id", F.col("merged_rank").alias("rank"), *SEED_COLUMNS[3:])
    return Results(merged, _route(rows, "analyze_compare", F.lit(None), F.lit(False)))


def compare_route(rows: DataFrame, cat: Catalogue, vectors: Vectors | None, k: int, depth: int, limits: Limits = LIMITS) -> Results:
    """Each compared term searched on its own, merged in term order."""
    found = materialise(search_general(compare_requests(rows, k, depth, limits), cat, _spread(vectors, 2)), "compare_found")
    return _compare_results(found, rows)


def compare_detail(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, term_no, seed_count, top_tmtid): what each compared term found on its own."""
    parts = split_attempts(found)
    per = parts.groupBy("query_id", "part_no").agg(
        F.count(F.lit(1)).alias("seed_count"), F.min_by("node_id", "rank").alias("node_id"))
    return per.join(nodes.select("node_id", "tmtid"), "node_id").select(
        "query_id", F.col("part_no").alias("term_no"), "seed_count", F.col("tmtid").alias("top_tmtid"))


def list_route(rows: DataFrame, cat: Catalogue, vectors: Vectors | None, k: int = 100, limits: Limits = LIMITS) -> Results:
    """Deterministic lists first, hybrid search for the rest."""
    rows = prepared(rows)
    listed = materialise(list_deterministic(rows, cat, k), "listed")
    rest = rows.join(listed.select("query_id").distinct(), "query_id", "left_anti")
    found = search_general(list_fallback_requests(rest, k, limits), cat, vectors)
    return _list_results(rows, listed, found)


def _list_results(rows: DataFrame, listed: DataFrame, found: DataFrame) -> Results:
    seeds = _flat_seeds(listed, F.lit(None)).unionByName(found.select(*SEED_COLUMNS))
    modes = rows.select("query_id", "list_maker").join(listed.select("query_id", "mode").distinct(), "query_id", "left")
    mode = F.coalesce("mode", F.when(F.col("list_maker") != "", "manufacturer_graph_hybrid_fallback").otherwise("graph_hybrid_fallback"))
    return Results(seeds, _route(modes, "list", mode, F.col("mode").isNull()))


def id_lookup(rows: DataFrame, cat: Catalogue, vectors: Vectors | None, limits: Limits = LIMITS) -> Results:
    """The node of the asked id, else hybrid search."""
    rows = prepared(rows)
    exact = materialise(id_matches(rows, cat, limits), "id_matches")
    rest = rows.join(exact.select("query_id").distinct(), "query_id", "left_anti")
    found = search_general(id_fallback_requests(rest), cat, vectors)
    return _id_results(rows, exact, found)


def _id_results(rows: DataFrame, exact: DataFrame, found: DataFrame) -> Results:
    seeds = _flat_seeds(exact, F.col("tmtid")).unionByName(found.select(*SEED_COLUMNS))
    matched = exact.select("query_id", F.lit("exact").alias("mode")).distinct()
    joined = rows.select("query_id").join(matched, "query_id", "left")
    return Results(seeds, _route(joined, "id_lookup", F.coalesce("mode", F.lit("exact_not_found")), F.col("mode").isNull()))


def count_inputs(rows: DataFrame) -> DataFrame:
    return rows.select(
        "query_id", "question", "query", "target_type", slot_values("drug").alias("drugs"),
        slot_values("brand").alias("brands"), "nlem_filter", "nlem_category", F.col("manufacturer_filter").alias("manufacturer"))


def search_batch(structured: DataFrame, cat: Catalogue, vectors: Vectors | None = None, k: int = 10, depth: int = 2,
                 score=overlap_score, with_context: bool = True, limits: Limits = LIMITS) -> Results:
    """Route every question, search all hybrid requests in one pass, rerank lookups, cap, and expand."""
    rows = prepare(structured)
    part = {op: rows.where(F.col("operator") == op)
            for op in ("id_lookup", "verify", "analyze_count", "analyze_compare", "list", "lookup")}
    exact = materialise(id_matches(part["id_lookup"], cat, limits), "id_matches")
    listed = materialise(list_deterministic(part["list"], cat, limits.list_length), "listed")
    id_rest = part["id_lookup"].join(exact.select("query_id").distinct(), "query_id", "left_anti")
    list_rest = part["list"].join(listed.select("query_id").distinct(), "query_id", "left_anti")
    requests = materialise(
        lookup_requests(part["lookup"], k, depth).unionByName(verify_requests(part["verify"], k, 0, limits))
        .unionByName(compare_requests(part["analyze_compare"], k, depth, limits))
        .unionByName(list_fallback_requests(list_rest, limits.list_length, limits)).unionByName(id_fallback_requests(id_rest)), "requests")
    all_vectors = vectors
    if vectors is not None and not callable(vectors):
        all_vectors = vectors.unionByName(_spread(vectors, 2)).join(requests.select("query_id"), "query_id", "left_semi")
    found = materialise(search_general(requests, cat, all_vectors).join(
        requests.select("query_id", "strategy"), "query_id"), "batch_found")

    def of(*strategies: str) -> DataFrame:
        return found.where(F.col("strategy").isin(*strategies))

    verified = staged_search(part["verify"], verify_stages(k, limits), cat, vectors, (requests.where("strategy = 'verify'"), of("verify").drop("strategy")))
    results = [
        _lookup_results(part["lookup"], of("lookup"), cat, k, limits), _verify_results(verified),
        _compare_results(of("compare"), part["analyze_compare"]), _list_results(part["list"], listed, of("list")),
        _id_results(part["id_lookup"], exact, of("id_lookup_fallback"))]
    counts = materialise(count_route(count_inputs(part["analyze_count"]), cat.nodes, cat.edges), "counts")
    counted = counts.select("query_id", F.lit("analyze_count").alias("operator"), F.col("count_mode").alias("mode"),
                            "fallback_used", F.lit(None).cast("int").alias("fallback_tier"))
    seeds, routes = results[0].seeds, results[0].routes.select(*counted.columns)
    for r in results[1:]:
        seeds, routes = seeds.unionByName(r.seeds), routes.unionByName(r.routes)
    routes = materialise(routes.unionByName(counted), "routes")
    seeds = materialise(seeds, "batch_seeds")
    if score is not None:
        lookups = seeds.join(routes.where("operator = 'lookup'").select("query_id"), "query_id", "left_semi")
        ranked = rerank(lookups, structured, cat.nodes, limits.rerank_length, score).select("query_id", "node_id", "new_rank")
        others = seeds.join(routes.where("operator = 'lookup'").select("query_id"), "query_id", "left_anti")
        seeds = others.unionByName(lookups.join(ranked, ["query_id", "node_id"]).withColumn(
            "rank", F.col("new_rank")).select(*seeds.columns))
    capped = materialise(final_cap(seeds, routes), "capped")
    context = None
    if with_context:
        deep = capped.withColumn("depth", F.when(F.col("operator").isin("lookup", "analyze_compare"), depth).otherwise(1))
        plain_list = (F.col("operator") == "list") & ~F.col("fallback_used")
        context = expand_context(deep.where(~plain_list), cat, depth=depth)
    others = requests.where("strategy <> 'verify'")
    plans = route_plans(others, found).select(
        F.regexp_replace("query_id", r"@\d+$", "").alias("query_id"), F.coalesce(F.regexp_extract("query_id", r"@(\d+)$", 1).try_cast("int"), F.lit(0)).alias("part_no"),
        F.lit("search").alias("name"), *PLAN_COLUMNS)
    return Results(capped, routes, counts, context, plans.unionByName(verified.plans))
