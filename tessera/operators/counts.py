"""Counts over the catalogue: by substance tree, text, manufacturer, level."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import lexicon as lx
from ..functions.matching import contains_join
from ..functions.ranking import top_k
from ..functions.text import folded, first_tail, has_any, haystack, join_doses, squash
from ..schema import CONTAINS_COLUMNS, GP_TO_VTM, LEVELS, PRODUCT_LEVELS, SUBSTANCE_TO_VTM
from ..session import materialise


def _level(nodes: DataFrame, level: str, alias: str) -> DataFrame:
    return nodes.where(F.col("level") == level).select(F.col("node_id").alias(alias))


def _step(edges: DataFrame, types: Sequence[str], src: str, dst: str) -> DataFrame:
    return edges.where(F.col("type").isin(*types)).select(F.col("src_id").alias(src), F.col("dst_id").alias(dst))


def substance_generics(asked: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, subs, vtm, gp): the generic products below each asked substance name."""
    subs = nodes.where("level = 'SUBS'").select(F.col("node_id").alias("subs"), folded("name").alias("substance"))
    return (
        asked.select("query_id", "substance").join(subs, "substance")
        .join(_step(edges, SUBSTANCE_TO_VTM, "subs", "vtm"), "subs").join(_level(nodes, "VTM", "vtm"), "vtm")
        .join(_step(edges, GP_TO_VTM, "gp", "vtm"), "vtm").join(_level(nodes, "GP", "gp"), "gp")
        .select("query_id", "subs", "vtm", "gp"))


def substance_members(asked: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct (query_id, level, node_id) of everything in each substance's tree.

    The optional levels are walked one after another from the distinct generic
    products, so the product of units, brands and packs is never formed.
    """
    chain = substance_generics(asked, nodes, edges)
    gp = chain.select("query_id", "gp").distinct()
    gpu = gp.join(_step(edges, ["HAS_GENERIC_UNIT"], "gp", "gpu"), "gp").join(_level(nodes, "GPU", "gpu"), "gpu")
    tp = (gp.join(_step(edges, ["HAS_TRADE_PRODUCT"], "gp", "tp"), "gp").join(_level(nodes, "TP", "tp"), "tp")
          .select("query_id", "tp").distinct())
    tpu = tp.join(_step(edges, ["HAS_TRADE_UNIT"], "tp", "tpu"), "tp").join(_level(nodes, "TPU", "tpu"), "tpu")

    def named(df: DataFrame, column: str, level: str) -> DataFrame:
        return df.select("query_id", F.lit(level).alias("level"), F.col(column).alias("node_id"))

    return (
        named(chain, "subs", "SUBS").unionByName(named(chain, "vtm", "VTM")).unionByName(named(gp, "gp", "GP"))
        .unionByName(named(gpu, "gpu", "GPU")).unionByName(named(tp, "tp", "TP"))
        .unionByName(named(tpu, "tpu", "TPU")).distinct())


def count_substance_tree(asked: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct members per level of each asked substance; ``total`` counts generic products.

    A substance many questions ask about is counted once.
    """
    distinct = asked.select(F.col("substance").alias("query_id"), "substance").distinct()
    counts = substance_members(distinct, nodes, edges).groupBy(F.col("query_id").alias("substance")).agg(*[
        F.count_if(F.col("level") == lv).alias(f"{lv.lower()}_count") for lv in LEVELS])
    filled = [F.coalesce(f"{lv.lower()}_count", F.lit(0)).alias(f"{lv.lower()}_count") for lv in LEVELS]
    return (
        asked.select("query_id", "substance").distinct().join(counts, "substance", "left")
        .select("query_id", *filled, F.coalesce("gp_count", F.lit(0)).alias("total")))


def count_contains(asked: DataFrame, nodes: DataFrame, levels: Sequence[str] = PRODUCT_LEVELS,
                   columns: Sequence[str] = CONTAINS_COLUMNS) -> DataFrame:
    """Nodes of the levels whose text contains each asked ``term``."""
    folded_terms = asked.select("query_id", F.lower("term").alias("term"))
    texts = nodes.where(F.col("level").isin(*levels)).select("node_id", haystack(columns).alias("hay"))
    counts = (
        contains_join(folded_terms.select("term").distinct(), texts)
        .groupBy("term").agg(F.count(F.lit(1)).alias("total")))  # node ids are unique
    return folded_terms.join(counts, "term", "left").select("query_id", F.coalesce("total", F.lit(0)).alias("total"))


def resolve_substance(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, term, substance): the catalogue substance a term means.

    An equal name wins; else the best name that contains the term or lies in
    it; else the term itself.
    """
    asked = asked.select("query_id", "term", F.lower(join_doses(F.col("term"))).alias("t"))
    terms = asked.select("t").where("t <> ''").distinct()
    names = (nodes.where("level = 'SUBS' and name is not null and name <> ''")
             .select(folded("name").alias("n"), squash("name").alias("name")))
    exact = (terms.join(names, F.col("t") == F.col("n")).groupBy("t").agg(F.min("name").alias("name")))
    open_terms = terms.join(exact, "t", "left_anti")
    in_name = contains_join(open_terms.withColumnRenamed("t", "term"), names.select("n").distinct(), text="n", key="n")
    in_term = contains_join(names.select(F.col("n").alias("term")).distinct(), open_terms, text="t", key="t")
    pairs = (in_name.select(F.col("term").alias("t"), "n")
             .unionByName(in_term.select("t", F.col("term").alias("n"))).distinct())
    near = pairs.withColumn(
        "pri", F.when(F.startswith("n", "t"), 0).when(F.startswith("t", "n"), 1).otherwise(2)).withColumn(
        "delta", F.abs(F.length("n") - F.length("t")))
    best = top_k(near, ["t"], [F.col("pri"), F.col("delta"), F.col("n")], 1).join(names, "n").groupBy("t").agg(
        F.min("name").alias("name"))
    found = exact.unionByName(best)
    return asked.join(found, "t", "left").select(
        "query_id", "term", F.coalesce("name", join_doses(F.col("term"))).alias("substance"))


def count_levels(nodes: DataFrame, levels: Sequence[str] = LEVELS) -> DataFrame:
    """(level, n, total): rows per level and over all levels."""
    per = nodes.where(F.col("level").isin(*levels)).groupBy("level").agg(F.count(F.lit(1)).alias("n"))
    # One row per level is left by now, so the unpartitioned window is tiny.
    return per.withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(1))))


def count_products(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("level").isin(*PRODUCT_LEVELS)).agg(F.count(F.lit(1)).alias("total"))


def count_manufacturer(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """Trade products whose manufacturer contains each asked ``manufacturer``.

    Products are counted per distinct manufacturer first; only those names are matched.
    """
    terms = asked.select("query_id", F.lower("manufacturer").alias("term"))
    per_maker = nodes.where("level = 'TP'").groupBy(folded("manufacturer").alias("maker")).agg(
        F.count(F.lit(1)).alias("n"))
    counts = (contains_join(terms.select("term").distinct(), per_maker, text="maker", key="maker")
              .groupBy("term").agg(F.sum("n").alias("total")))
    return terms.join(counts, "term", "left").select("query_id", F.coalesce("total", F.lit(0)).alias("total"))


def count_nlem(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """Essential-medicine generic products, of one category when ``nlem_category`` is given."""
    per = nodes.where("level = 'GP' and nlem").groupBy("nlem_category").agg(F.count(F.lit(1)).alias("n"))
    keyed = (per.select(F.explode(F.array(F.coalesce("nlem_category", F.lit("")), F.lit("*"))).alias("cat"), "n")
             .groupBy("cat").agg(F.sum("n").alias("total")))
    return (
        asked.select("query_id", F.coalesce("nlem_category", F.lit("*")).alias("cat"))
        .join(keyed, "cat", "left").select("query_id", F.coalesce("total", F.lit(0)).alias("total")))


def _mentions_catalogue(text: Column, hints: Sequence[str]) -> Column:
    low = F.lower(squash(text))
    return F.contains(low, F.lit("tmt")) & has_any(low, hints)


def tag_count_mode(asked: DataFrame) -> DataFrame:
    """Add ``mode`` and ``term``, choosing the way each count question is answered.

    ``asked`` has query_id, question, query, target_type, drugs, brands
    (arrays), manufacturer, nlem_filter, nlem_category.
    """
    question = F.col("question")
    inferred = F.coalesce(join_doses(first_tail(question, lx.SUBSTANCE_TAIL)), F.lit(""))
    drug = F.coalesce(join_doses(F.try_element_at("drugs", F.lit(1))), F.lit(""))
    candidate = F.when(F.size("drugs") > 0, drug).otherwise(inferred)
    maker = join_doses(F.col("manufacturer"))
    anchored = (F.size("drugs") > 0) | (F.size("brands") > 0) | (maker != "")
    products = _mentions_catalogue(question, lx.PRODUCT_COUNT_HINTS)
    everything = _mentions_catalogue(question, lx.HIERARCHY_COUNT_HINTS)
    probe = ~anchored & ((F.col("target_type") == "hierarchy") | F.contains(F.lower("question"), F.lit("tmt")))
    generic = F.coalesce(F.try_element_at("brands", F.lit(1)), join_doses(F.col("query")), F.lit(""))
    by_level = F.col("target_type") == "hierarchy"
    mode = (
        F.when(probe & everything & ~products, "hierarchy_breakdown")
        .when(probe & products, "produced_product_levels")
        .when(candidate != "", "substance")
        .when(maker != "", "manufacturer_products")
        .when((F.col("target_type") == "nlem") | F.coalesce("nlem_filter", F.lit(False)), "nlem_gp")
        .when(by_level & (products | _mentions_catalogue(F.col("query"), lx.PRODUCT_COUNT_HINTS)),
              "produced_product_levels")
        .when(by_level, "hierarchy_breakdown")
        .when(generic != "", "generic")
        .otherwise("all_product_levels"))
    return (
        asked.withColumn("mode", mode)
        .withColumn("maker", maker)
        .withColumn("term", F.when(F.col("mode") == "substance", candidate).when(F.col("mode") == "generic", generic)))


def count_route(asked: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, count_mode, substance, fallback_used, result) of each count question."""
    tagged = materialise(tag_count_mode(asked), "count_modes")
    totals = materialise(count_levels(nodes), "level_counts")
    everything, products = F.array(F.lit("hierarchy_breakdown")), F.array(
        F.lit("hierarchy_breakdown"), F.lit("produced_product_levels"), F.lit("all_product_levels"))
    sums = (
        totals.select("n", F.explode(F.when(F.col("level").isin(*PRODUCT_LEVELS), products).otherwise(everything))
                      .alias("mode"))
        .groupBy("mode").agg(F.sum("n").alias("result")))
    whole = tagged.join(sums, "mode").select(
        "query_id", F.col("mode").alias("count_mode"), F.lit(None).cast("string").alias("substance"), "result")

    termed = tagged.where(F.col("mode").isin("substance", "generic"))
    resolved = materialise(resolve_substance(termed.select("query_id", "term"), nodes).select(
        "query_id", F.lower("substance").alias("substance"), F.col("substance").alias("shown")), "resolved")
    tree = count_substance_tree(resolved, nodes, edges).select("query_id", F.col("total").alias("tree"))
    staged = materialise(termed.join(resolved, "query_id").join(tree, "query_id").select(
        "query_id", "mode", "term", "shown", "tree"), "count_trees")
    texts = count_contains(staged.where("tree = 0").select("query_id", "term"), nodes, ["GP"])
    by_term = staged.join(texts, "query_id", "left").select(
        "query_id",
        F.when(F.col("tree") > 0, F.when(F.col("mode") == "substance", "substance_graph_gp")
               .otherwise("substance_graph_gp_fallback"))
        .otherwise(F.when(F.col("mode") == "substance", "text_fallback_gp").otherwise("text_contains_gp"))
        .alias("count_mode"),
        F.when((F.col("tree") > 0), F.col("shown")).when(F.col("mode") == "substance", F.col("term")).alias("substance"),
        F.when(F.col("tree") > 0, F.col("tree")).otherwise(F.coalesce("total", F.lit(0))).alias("result"))

    none = F.lit(None).cast("string").alias("substance")
    makers = tagged.where("mode = 'manufacturer_products'").select("query_id", F.col("maker").alias("manufacturer"))
    by_maker = count_manufacturer(makers, nodes).select(
        "query_id", F.lit("manufacturer_products").alias("count_mode"), none, F.col("total").alias("result"))
    by_nlem = count_nlem(tagged.where("mode = 'nlem_gp'"), nodes).select(
        "query_id", F.lit("nlem_gp").alias("count_mode"), none, F.col("total").alias("result"))
    return whole.unionByName(by_term).unionByName(by_maker).unionByName(by_nlem).withColumn(
        "fallback_used", F.col("count_mode") == "text_fallback_gp")


def reconcile_counts(manual: DataFrame, router: DataFrame, key: str = "question") -> DataFrame:
    """(key, manual, router, delta, verdict) of two counts of the same questions."""
    joined = manual.select(key, F.col("total").alias("manual")).join(
        router.select(key, F.col("total").alias("router")), key, "left")
    delta = F.col("manual") - F.col("router")
    return joined.withColumn("delta", delta).withColumn(
        "verdict", F.when(F.col("router").isNull(), "missing").when(delta > 0, "broader")
        .when(delta < 0, "more_constrained").otherwise("same"))


def reconcile_summary(reconciled: DataFrame) -> DataFrame:
    return reconciled.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))
