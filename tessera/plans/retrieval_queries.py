"""Registered queries of ranked retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.ranking import top_k
from ..operators import retrieval as rv
from ..session import materialise
from . import fixtures as fx, search_sql as X, sql as S
from .catalogue_queries import pairs, ranked_pairs

QUERIES = {}
ORACLES = {}


def registered(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


S.fragment("request_vectors", "SELECT q.query_id, e.embedding FROM requests q JOIN embeddings e ON e.vec_id = "
           "CAST('0x' || substr(md5(q.query_id), 1, 6) AS BIGINT) % (SELECT count(*) FROM embeddings)", "requests")
X.search("requests", "r", "request_vectors", "requests")
LIMIT = 20


@registered("r1_exact_match_topk", S.query("SELECT query_id, node_id, pri, delta, exact_rank FROM r_exact", "r_exact"))
def r1(spark, d):
    asked = fx.search_requests(spark, d).where("strategy = 'lookup'")
    return rv.exact_match_topk(asked, fx.catalogue(spark, d).nodes, 10)


@registered("r2_vector_topk", S.query("SELECT query_id, node_id, round(v_score, 6) AS v_score, v_rank FROM r_v", "r_v"))
def r2(spark, d):
    hits = rv.vector_topk(fx.search_requests(spark, d), fx.request_vectors(spark, d), fx.catalogue(spark, d).nodes, LIMIT)
    return hits.withColumn("v_score", F.round("v_score", 6))


@registered("r3_fulltext_topk", S.query("SELECT query_id, node_id, round(t_score, 6) AS t_score, t_rank FROM r_t", "r_t"))
def r3(spark, d):
    cat, asked = fx.catalogue(spark, d), fx.search_requests(spark, d)
    hits = rv.fulltext_topk(asked.select("text"), cat, LIMIT)
    return rv.fulltext_channel(asked, hits, cat.nodes).withColumn("t_score", F.round("t_score", 6))


@registered("r4_graph_anchors", S.query("SELECT query_id, node_id, round(score, 6) AS score, rank, place FROM r_anchors", "r_anchors"))
def r4(spark, d):
    cat, asked = fx.catalogue(spark, d), fx.search_requests(spark, d)
    return rv.graph_anchors(asked, cat, rv.text_hits(asked, cat, LIMIT), LIMIT).withColumn("score", F.round("score", 6))


@registered("r5_traverse", S.query("SELECT query_id, node_id, graph_hop, graph_support, round(g_score, 6) AS g_score, g_rank FROM r_g", "r_g"))
def r5(spark, d):
    cat, asked = fx.catalogue(spark, d), fx.search_requests(spark, d)
    anchors = rv.graph_anchors(asked, cat, rv.text_hits(asked, cat, LIMIT), LIMIT)
    return rv.traverse(asked, anchors, cat, LIMIT).withColumn("g_score", F.round("g_score", 6))


@registered("r6_channel_weights", """
    SELECT vec_id, round(v / s, 6) AS v_weight, round(t / s, 6) AS t_weight, round(g / s, 6) AS g_weight FROM (
      SELECT vec_id, (1 - g) * v0 / (v0 + t0) AS v, (1 - g) * t0 / (v0 + t0) AS t, g, (1 - g) + g AS s FROM (
        SELECT vec_id, CASE WHEN v1 + t1 = 0 THEN 0.5 ELSE v1 END AS v0, CASE WHEN v1 + t1 = 0 THEN 0.5 ELSE t1 END AS t0,
          CASE WHEN o IS NOT NULL THEN greatest(0, least(0.9, o)) ELSE greatest(0.15, least(0.55,
            CASE WHEN st IN ('verify', 'compare', 'list') THEN 0.35 WHEN st IN ('count', 'id_lookup') THEN 0.20 ELSE 0.28 END
            + CASE WHEN tg IN ('hierarchy', 'substance', 'manufacturer') THEN 0.05 ELSE 0 END)) END AS g FROM (
          SELECT vec_id, (['verify','compare','list','count','id_lookup','lookup'])[vec_id % 6 + 1] AS st, (['manufacturer','substance','nlem','hierarchy','formula','general','other'])[vec_id % 7 + 1] AS tg,
            (vec_id % 5) / 4.0 AS v1, (vec_id % 3) / 2.0 AS t1, CASE WHEN vec_id % 4 = 0 THEN (vec_id % 11) / 10.0 END AS o FROM embeddings)))""")
def r6(spark, d):
    i = F.col("vec_id")
    kinds = F.array(*[F.lit(x) for x in ("verify", "compare", "list", "count", "id_lookup", "lookup")])
    targets = F.array(*[F.lit(x) for x in ("manufacturer", "substance", "nlem", "hierarchy", "formula", "general", "other")])
    w = rv.channel_weights(F.element_at(kinds, (i % 6 + 1).cast("int")), F.element_at(targets, (i % 7 + 1).cast("int")), (i % 5) / 4.0, (i % 3) / 2.0,
                           F.when(i % 4 == 0, (i % 11) / 10.0))
    return fx.table(spark, d, "embeddings").select("vec_id", w.alias("w")).select(
        "vec_id", *[F.round(f"w.{c}", 6).alias(c) for c in ("v_weight", "t_weight", "g_weight")])


S.fragment("pair_channels", """SELECT query_id, tmtid AS node_id, row_number() OVER (PARTITION BY query_id ORDER BY price DESC, tmtid) - 1 AS v,
    row_number() OVER (PARTITION BY query_id ORDER BY quantity DESC, tmtid) - 1 AS t, row_number() OVER (PARTITION BY query_id ORDER BY tax DESC, tmtid) - 1 AS g FROM pairs""", "pairs")
S.fragment("pair_fused", """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, v_rank, t_rank, g_rank, node_id) AS fused_rank FROM (
    SELECT query_id, node_id, CASE WHEN v < 12 THEN v ELSE 9999 END AS v_rank, CASE WHEN t < 12 THEN t ELSE 9999 END AS t_rank, CASE WHEN g < 12 THEN g ELSE 9999 END AS g_rank,
      round(w * CASE WHEN v < 12 THEN 1.0 / (61 + v) ELSE 0 END + (0.7 - w) * CASE WHEN t < 12 THEN 1.0 / (61 + t) ELSE 0 END + 0.3 * CASE WHEN g < 12 THEN 1.0 / (61 + g) ELSE 0 END, 12) AS rrf_score
    FROM (SELECT *, CAST(query_id AS BIGINT) % 7 / 10.0 AS w FROM pair_channels WHERE v < 12 OR t < 12 OR g < 12)) QUALIFY fused_rank <= 10""", "pair_channels")


def pair_fused(spark, d) -> DataFrame:
    """Three orders of each part's suppliers, fused."""
    base = materialise(pairs(spark, d), "pairs")
    def channel(by, p):
        hits = top_k(base.select("query_id", F.col("tmtid").alias("node_id"), by), ["query_id"], [F.desc(by), F.col("node_id")], 12, f"{p}_rank", first=0)
        hits = hits.withColumn(f"{p}_score", F.col(by)).drop(by)
        return hits.withColumn("graph_hop", F.lit(1)).withColumn("graph_support", F.lit(1).cast("bigint")) if p == "g" else hits
    w = F.col("query_id").cast("bigint") % 7 / 10.0
    asked = base.select("query_id").distinct().select("query_id", F.lit(10).alias("k"), w.alias("v_weight"), (0.7 - w).alias("t_weight"), F.lit(0.3).alias("g_weight"))
    return rv.fuse_rrf(channel("price", "v"), channel("quantity", "t"), channel("tax", "g"), asked, 20)


@registered("r7_fuse_rrf", S.query("SELECT query_id, node_id, v_rank, t_rank, g_rank, round(rrf_score, 9) AS rrf_score, fused_rank FROM pair_fused", "pair_fused"))
def r7(spark, d):
    return pair_fused(spark, d).select("query_id", "node_id", "v_rank", "t_rank", "g_rank", F.round("rrf_score", 9).alias("rrf_score"), "fused_rank")


@registered("r8_hybrid_search", S.query("SELECT query_id, node_id, v_rank, t_rank, g_rank, round(rrf_score, 9) AS rrf_score, fused_rank FROM r_fused", "r_fused"))
def r8(spark, d):
    return rv.hybrid_search(fx.search_requests(spark, d), fx.catalogue(spark, d), fx.request_vectors(spark, d)).select(
        "query_id", "node_id", "v_rank", "t_rank", "g_rank", F.round("rrf_score", 9).alias("rrf_score"), "fused_rank")


@registered("r9_merge_query_variants", S.query("""
    SELECT query_id, node_id, round(rrf_score, 9) AS rrf_score, exact_rank, found_by_query, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, v_rank, t_rank, exact_rank, node_id) AS rank FROM (
        SELECT query_id, node_id, CASE WHEN replaced OR v >= 8 THEN 9999 ELSE v END AS v_rank, CASE WHEN replaced THEN t ELSE 9999 END AS t_rank,
          CASE WHEN boost IS NULL THEN 9999 ELSE g END AS exact_rank, CASE WHEN replaced THEN 'second' ELSE 'first' END AS found_by_query,
          round(CASE WHEN replaced THEN s2 ELSE had END + coalesce(boost, 0), 12) AS rrf_score
        FROM (SELECT *, t < 8 AND (had IS NULL OR s2 > had) AS replaced FROM (
          SELECT *, CASE WHEN boost IS NULL THEN CASE WHEN v < 8 THEN s1 END ELSE CASE WHEN v < 8 THEN s1 ELSE 0 END + boost END AS had FROM (
            SELECT query_id, node_id, v, t, g, round(1.0 / (61 + v), 12) AS s1, round(1.0 / (61 + t), 12) AS s2,
              CASE WHEN g >= 5 THEN NULL WHEN g = 0 THEN 0.45 ELSE greatest(0.15, 0.35 - g * 0.02) END AS boost
            FROM pair_channels WHERE v < 8 OR t < 8 OR g < 5))))) WHERE rank <= 24""", "pair_channels"))
def r9(spark, d):
    base = materialise(pairs(spark, d).withColumnRenamed("tmtid", "node_id"), "pairs")
    def variant(by, no, name, v, t):
        hits = top_k(base.select("query_id", "node_id", by), ["query_id"], [F.desc(by), F.col("node_id")], 8, "p", first=0)
        return hits.select("query_id", "node_id", (F.col("p") if v else F.lit(9999)).alias("v_rank"), (F.col("p") if t else F.lit(9999)).alias("t_rank"), F.lit(9999).alias("g_rank"),
                           F.lit(None).cast("int").alias("graph_hop"), F.lit(None).cast("bigint").alias("graph_support"),
                           F.round(F.lit(1.0) / (F.col("p") + 61), 12).alias("rrf_score"), F.lit(no).alias("variant_no"), F.lit(name).alias("found_by_query"))
    found = variant("price", 1, "first", True, False).unionByName(variant("quantity", 2, "second", False, True))
    exact = top_k(base.select("query_id", "node_id", "tax"), ["query_id"], [F.desc("tax"), F.col("node_id")], 5, "exact_rank", first=0).select(
        "query_id", "node_id", "exact_rank", F.explode(F.array(F.struct(F.lit(1).alias("n"), F.lit("first").alias("by")), F.struct(F.lit(2).alias("n"), F.lit("second").alias("by")))).alias("x"))
    exact = exact.select("query_id", "node_id", "exact_rank", F.col("x.n").alias("variant_no"), F.col("x.by").alias("found_by_query"))
    return rv.merge_query_variants(found, exact, 24).select("query_id", "node_id", F.round("rrf_score", 9).alias("rrf_score"), "exact_rank", "found_by_query", "rank")


S.fragment("context_seeds", "SELECT query_id, node_id, rank, CASE CAST(substr(query_id, 3) AS BIGINT) % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS depth FROM r_seeds WHERE rank <= 10", "r_seeds")
X.paths("context_seeds", "x")


def found_seeds(spark, d) -> DataFrame:
    return rv.search_general(fx.search_requests(spark, d), fx.catalogue(spark, d), fx.request_vectors(spark, d))


def context(spark, d):
    third = F.substring("query_id", 3, 20).cast("bigint") % 3
    depth = F.when(third == 0, 1).when(third == 1, 2).otherwise(3)
    seeds = found_seeds(spark, d).where("rank <= 10").withColumn("depth", depth)
    return rv.expand_context(seeds, fx.catalogue(spark, d), 3)


@registered("r10_expand_context", S.query(
    "SELECT query_id, 'node' AS kind, node_id AS id, is_seed, found_at FROM x_ctx UNION ALL SELECT query_id, 'rel', start_id || '-' || type || '-' || end_id, NULL, found_at FROM x_rels",
    "x_ctx", "x_rels"))
def r10(spark, d):
    around = context(spark, d)
    nodes = around.nodes.select("query_id", F.lit("node").alias("kind"), F.col("node_id").alias("id"), "is_seed", "found_at")
    rels = around.relationships.select("query_id", F.lit("rel").alias("kind"), F.concat_ws("-", "start_id", "type", "end_id").alias("id"),
                                       F.lit(None).cast("boolean").alias("is_seed"), "found_at")
    return nodes.unionByName(rels)


@registered("r11_search_general", S.query("SELECT query_id, node_id, v_rank, t_rank, g_rank, exact_rank, round(rrf_score, 9) AS rrf_score, rank FROM r_seeds", "r_seeds"))
def r11(spark, d):
    return found_seeds(spark, d).select("query_id", "node_id", "v_rank", "t_rank", "g_rank", "exact_rank", F.round("rrf_score", 9).alias("rrf_score"), "rank")


@registered("r12_channel_hits", S.query(
    "SELECT query_id, count(*) FILTER (v_rank < 9999) AS vector, count(*) FILTER (t_rank < 9999) AS fulltext, count(*) FILTER (g_rank < 9999) AS graph, 0 AS exact FROM pair_fused GROUP BY query_id", "pair_fused"))
def r12(spark, d):
    return rv.channel_hits(pair_fused(spark, d).withColumn("exact_rank", F.lit(9999)))


@registered("r13_merge_first", S.query("""
    SELECT query_id, node_id, group_no, rank, row_number() OVER (PARTITION BY query_id ORDER BY group_no, rank) AS merged_rank FROM (
      SELECT * FROM (SELECT query_id, node_id, 0 AS group_no, v + 1 AS rank FROM pair_channels WHERE v < 15 UNION ALL SELECT query_id, node_id, 1, t + 1 FROM pair_channels WHERE t < 15)
      QUALIFY row_number() OVER (PARTITION BY query_id, node_id ORDER BY group_no, rank) = 1)""", "pair_channels"))
def r13(spark, d):
    base = materialise(pairs(spark, d).withColumnRenamed("tmtid", "node_id"), "pairs")
    def group(by, no):
        return top_k(base.select("query_id", "node_id", by), ["query_id"], [F.desc(by), F.col("node_id")], 15).select("query_id", "node_id", F.lit(no).alias("group_no"), "rank")
    return rv.merge_first(group("price", 0).unionByName(group("quantity", 1))).select("query_id", "node_id", "group_no", "rank", "merged_rank")


@registered("r14_rerank", S.query(f"""
    SELECT query_id, node_id, round(score, 6) AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS new_rank FROM (
      SELECT c.query_id, n.node_id, c.rank, coalesce(len(list_intersect(q.words, {{w}})) / nullif(len(q.words), 0)::DOUBLE, 0.0) AS score
      FROM ranked_pairs c JOIN (SELECT query_id, list_distinct(list_filter(regexp_split_to_array(lower(question), {X.WORDS}), lambda w: w <> '')) AS words FROM templated) q ON q.query_id = 'p|' || c.query_id
      JOIN nodes n ON n.node_id = CAST(3000000000000000000 + CAST(c.tmtid AS BIGINT) AS VARCHAR)) QUALIFY new_rank <= 10""".replace(
    "{w}", f"list_filter(regexp_split_to_array(lower(concat_ws(' ', n.fsn, n.trade_name, n.generic_name)), {X.WORDS}), lambda w: w <> '')"), "ranked_pairs", "templated", "nodes"))
def r14(spark, d):
    found = ranked_pairs(spark, d).select(F.concat(F.lit("p|"), "query_id").alias("query_id"), "rank", (F.col("tmtid").cast("bigint") + 3000000000000000000).cast("string").alias("node_id"))
    ranked = rv.rerank(found, fx.templated(spark, d), fx.catalogue(spark, d).nodes, 10)
    return ranked.select(F.substring("query_id", 3, 20).alias("query_id"), "node_id", F.round("rerank_score", 6).alias("rerank_score"), "new_rank")


def load_trigrams():
    """A stand-in for a pair model: the Jaccard likeness of two texts' character trigrams."""
    def grams(text: str) -> set[str]:
        low = (text or "").lower()
        return {low[i:i + 3] for i in range(len(low) - 2)}

    def score(questions, texts):
        return [len(q & t) / len(q | t) if q | t else 0.0 for q, t in zip(map(grams, questions), map(grams, texts))]

    return score


def _trigrams(text: str) -> str:
    return f"list_distinct(list_transform(range(1, length({text}) - 1), lambda i: substr(lower({text}), i, 3)))"


@registered("r14_rerank_model", S.query(f"""
    SELECT query_id, node_id, round(score, 6) AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS new_rank FROM (
      SELECT query_id, node_id, rank, coalesce(len(list_intersect(q, t)) / nullif(len(list_distinct(list_concat(q, t))), 0)::DOUBLE, 0.0) AS score FROM (
        SELECT c.query_id, n.node_id, c.rank, {_trigrams('q.question')} AS q, {_trigrams("trim(concat_ws(' ', coalesce(n.fsn, ''), '', coalesce(n.trade_name, ''), coalesce(n.generic_name, '')))")} AS t
        FROM ranked_pairs c JOIN templated q ON q.query_id = 'p|' || c.query_id JOIN nodes n ON n.node_id = CAST(3000000000000000000 + CAST(c.tmtid AS BIGINT) AS VARCHAR)
        WHERE c.rank <= 5)) QUALIFY new_rank <= 3""", "ranked_pairs", "templated", "nodes"))
def r14_model(spark, d):
    found = ranked_pairs(spark, d).where("rank <= 5").select(
        F.concat(F.lit("p|"), "query_id").alias("query_id"), "rank", (F.col("tmtid").cast("bigint") + 3000000000000000000).cast("string").alias("node_id"))
    ranked = rv.rerank(found, fx.templated(spark, d), fx.catalogue(spark, d).nodes, 3, rv.model_score(load_trigrams))
    return ranked.select(F.substring("query_id", 3, 20).alias("query_id"), "node_id", F.round("rerank_score", 6).alias("rerank_score"), "new_rank")


@registered("r15_answer_cache_join", """
    WITH asked AS (SELECT vec_id AS query_id, 'what is ' || CASE WHEN vec_id % 10 = 0 THEN vec_id // 20 ELSE -vec_id END AS question, embedding FROM embeddings WHERE vec_id % 5 = 0),
    cache AS (SELECT vec_id AS cache_id, 'what is ' || (vec_id // 20) AS question, embedding FROM embeddings WHERE vec_id % 5 <> 0),
    exact AS (SELECT a.query_id, min(c.cache_id) AS cache_id FROM asked a JOIN cache c USING (question) GROUP BY a.query_id)
    SELECT query_id, cache_id, 'exact' AS kind, 1.0 AS score FROM exact
    UNION ALL SELECT query_id, cache_id, 'semantic', round(s, 6) FROM (SELECT a.query_id, c.cache_id, round(list_cosine_similarity(a.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS s
      FROM asked a, cache c WHERE a.query_id NOT IN (SELECT query_id FROM exact) QUALIFY row_number() OVER (PARTITION BY a.query_id ORDER BY s DESC, c.cache_id) = 1) WHERE s >= 0.3""")
def r15(spark, d):
    e = fx.table(spark, d, "embeddings")
    i = F.col("vec_id")
    block = F.floor(i / 20).cast("bigint")
    asked = e.where("vec_id % 5 = 0").select(i.alias("query_id"), F.concat(F.lit("what is "), F.when(i % 10 == 0, block).otherwise(-i).cast("string")).alias("question"), "embedding")
    cache = e.where("vec_id % 5 <> 0").select(i.alias("cache_id"), F.concat(F.lit("what is "), block.cast("string")).alias("question"), "embedding")
    return rv.answer_cache_join(asked, cache, 0.3).withColumn("score", F.round("score", 6))
