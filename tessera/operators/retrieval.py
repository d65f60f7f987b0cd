"""Ranked retrieval: exact, vector, text and graph channels, and their fusion.

A *request* is one search: query_id, text, levels, f_nlem, f_nlem_category,
f_manufacturer, f_tmtid (see ``filters``), seed_terms, v_weight, t_weight,
g_weight, strategy, k, hops. Many requests are answered in one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import lexicon as lx
from ..functions.fulltext import bm25_topk
from ..functions.matching import contains_join
from ..functions.members import keep_members, likely_members
from ..functions.ranking import first_per_key, top_k
from ..functions.text import folded, haystack, ordered_distinct, squash
from ..functions.vectors import score_topk
from ..schema import ANCHOR_LEVEL_ORDER, CONTAINS_COLUMNS, NO_RANK
from ..session import materialise
from ..sources.catalogue import Catalogue, fetch_nodes, neighbours_of
from .filters import REQUEST_FILTERS, passes_filters
from .understanding import fulltext_terms

RRF_OFFSET = 60
PATH_CAP = 80
MAX_HOPS = 3
FILTER_COLUMNS = ("level", "nlem", "nlem_category", "manufacturer", "tmtid")


def channel_k(k: Column) -> Column:
    return F.greatest(k * 2, F.lit(12))


def longest_channel(requests: DataFrame) -> int:
    """Longest list any of the requests asks a channel for.

    A literal bound lets Spark trim each partition before it shuffles; each
    request is then cut at its own length.
    """
    return max(12, 2 * (requests.agg(F.max("k")).first()[0] or 0))


# ---------------------------------------------------------------- exact channel
def exact_match_topk(requests: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(query_id, node_id, pri, delta, exact_rank): literal matches, equal before prefix before contained."""
    asked = requests.withColumn("term", F.lower(squash("text"))).where(F.length("term") >= 3)
    texts = nodes.withColumn("hay", haystack(CONTAINS_COLUMNS))
    found = contains_join(asked.select("term").distinct(), texts)
    names = ("fsn", "trade_name", "name", "generic_name")
    equal = prefix = F.lit(False)
    for name in names:
        equal = equal | (folded(name) == F.col("term"))
        prefix = prefix | F.startswith(folded(name), F.col("term"))
    length = F.length(F.coalesce(*names, F.lit("")))
    hits = (
        found.withColumn("pri", F.when(equal, 0).when(prefix, 1).otherwise(2))
        .withColumn("delta", F.abs(length - F.length("term")))
        .select("term", "node_id", "pri", "delta", *FILTER_COLUMNS)
        .join(asked.select("query_id", "term", *REQUEST_FILTERS), "term")
        .where(passes_filters()))
    return top_k(hits, ["query_id"], [F.col("pri"), F.col("delta"), F.col("node_id")], k, "exact_rank", first=0).select(
        "query_id", "node_id", "pri", "delta", "exact_rank")


# ---------------------------------------------------------------- vector channel
def vector_topk(requests: DataFrame, vectors: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(query_id, node_id, v_score, v_rank): cosine top k over all vectors, then the filters."""
    corpus = nodes.where("embedding_vec is not null").select("node_id", F.col("embedding_vec").alias("embedding"))
    best = score_topk(corpus, "node_id", vectors, "query_id", k)
    facts = nodes.where("embedding_vec is not null").select("node_id", *FILTER_COLUMNS)
    kept = (
        materialise(best, "vector_hits").join(facts, "node_id")
        .join(requests.select("query_id", *REQUEST_FILTERS), "query_id").where(passes_filters()))
    return rank_again(kept, "v").select("query_id", "node_id", F.col("score").alias("v_score"), "v_rank")


def rank_again(kept: DataFrame, prefix: str) -> DataFrame:
    """0-based rank of the rows a post-filter left; at most the channel's length per query."""
    window = Window.partitionBy("query_id").orderBy("rank")
    return kept.withColumn(f"{prefix}_rank", F.row_number().over(window) - 1)


# ---------------------------------------------------------------- text channel
def fulltext_topk(texts: DataFrame, cat: Catalogue, k: int) -> DataFrame:
    """(text, node_id, score, rank): BM25 top k over the text index for each distinct ``text``.

    A term with a blank in it is a phrase: its words must stand side by side.
    """
    terms = materialise(
        fulltext_terms(texts.select("text").distinct(), "text")
        .select("text", F.explode("terms").alias("term"))
        .select("text", F.trim(F.regexp_replace(F.lower("term"), r"[^\p{L}\p{M}\p{N}]+", " ")).alias("term"),
                F.contains(F.trim("term"), F.lit(" ")).alias("phrase"))
        .select("text", F.explode(F.when(F.col("phrase"), F.array("term")).otherwise(F.split("term", " "))).alias("term"))
        .where("term <> ''").distinct(), "text_terms")
    return bm25_topk(terms, cat.documents, cat.n_docs, cat.mean_len, k)


def fulltext_channel(requests: DataFrame, hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """The text hits of each request that pass its filters, ranked again from 0."""
    asked = requests.select("query_id", F.col("text"), channel_k(F.col("k")).alias("n"), *REQUEST_FILTERS)
    near = hits.join(asked, "text").where(F.col("rank") <= F.col("n"))
    facts = nodes.select("node_id", *FILTER_COLUMNS)
    return rank_again(near.join(likely_members(facts, "node_id", hits), "node_id").where(passes_filters()), "t").select(
        "query_id", "node_id", F.col("score").alias("t_score"), "t_rank")


# ---------------------------------------------------------------- graph channel
def seed_terms(requests: DataFrame) -> DataFrame:
    """(query_id, term_no, text, term): at most four distinct anchor terms per request."""
    raw = F.concat(
        F.array(squash("text")), F.transform(F.coalesce("seed_terms", F.array().cast("array<string>")), squash),
        F.array(squash("text"), squash("f_manufacturer"), squash("f_tmtid")))
    terms = F.slice(ordered_distinct(F.filter(raw, lambda t: F.length(t) >= 2)), 1, lx.SEED_TERM_LIMIT)
    return requests.select("query_id", F.posexplode(terms).alias("term_no", "text")).withColumn("term", F.lower("text"))


def _level_rank() -> Column:
    rank = F.lit(len(ANCHOR_LEVEL_ORDER) + 1)
    for i, level in enumerate(ANCHOR_LEVEL_ORDER):
        rank = F.when(F.col("level") == level, i + 1).otherwise(rank)
    return rank


def graph_anchors(requests: DataFrame, cat: Catalogue, hits: DataFrame, limit: int) -> DataFrame:
    """(query_id, node_id, score, rank, place): the nodes a graph walk starts from.

    ``hits`` are text hits of every seed term. A term without any falls back to
    literal matches; manufacturer and id filters add anchors of their own.
    """
    bound = materialise(requests.select("query_id", F.greatest(F.lit(8), channel_k(F.col("k"))).alias("n"),
                                        F.lower("f_manufacturer").alias("maker"), F.trim("f_tmtid").alias("id")),
                        "anchor_bounds")
    terms = materialise(seed_terms(requests).join(bound.select("query_id", "n"), "query_id"), "seed_terms")
    by_text = hits.join(terms.select("query_id", "term_no", "text", "n"), "text").where(F.col("rank") <= F.col("n")).select(
        "query_id", "node_id", "score", (F.col("rank") - 1).alias("rank"), F.col("term_no").alias("source"))

    bare = terms.join(hits.select("text").distinct(), "text", "left_anti")
    texts = cat.nodes.select(
        "node_id", _level_rank().alias("lv"), F.coalesce("trade_name", "fsn", "name").alias("shown"),
        haystack((*CONTAINS_COLUMNS, "manufacturer")).alias("hay"), folded("tmtid").alias("id"))
    wanted = materialise(bare.select("term").distinct(), "bare_terms")
    literal = (contains_join(wanted, texts).select("term", "node_id", "lv", "shown")
               .unionByName(texts.join(wanted.select(F.col("term").alias("id")), "id")
                            .where(~F.contains("hay", "id"))
                            .select(F.col("id").alias("term"), "node_id", "lv", "shown")))
    nearest = top_k(literal, ["term"], [F.col("lv"), F.col("shown"), F.col("node_id")], limit, first=0)
    by_literal = nearest.join(bare, "term").where(F.col("rank") < F.col("n")).select(
        "query_id", "node_id", (F.lit(200.0) - F.col("rank")).alias("score"), "rank", F.col("term_no").alias("source"))

    makers = cat.nodes.where("level in ('TP', 'TPU') and manufacturer is not null").select(
        "node_id", folded("manufacturer").alias("maker_name"))
    maker_terms = bound.where("maker <> ''").select(F.col("maker").alias("term")).distinct()
    by_name = contains_join(maker_terms, makers.select("maker_name").distinct(), text="maker_name", key="maker_name")
    products = top_k(makers.join(by_name, "maker_name"), ["term"], [F.col("node_id")], limit, first=0)
    by_maker = products.join(bound.withColumnRenamed("maker", "term"), "term").where(F.col("rank") < F.col("n")).select(
        "query_id", "node_id", (F.lit(350.0) - F.col("rank")).alias("score"), "rank", F.lit(90).alias("source"))

    by_id = top_k(cat.nodes.select("node_id", F.col("tmtid").alias("id")).join(bound.where("id <> ''"), "id"),
                  ["query_id"], [F.col("node_id")], 3).select(
        "query_id", "node_id", F.lit(999.0).alias("score"), F.lit(0).alias("rank"), F.lit(91).alias("source"))

    pool = by_text.unionByName(by_literal).unionByName(by_maker).unionByName(by_id)
    best = pool.groupBy("query_id", "node_id").agg(F.max_by(
        F.struct("score", "rank"), F.struct("score", -F.col("source"))).alias("b")).select(
        "query_id", "node_id", "b.score", "b.rank")
    placed = top_k(best, ["query_id"], [F.desc("score"), F.col("rank"), F.col("node_id")], limit, "place")
    return placed.join(bound.select("query_id", "n"), "query_id").where(F.col("place") <= F.col("n")).drop("n")


def nearest_ends(requests: DataFrame, anchors: DataFrame, cat: Catalogue, hops: int) -> DataFrame:
    """(query_id, node_id, hop): the nodes that pass each request's filters, hop by hop from its anchors.

    A request goes no further than the hop that fills its list, for nodes beyond
    it rank behind. Of each hop only distinct (request, node) rows are kept.
    """
    asked = materialise(requests.select("query_id", "hops", channel_k(F.col("k")).alias("n"), *REQUEST_FILTERS), "walk_requests")
    near = cat.links.select("node_id", "other_id")
    facts = cat.nodes.select("node_id", *FILTER_COLUMNS)
    front = reached = materialise(anchors.select("query_id", "node_id").distinct(), "walk_0")
    ends = None
    for hop in range(hops + 1):
        passed = materialise(front.join(likely_members(facts, "node_id", front), "node_id").join(asked, "query_id").where(passes_filters())
                             .select("query_id", "node_id", F.lit(hop).alias("hop")), f"ends_{hop}")
        ends = passed if ends is None else ends.unionByName(passed)
        if hop == hops:
            return ends
        found = ends.groupBy("query_id").agg(F.count(F.lit(1)).alias("found"))
        hungry = asked.join(found, "query_id", "left").where((F.coalesce("found", F.lit(0)) < F.col("n")) & (F.col("hops") > hop)).select("query_id")
        going = materialise(front.join(hungry, "query_id"), f"walk_from_{hop}").select("query_id", "node_id")
        beside = going.join(likely_members(near, "node_id", going), "node_id").select("query_id", F.col("other_id").alias("node_id")).distinct()
        front = materialise(beside.join(reached, ["query_id", "node_id"], "left_anti"), f"walk_{hop + 1}")
        reached = reached.unionByName(front)


def trail_counts(ends: DataFrame, starts: DataFrame, adjacency: DataFrame, hops: int) -> DataFrame:
    """(query_id, node_id, support): undirected trails of up to the request's ``hops`` edges from its anchors into each of its ends.

    A trail uses no edge twice. Trails are counted, not listed, and only those
    into the ends: the steps that leave the anchors meet those that enter an end
    in the middle. Walks are summed per (request, node), and the walks that
    repeat an edge are taken off in closed form, from node degrees and the number
    of edges between two nodes. No edge joins a node to itself.
    ``ends`` and ``starts`` carry ``hops``, 0 to 3; larger numbers are refused.
    """
    if hops > MAX_HOPS:
        raise ValueError(f"walks are counted to {MAX_HOPS} hops")
    keys = ["query_id", "node_id"]
    near = adjacency.select("node_id", "other_id", "n")
    begun = starts.where("hops >= 1").join(near, "node_id")
    m = F.col("n")
    sums = [F.sum(m).alias("m")]
    if hops >= 3:
        degree = near.join(starts.select("node_id").distinct(), "node_id").groupBy("node_id").agg(F.sum("n").alias("degree"))
        begun = begun.join(degree, "node_id")
        sums.append(F.sum(m * F.col("degree") + m * m - 2 * m).alias("repeated"))
    one = materialise(begun.groupBy("query_id", F.col("other_id").alias("node_id")).agg(*sums), "walk_sums")
    counted = ends.select(*keys, "hops").join(starts.select(*keys, F.lit(1).alias("own")), keys, "left").join(one, keys, "left")
    support = F.coalesce("own", F.lit(0)) + F.coalesce("m", F.lit(0))
    if hops >= 2:
        # (query_id, node_id, mid): the last step of every walk into an end.
        last = ends.where("hops >= 2").select(*keys, "hops").join(near, "node_id").withColumnRenamed("other_id", "mid")
        middle = one.select("query_id", F.col("node_id").alias("mid"), F.col("m").alias("mid_m"))
        two = last.join(middle, ["query_id", "mid"], "left").groupBy(*keys).agg(
            F.sum(m * F.coalesce("mid_m", F.lit(0))).alias("walks_2"), F.sum(m).alias("end_degree"))
        counted = counted.join(two, keys, "left")
        support = support + F.coalesce(F.col("walks_2") - F.when(F.col("own") == 1, F.col("end_degree")).otherwise(0), F.lit(0))
    if hops >= 3:
        before = (last.where("hops >= 3").select(*keys, F.col("mid").alias("next_id"), F.col("n").alias("last_n"))
                  .join(near.withColumnRenamed("node_id", "next_id"), "next_id").withColumnRenamed("other_id", "mid")
                  .groupBy(*keys, "mid").agg(F.sum(m * F.col("last_n")).alias("ways")))
        three = before.join(middle, ["query_id", "mid"]).groupBy(*keys).agg(F.sum(F.col("ways") * F.col("mid_m")).alias("walks_3"))
        counted = counted.join(three, keys, "left")
        taken = F.coalesce(F.col("repeated") + F.col("m") * F.col("end_degree"), F.lit(0))
        support = support + F.when(F.col("hops") >= 3, F.coalesce("walks_3", F.lit(0)) - taken).otherwise(0)
    return counted.select(*keys, support.alias("support"))


def _adjacency(ends: DataFrame, starts: DataFrame, cat: Catalogue, hops: int) -> DataFrame:
    """The neighbour counts that ``trail_counts`` reads: of anchors, of ends two hops off, and at three hops of the ends' neighbours."""
    far = lambda least: ends.where(F.col("hops") >= least).select("node_id").distinct()
    wanted = materialise(starts.select("node_id").unionByName(far(2)).distinct(), "counted_nodes")
    near = materialise(neighbours_of(wanted, cat.links), "neighbours")
    if hops < 3:
        return near
    beside = near.join(far(3), "node_id").select(F.col("other_id").alias("node_id")).distinct()
    more = materialise(beside.join(wanted, "node_id", "left_anti"), "counted_beside")
    return near.unionByName(materialise(neighbours_of(more, cat.links), "neighbours"))


def graph_score(hop: Column, support: Column) -> Column:
    return F.lit(1.0) / (hop + 1) + F.least(F.lit(0.45), F.log1p(support) / 6.0)


def traverse(requests: DataFrame, anchors: DataFrame, cat: Catalogue, limit: int) -> DataFrame:
    """(query_id, node_id, graph_hop, graph_support, g_score, g_rank): nodes around each request's anchors."""
    hops = requests.agg(F.max("hops")).first()[0] or 1
    if hops > MAX_HOPS:
        raise ValueError(f"walks are counted to {MAX_HOPS} hops")
    own_hops = materialise(requests.select("query_id", "hops", "k"), "walk_hops")
    starts = materialise(anchors.select("query_id", "node_id").distinct().join(own_hops, "query_id"), "anchors")
    ends = materialise(nearest_ends(requests, starts, cat, hops).join(own_hops, "query_id"), "walk_ends")
    counted = trail_counts(ends, starts, _adjacency(ends, starts, cat, hops), hops)
    kept = ends.join(counted, ["query_id", "node_id"]).select(
        "query_id", "node_id", "k", F.col("hop").alias("graph_hop"), F.col("support").alias("graph_support"))
    best = top_k(kept, ["query_id"], [F.col("graph_hop"), F.desc("graph_support"), F.col("node_id")], limit,
                 "g_rank", first=0)
    return best.where(F.col("g_rank") < channel_k(F.col("k"))).select(
        "query_id", "node_id", "graph_hop", "graph_support",
        graph_score(F.col("graph_hop"), F.col("graph_support")).alias("g_score"), "g_rank")


# ---------------------------------------------------------------- weights and fusion
def normalised_weights(v: Column, t: Column, g: Column) -> Column:
    v, t, g = (F.greatest(F.lit(0.0), w) for w in (v, t, g))
    total = v + t + g
    third = F.lit(1.0 / 3.0)
    flat = total <= 1e-9
    return F.struct(F.when(flat, third).otherwise(v / total).alias("v_weight"),
                    F.when(flat, third).otherwise(t / total).alias("t_weight"),
                    F.when(flat, third).otherwise(g / total).alias("g_weight"))


def channel_weights(strategy: Column, target: Column, v: Column, t: Column, override: Column) -> Column:
    """Struct (v_weight, t_weight, g_weight): the graph's share by strategy, the rest split v:t."""
    base = (F.when(strategy.isin("verify", "compare", "list"), 0.35)
            .when(strategy.isin("count", "id_lookup"), 0.20).otherwise(0.28))
    base = base + F.when(target.isin("hierarchy", "substance", "manufacturer"), 0.05).otherwise(0.0)
    default = F.greatest(F.lit(0.15), F.least(F.lit(0.55), base))
    g = F.when(override.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(0.9), override))).otherwise(default)
    v, t = F.greatest(F.lit(0.0), v), F.greatest(F.lit(0.0), t)
    flat = (v + t) <= 1e-9
    v, t = F.when(flat, 0.5).otherwise(v), F.when(flat, 0.5).otherwise(t)
    rest = F.greatest(F.lit(0.0), 1 - g)
    return normalised_weights(rest * v / (v + t), rest * t / (v + t), g)


def rrf(rank: Column) -> Column:
    return F.when(rank >= NO_RANK, 0.0).otherwise(F.lit(1.0) / (RRF_OFFSET + 1 + rank))


def fuse_rrf(vector: DataFrame, text: DataFrame, graph: DataFrame, requests: DataFrame, limit: int) -> DataFrame:
    """Candidates of the three channels, fused by weighted reciprocal rank and cut at each request's k."""
    def channel(df: DataFrame, p: str, *extra: str) -> DataFrame:
        empty = {"v": F.lit(None), "t": F.lit(None), "g": F.lit(None)}
        empty[p] = F.struct(f"{p}_rank", f"{p}_score")
        cols = [("v", "v_rank"), ("t", "t_rank"), ("g", "g_rank")]
        return df.select(
            "query_id", "node_id",
            *[(F.col(r) if q == p else F.lit(None).cast("int")).alias(r) for q, r in cols],
            *[(F.col(f"{q}_score") if q == p else F.lit(None).cast("double")).alias(f"{q}_score") for q in "vtg"],
            *[(F.col(c) if p == "g" else F.lit(None).cast(t)).alias(c)
              for c, t in (("graph_hop", "int"), ("graph_support", "bigint"))])

    merged = channel(vector, "v").unionByName(channel(text, "t")).unionByName(channel(graph, "g"))
    ranks = [F.coalesce(F.min(r), F.lit(NO_RANK)).alias(r) for r in ("v_rank", "t_rank", "g_rank")]
    scores = [F.coalesce(F.max(s), F.lit(0.0)).alias(s) for s in ("v_score", "t_score", "g_score")]
    joined = merged.groupBy("query_id", "node_id").agg(
        *ranks, *scores, F.min("graph_hop").alias("graph_hop"), F.max("graph_support").alias("graph_support"))
    weights = requests.select("query_id", "k", normalised_weights(
        F.col("v_weight"), F.col("t_weight"), F.col("g_weight")).alias("w"))
    scored = joined.join(weights, "query_id").withColumn("rrf_score", F.round(
        F.col("w.v_weight") * rrf(F.col("v_rank")) + F.col("w.t_weight") * rrf(F.col("t_rank"))
        + F.col("w.g_weight") * rrf(F.col("g_rank")), 12)).drop("w")
    order = [F.desc("rrf_score"), F.col("v_rank"), F.col("t_rank"), F.col("g_rank"), F.col("node_id")]
    return top_k(scored, ["query_id"], order, limit, "fused_rank").where(
        F.col("fused_rank") <= F.greatest(F.lit(1), F.col("k"))).drop("k")


def hybrid_search(requests: DataFrame, cat: Catalogue, vectors: DataFrame | None = None) -> DataFrame:
    """All three channels for every request, fused.

    ``vectors`` holds ``embedding`` per ``text`` or per ``query_id``.
    """
    limit = longest_channel(requests)
    hits = text_hits(requests, cat, limit)
    text = fulltext_channel(requests, hits, cat.nodes)
    graph = traverse(requests, graph_anchors(requests, cat, hits, limit), cat, limit)
    if vectors is None:
        vector = text.limit(0).select("query_id", "node_id", F.col("t_score").alias("v_score"), F.col("t_rank").alias("v_rank"))
    else:
        vector = vector_channel(requests, vectors, cat.nodes, limit)
    return fuse_rrf(vector, text, graph, requests, limit)


def vector_channel(requests: DataFrame, vectors: DataFrame, nodes: DataFrame, limit: int) -> DataFrame:
    """As ``vector_topk``, cut at each request's own channel length; a text that many requests share is compared once."""
    key = "text" if "text" in vectors.columns else "query_id"
    corpus = nodes.where("embedding_vec is not null").select("node_id", F.col("embedding_vec").alias("embedding"))
    best = materialise(score_topk(corpus, "node_id", vectors, key, limit), "vector_hits")
    facts = nodes.where("embedding_vec is not null").select("node_id", *FILTER_COLUMNS)
    asked = requests.select("query_id", "text", channel_k(F.col("k")).alias("n"), *REQUEST_FILTERS)
    kept = (
        best.join(asked, key).where(F.col("rank") <= F.col("n")).join(likely_members(facts, "node_id", best), "node_id").where(passes_filters()))
    return rank_again(kept, "v").select("query_id", "node_id", F.col("score").alias("v_score"), "v_rank")


def text_hits(requests: DataFrame, cat: Catalogue, limit: int) -> DataFrame:
    """Text hits of every request text and seed term, found once and stored."""
    texts = requests.select("text").unionByName(seed_terms(requests).select("text")).distinct()
    return materialise(fulltext_topk(texts, cat, limit), "text_hits")


# ---------------------------------------------------------------- variants, boosts
def exact_boost(rank: Column) -> Column:
    return F.when(rank == 0, 0.45).otherwise(F.greatest(F.lit(0.15), 0.35 - rank * 0.02))


_FOUND = ("v_rank", "t_rank", "g_rank", "graph_hop", "graph_support", "found_by_query")


def merge_query_variants(candidates: DataFrame, exact: DataFrame | None, k: Column | int) -> DataFrame:
    """One ranked list per question from the candidates of its variants, taken in order.

    ``candidates`` and ``exact`` carry ``variant_no`` and ``found_by_query``. A variant's candidate takes a node's place if it scores
    more than the node has by then, boosts included; it brings its own ranks. After it the variant's exact match adds its boost, or enters the
    node on the boost alone. A node's steps are at most two per variant and are folded where they meet.
    """
    step = lambda df, kind, score, rank: df.select("query_id", "node_id", F.struct(
        F.col("variant_no").cast("int").alias("variant_no"), F.lit(kind).alias("kind"), rank.cast("int").alias("exact_rank"), score.cast("double").alias("score"),
        *(F.col(c) if c in df.columns else F.lit(NO_RANK if c.endswith("_rank") else None).cast("bigint").alias(c) for c in _FOUND)).alias("step"))
    kinds = {"v_rank": "bigint", "t_rank": "bigint", "g_rank": "bigint", "graph_hop": "bigint", "graph_support": "bigint", "found_by_query": "string"}
    steps = step(candidates.withColumns({c: F.col(c).cast(kind) for c, kind in kinds.items()}), 0, F.col("rrf_score"), F.lit(NO_RANK))
    if exact is not None:
        steps = steps.unionAll(step(exact.select("query_id", "node_id", "variant_no", "found_by_query", "exact_rank"), 1,
                                    exact_boost(F.col("exact_rank")), F.col("exact_rank")))

    def fold(state: Column, now: Column) -> Column:
        new, boost = state.isNull(), now["kind"] == 1
        replace = new | (~boost & (now["score"] > state["score"]))
        score = F.when(replace, now["score"]).when(boost, state["score"] + now["score"]).otherwise(state["score"])
        rank = F.when(replace, now["exact_rank"]).otherwise(F.least(state["exact_rank"], now["exact_rank"]))
        return F.struct(score.alias("score"), rank.alias("exact_rank"), *(F.when(replace, now[c]).otherwise(state[c]).alias(c) for c in _FOUND))

    start = F.lit(None).cast("struct<score:double,exact_rank:int," + ",".join(f"{c}:{kinds[c]}" for c in _FOUND) + ">")
    folded_steps = steps.groupBy("query_id", "node_id").agg(F.aggregate(F.array_sort(F.collect_list("step")), start, fold).alias("s"))
    merged = folded_steps.select(
        "query_id", "node_id", *(F.col(f"s.{r}").cast("int").alias(r) for r in ("v_rank", "t_rank", "g_rank", "exact_rank")),
        F.col("s.graph_hop").cast("int").alias("graph_hop"), F.col("s.graph_support").alias("graph_support"), F.round("s.score", 12).alias("rrf_score"),
        F.col("s.found_by_query").alias("found_by_query"))
    order = [F.desc("rrf_score"), F.col("v_rank"), F.col("t_rank"), F.col("g_rank"), F.col("exact_rank"), F.col("node_id")]
    return top_k(merged, ["query_id"], order, k)


# ---------------------------------------------------------------- context around the seeds
@dataclass
class Expansion:
    """Paths around the seeds: the distinct nodes with ``is_seed`` and the distinct relationships."""

    nodes: DataFrame
    relationships: DataFrame


def expand_context(seeds: DataFrame, cat: Catalogue, depth: int = 2, cap: int | None = PATH_CAP) -> Expansion:
    """Undirected trails of 1 to ``depth`` edges from the seeds, all of them or the first ``cap`` per question.

    A ``depth`` column of the seeds sets the depth question by question, up to ``depth``.
    Paths come in the order (seed rank, hop, edges). Under a cap no more than ``cap`` trails per question go on to the next hop, and
    only such as lead on, and every node's links are first trimmed to the ones that order can reach: a node with a billion links sends a short list.
    """
    if "depth" not in seeds.columns:
        seeds = seeds.withColumn("depth", F.lit(depth))
    seeds = materialise(seeds.select("query_id", "node_id", "rank", "depth"), "expand_seeds")
    near = cat.links.select("node_id", "edge_id", "other_id")

    def first(rows: DataFrame, keys: list[str], order: list[Column], n: int | None, name: str = "_r") -> DataFrame:
        if n is not None:
            return top_k(rows, keys, order, n, name)
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))

    front = seeds.select("query_id", "rank", "depth", F.array("node_id").alias("stops"), F.array().cast("array<string>").alias("steps"))
    paths = None
    for hop in range(1, depth + 1):
        last = front.withColumn("node_id", F.element_at("stops", -1)).where(F.col("depth") >= hop)
        # A trail takes no edge twice, so up to hop - 1 of a node's links may be taken already.
        at = materialise(last.select("node_id").distinct(), f"expand_at_{hop}")
        reach = first(keep_members(near, "node_id", at), ["node_id"], [F.col("edge_id")], None if cap is None else cap + hop - 1).drop("_r")
        walked = last.join(reach, "node_id").where(~F.array_contains("steps", F.col("edge_id"))).select(
            "query_id", "rank", "depth", F.concat("stops", F.array("other_id")).alias("stops"), F.concat("steps", F.array("edge_id")).alias("steps"))
        walked = walked.withColumn("hop", F.lit(hop))
        if hop < depth:
            walked = materialise(walked, f"walked_{hop}")
            # Those that lead on: their end has more edges than the trail has taken of it. A trail's own edges at its end are those beside it in ``stops``.
            ends = walked.where(F.col("depth") > hop).withColumn("node_id", F.element_at("stops", -1))
            reached = materialise(ends.select("node_id").distinct(), f"expand_to_{hop}")
            degree = keep_members(near.select("node_id"), "node_id", reached).groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))
            taken = F.aggregate(F.sequence(F.lit(1), F.size("steps")), F.lit(0), lambda acc, i: acc + F.when(
                (F.element_at("stops", i) == F.col("node_id")) | (F.element_at("stops", i + 1) == F.col("node_id")), 1).otherwise(0))
            front = ends.join(degree, "node_id").where(F.col("degree") > taken).drop("node_id", "degree", "hop")
            if cap is not None:
                front = first(front, ["query_id"], [F.col("rank"), F.col("steps")], cap).drop("_r")
        paths = walked if paths is None else paths.unionByName(walked)
    kept = materialise(first(paths, ["query_id"], [F.col("rank"), F.col("hop"), F.col("steps")], cap, "path_no"), "paths")
    found = (
        kept.select("query_id", "path_no", F.posexplode("stops").alias("step", "node_id"))
        .groupBy("query_id", "node_id").agg(F.min(F.struct("path_no", "step")).alias("o")))
    marked = found.join(seeds.select("query_id", "node_id", F.lit(True).alias("is_seed")), ["query_id", "node_id"], "left")
    nodes = marked.select("query_id", "node_id", F.coalesce("is_seed", F.lit(False)).alias("is_seed"),
                          (F.col("o.path_no") * 10 + F.col("o.step")).alias("found_at"))
    used = materialise(
        kept.select("query_id", "path_no", F.posexplode("steps").alias("step", "edge_id"))
        .groupBy("query_id", "edge_id").agg(F.min(F.struct("path_no", (F.col("step") + 1).alias("step"))).alias("o")), "used_links")
    named = F.coalesce("name", "fsn", "trade_name", F.lit("Unknown"))
    ends = materialise(used.join(likely_members(cat.edges, "edge_id", used), "edge_id"), "used_edges")
    touched = materialise(ends.select(F.explode(F.array("src_id", "dst_id")).alias("node_id")).distinct(), "used_nodes")
    label = fetch_nodes(touched, likely_members(cat.nodes.select("node_id", "level", named.alias("shown")), "node_id", touched))
    relationships = (
        ends.join(label.select(F.col("node_id").alias("src_id"), F.col("level").alias("start_level"), F.col("shown").alias("start_name")), "src_id")
        .join(label.select(F.col("node_id").alias("dst_id"), F.col("level").alias("end_level"), F.col("shown").alias("end_name")), "dst_id")
        .select("query_id", F.col("src_id").alias("start_id"), "type", F.col("dst_id").alias("end_id"),
                "start_level", "start_name", "end_level", "end_name",
                (F.col("o.path_no") * 10 + F.col("o.step")).alias("found_at"))
        .groupBy("query_id", "start_id", "type", "end_id")
        .agg(F.min("found_at").alias("found_at"), *[F.min(c).alias(c) for c in ("start_level", "start_name", "end_level", "end_name")]))
    return Expansion(nodes, relationships)


# ---------------------------------------------------------------- the general search
#: Vectors to search with: ``embedding`` per ``query_id``, or a function that embeds a table of distinct ``text``.
Vectors = DataFrame | Callable[[DataFrame], DataFrame]


def search_general(requests: DataFrame, cat: Catalogue, vectors: Vectors | None = None,
                   variants: DataFrame | None = None) -> DataFrame:
    """Ranked seeds of every request: hybrid search, exact boosts on lookups, one list per request.

    ``variants`` (query_id, variant_no, text) replaces the request text by
    several phrasings. Each request is searched to max(8, k) and keeps max(3k, 24).
    Where ``vectors`` is a function every text searched has a vector of its own;
    it gets the distinct texts and returns ``text, embedding``.
    """
    asked = requests.withColumn("k", F.greatest(F.lit(8), F.col("k")))
    if variants is None:
        variants = asked.select("query_id", F.lit(1).alias("variant_no"), squash("text").alias("text"))
    sub = F.concat_ws("#", "query_id", F.col("variant_no").cast("string"))
    searches = materialise(asked.drop("text").join(variants, "query_id").withColumn("parent", F.col("query_id"))
                           .withColumn("query_id", sub), "searches")
    limit = longest_channel(searches)
    back = searches.select("query_id", "parent", "variant_no", F.col("text").alias("found_by_query"))
    if callable(vectors):
        sub_vectors = materialise(vectors(searches.select("text").distinct()).select("text", "embedding"), "text_vectors")
    else:
        sub_vectors = None if vectors is None else vectors.join(
            searches.select(F.col("query_id").alias("sub"), F.col("parent").alias("query_id")), "query_id").select(
            F.col("sub").alias("query_id"), "embedding")
    found = hybrid_search(searches, cat, sub_vectors)
    candidates = found.join(back, "query_id").drop("query_id").withColumnRenamed("parent", "query_id")
    lookups = searches.where("strategy = 'lookup'")
    exact = exact_match_topk(lookups, cat.nodes, limit).join(
        searches.select("query_id", "k"), "query_id").where(F.col("exact_rank") < F.col("k")).join(
        back, "query_id").drop("query_id").withColumnRenamed("parent", "query_id")
    merged = merge_query_variants(candidates, exact, max(24, 2 * limit))
    caps = requests.select("query_id", F.greatest(F.col("k") * 3, F.lit(24)).alias("cap"))
    return merged.join(caps, "query_id").where(F.col("rank") <= F.col("cap")).drop("cap")


def route_plans(requests: DataFrame, seeds: DataFrame) -> DataFrame:
    """How each request was searched and what it found, one row per request.

    (query_id, query, filters, allowed_levels, vector_weight, fulltext_weight,
    graph_weight, depth, seed_count, channel_hits); the hits are null where nothing was found.
    """
    weights = normalised_weights(F.col("v_weight"), F.col("t_weight"), F.col("g_weight"))
    hits = channel_hits(seeds).select("query_id", F.struct("vector", "fulltext", "graph", "exact").alias("channel_hits"))
    sizes = seeds.groupBy("query_id").agg(F.count(F.lit(1)).alias("seed_count"))
    return (
        requests.withColumn("_w", weights).join(sizes, "query_id", "left").join(hits, "query_id", "left")
        .select("query_id", squash("text").alias("query"),
                F.struct(*(F.col(f"f_{c}").alias(c) for c in ("nlem", "nlem_category", "manufacturer", "tmtid"))).alias("filters"),
                F.coalesce("levels", F.array().cast("array<string>")).alias("allowed_levels"), F.col("_w.v_weight").alias("vector_weight"),
                F.col("_w.t_weight").alias("fulltext_weight"), F.col("_w.g_weight").alias("graph_weight"), F.col("hops").alias("depth"),
                F.coalesce("seed_count", F.lit(0)).cast("bigint").alias("seed_count"), "channel_hits"))


def channel_hits(seeds: DataFrame) -> DataFrame:
    """Per question, how many seeds each channel returned."""
    return seeds.groupBy("query_id").agg(*[
        F.count_if(F.col(r) < NO_RANK).alias(name) for r, name in (
            ("v_rank", "vector"), ("t_rank", "fulltext"), ("g_rank", "graph"), ("exact_rank", "exact"))])


def merge_first(groups: DataFrame) -> DataFrame:
    """Concatenate ranked groups (query_id, group_no, rank, node_id) and keep each node's first place."""
    firsts = first_per_key(groups, ["query_id", "node_id"], [F.col("group_no"), F.col("rank")])
    window = Window.partitionBy("query_id").orderBy("group_no", "rank")  # a few capped lists per question
    return firsts.withColumn("merged_rank", F.row_number().over(window))


# ---------------------------------------------------------------- reranking, answer cache
def overlap_score(question: Column, text: Column) -> Column:
    """Share of the question's distinct words found in the text; the default pair score."""
    from ..functions.text import index_tokens
    q, t = F.array_distinct(index_tokens(question)), index_tokens(text)
    return F.coalesce(F.size(F.array_intersect(q, t)) / F.nullif(F.size(q), F.lit(0)), F.lit(0.0))


def model_score(load: Callable[[], Callable[[pd.Series, pd.Series], np.ndarray]]) -> Callable[[Column, Column], Column]:
    """A pair score for ``rerank`` from a model: ``load`` runs once per task and returns a function of a batch of questions and texts.

    Batches come by Arrow, so the model scores thousands of pairs a call; what
    it needs is loaded where it runs and never shipped with the plan.
    """
    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for questions, texts in batches:
            yield pd.Series(model(questions, texts), dtype="float64")

    return score


def rerank(candidates: DataFrame, questions: DataFrame, nodes: DataFrame, k: int, score=overlap_score) -> DataFrame:
    """Order each question's candidates by a pair score of (question, node text) and keep ``k``.

    ``score`` maps two columns to a column: the built-in word overlap, or a
    model's by ``model_score``.
    """
    text = F.trim(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("fsn", "common_name", "trade_name", "generic_name")]))
    joined = (
        candidates.select("query_id", "node_id", "rank")
        .join(questions.select("query_id", "question"), "query_id")
        .join(nodes.select("node_id", text.alias("pair_text")), "node_id")
        .withColumn("rerank_score", score(F.col("question"), F.col("pair_text"))))
    return top_k(joined.drop("question", "pair_text"), ["query_id"], [F.desc("rerank_score"), F.col("rank")], k, "new_rank")


def answer_cache_join(asked: DataFrame, cache: DataFrame, threshold: float) -> DataFrame:
    """(query_id, cache_id, kind, score): an earlier answer to the same question, else the nearest earlier one.

    ``asked`` has query_id, question, embedding; ``cache`` has cache_id, question, embedding.
    """
    digest = F.sha2(squash("question"), 256)
    keyed = asked.withColumn("digest", digest)
    known = cache.select(digest.alias("digest"), "cache_id").groupBy("digest").agg(F.min("cache_id").alias("cache_id"))
    same = keyed.join(known, "digest").select("query_id", "cache_id", F.lit("exact").alias("kind"), F.lit(1.0).alias("score"))
    rest = materialise(keyed.join(known, "digest", "left_anti").select("query_id", "embedding"), "uncached")
    near = score_topk(cache, "cache_id", rest, "query_id", 1).where(F.col("score") >= threshold)
    return same.unionByName(near.select("query_id", "cache_id", F.lit("semantic").alias("kind"), "score"))
