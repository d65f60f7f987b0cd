"""Walks, context and fusion against brute force on small graphs."""

import itertools
import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.operators import retrieval as rv
from tessera.session import shared_dir
from tessera.sources.catalogue import Catalogue, index_documents, index_postings, links, neighbours, neighbours_of, store_catalogue
from tessera.schema import NODE_SCHEMA


def random_edges(seed, nodes=9, n=22):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(nodes)]
    rows = set()
    while len(rows) < n:
        a, b = rng.sample(names, 2)
        t = rng.choice(["HAS_VTM", "IS_VTM_OF"])
        rows.add((f"{a}|{t}|{b}", a, b, t))
    return sorted(rows)


def trails(edges, start, hops):
    """Counter of (node, hop) over all trails that use no edge twice."""
    near = {}
    for e, a, b, _ in edges:
        near.setdefault(a, []).append((e, b))
        near.setdefault(b, []).append((e, a))
    found, level = Counter({(start, 0): 1}), [(start, frozenset())]
    for hop in range(1, hops + 1):
        level = [(b, used | {e}) for node, used in level for e, b in near.get(node, []) if e not in used]
        found.update((node, hop) for node, _ in level)
    return found


REQUEST = "query_id string, hops int, k int, levels array<string>, f_nlem boolean, f_nlem_category string, f_manufacturer string, f_tmtid string"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_traverse_equals_enumerated_trails(spark, seed):
    """Hop of the nearest anchor, trails of all anchors, for lists that fill at once and lists that never do."""
    edges = random_edges(seed, nodes=40, n=70)
    cat = small_catalogue(spark, edges)
    asked = [("a", 3, 6, None), ("b", 2, 6, None), ("c", 1, 6, None), ("d", 3, 40, None), ("e", 2, 40, ["GP"]), ("f", 3, 6, ["TP"]), ("g", 0, 6, None)]
    anchors = {"a": ["n0", "n3"], "b": ["n0"], "c": ["n5", "n6"], "d": ["n1"], "e": ["n2", "n0", "n9"], "f": ["n2"], "g": ["n4"]}
    known = {x for e in edges for x in e[1:3]}
    anchors = {q: [n for n in ns if n in known] for q, ns in anchors.items()}
    requests = spark.createDataFrame([(q, h, k, lv, None, None, None, None) for q, h, k, lv in asked], REQUEST)
    starts = spark.createDataFrame([(q, n) for q, ns in anchors.items() for n in ns], "query_id string, node_id string")
    got = {(r["query_id"], r["g_rank"]): (r["node_id"], r["graph_hop"], r["graph_support"]) for r in rv.traverse(requests, starts, cat, 80).collect()}
    want = {}
    for q, hops, k, levels in asked:
        total, nearest = Counter(), {}
        for start in anchors[q]:
            for (node, hop), c in trails(edges, start, hops).items():
                total[node] += c
                nearest[node] = min(hop, nearest.get(node, hop))
        level = {n: "TP" if int(n[1:]) % 3 == 0 else "GP" for n in nearest}
        order = sorted((nearest[n], -total[n], n) for n in nearest if not levels or level[n] in levels)
        want |= {(q, i): (n, h, -s) for i, (h, s, n) in enumerate(order[:max(2 * k, 12)])}
    assert got == want


def small_catalogue(spark, edges):
    ids = sorted({x for e in edges for x in e[1:3]})
    nodes = spark.createDataFrame(
        [tuple({"node_id": i, "tmtid": i, "level": "TP" if int(i[1:]) % 3 == 0 else "GP", "name": f"name {i}"}.get(f.name) for f in NODE_SCHEMA.fields) for i in ids], NODE_SCHEMA)
    df = spark.createDataFrame(edges, "edge_id string, src_id string, dst_id string, type string")
    return Catalogue(nodes, df, index_documents(nodes), index_postings(nodes), links(df), neighbours(links(df)), len(ids), 2.0)


@pytest.mark.parametrize("cap, depth", [(5, 2), (80, 2), (7, 3), (200, 3), (None, 4)])
def test_expand_context(spark, cap, depth):
    edges = random_edges(7)
    cat = small_catalogue(spark, edges)
    near = {}
    for e, a, b, _ in edges:
        near.setdefault(a, []).append((e, b))
        near.setdefault(b, []).append((e, a))
    paths = []
    for rank, seed in enumerate(("n2", "n5"), start=1):
        level = [((), (seed,))]
        for hop in range(1, depth + 1):
            level = [((*used, e), (*stops, b)) for used, stops in level for e, b in near.get(stops[-1], []) if e not in used]
            paths += [(rank, hop, used, stops) for used, stops in level]
    kept = sorted(paths)[:cap]
    seeds = spark.createDataFrame([("q", "n2", 1), ("q", "n5", 2)], "query_id string, node_id string, rank int")
    around = rv.expand_context(seeds, cat, depth, cap)
    first: dict = {}
    for no, p in enumerate(kept, start=1):
        for step, node in enumerate(p[3]):
            first.setdefault(node, no * 10 + step)
    assert {r["node_id"]: r["found_at"] for r in around.nodes.collect()} == first
    used = {e for p in kept for e in p[2]}
    assert {f"{r['start_id']}|{r['type']}|{r['end_id']}" for r in around.relationships.collect()} == used
    assert {r["node_id"] for r in around.nodes.where("is_seed").collect()} <= {"n2", "n5"}


def channel(spark, p, ids):
    extra = ", graph_hop int, graph_support bigint" if p == "g" else ""
    rows = [("q", n, float(10 - i), i) + ((1, 1) if p == "g" else ()) for i, n in enumerate(ids)]
    return spark.createDataFrame(rows, f"query_id string, node_id string, {p}_score double, {p}_rank int{extra}")


def test_rrf_scores_ties_and_bound(spark):
    asked = spark.createDataFrame([("q", 3, 1.0, 1.0, 2.0)], "query_id string, k int, v_weight double, t_weight double, g_weight double")
    rows = rv.fuse_rrf(channel(spark, "v", ["a", "b"]), channel(spark, "t", ["b", "a"]), channel(spark, "g", ["c"]), asked, 12).orderBy("fused_rank").collect()
    # a and b score the same; the better vector rank goes first.
    scores = {r["node_id"]: r["rrf_score"] for r in rows}
    assert scores["a"] == pytest.approx(0.25 / 61 + 0.25 / 62) and scores["a"] == scores["b"]
    assert scores["c"] == pytest.approx(0.5 / 61)
    assert all(s <= 1 / 61 for s in scores.values())
    assert [r["node_id"] for r in rows if r["node_id"] in "ab"] == ["a", "b"]


def test_weights_fall_back_to_thirds(spark):
    w = spark.range(1).select(rv.normalised_weights(F.lit(0.0), F.lit(-1.0), F.lit(0.0)).alias("w")).first()["w"]
    assert [round(x, 6) for x in w] == [0.333333] * 3


def test_links_give_both_orientations(spark):
    df = spark.createDataFrame([("e", "a", "b", "t")], "edge_id string, src_id string, dst_id string, type string")
    assert {(r["node_id"], r["other_id"]) for r in links(df).collect()} == {("a", "b"), ("b", "a")}


def test_walks_beyond_the_counted_hops_are_refused(spark):
    requests = spark.createDataFrame([("q", 4, 6, None, None, None, None, None)], REQUEST)
    with pytest.raises(ValueError):
        rv.traverse(requests, spark.createDataFrame([("q", "n0")], "query_id string, node_id string"), None, 20)


def test_variants_are_merged_in_order(spark):
    """A later variant's candidate must beat score plus boost; a node that entered on a boost takes no ranks until it is beaten."""
    candidates = spark.createDataFrame(
        [("q", "a", 1, 0.010, 1, 9999, "one"), ("q", "a", 2, 0.016, 9999, 0, "two"), ("q", "b", 1, 0.010, 4, 9999, "one"), ("q", "b", 2, 0.016, 9999, 2, "two"),
         ("q", "c", 2, 0.013, 9999, 3, "two")],
        "query_id string, node_id string, variant_no int, rrf_score double, v_rank int, t_rank int, found_by_query string").withColumns(
        {"g_rank": F.lit(9999), "graph_hop": F.lit(None).cast("int"), "graph_support": F.lit(None).cast("bigint")})
    exact = spark.createDataFrame([("q", "a", 1, 0, "one"), ("q", "a", 2, 0, "two"), ("q", "c", 1, 1, "one")], "query_id string, node_id string, variant_no int, exact_rank int, found_by_query string")
    got = {r.node_id: (r.rrf_score, r.v_rank, r.t_rank, r.exact_rank, r.found_by_query) for r in rv.merge_query_variants(candidates, exact, 10).collect()}
    assert got == {"a": (0.91, 1, 9999, 0, "one"), "b": (0.016, 9999, 2, 9999, "two"), "c": (0.33, 9999, 9999, 1, "one")}


def test_catalogue_tables_are_written_when_asked_for(spark):
    """A count of nodes leaves neither edges nor a text index on disk; ids that an edge has of its own come back as they were, null too."""
    def stages():
        return {p.name for p in (Path(shared_dir(spark)) / spark.sparkContext.applicationId).glob("*")}

    def new():
        return {name.rpartition("-")[0] for name in stages() - before}

    edges = [("n1|HAS_VTM|n2", "n1", "n2", "HAS_VTM"), ("own", "n2", "n3", "HAS_VTM"), (None, "n3", "n1", "HAS_TRADE_UNIT"), ("n2|HAS_VTM|n1", "n1", "n2", "HAS_VTM")]
    given = small_catalogue(spark, [e for e in edges if e[0]])
    before = stages()
    cat = store_catalogue(given.nodes, spark.createDataFrame(edges, "edge_id string, src_id string, dst_id string, type string"))
    assert cat.nodes.count() == 3
    assert new() == {"nodes"}
    assert sorted(map(tuple, cat.edges.select("edge_id", "src_id", "dst_id", "type").collect()), key=str) == sorted(edges, key=str)
    assert new() == {"nodes", "edges"}
    counted = {(r.node_id, r.other_id): r.n for r in neighbours_of(spark.createDataFrame([("n1",)], "node_id string"), cat.links).collect()}
    assert counted == {("n1", "n2"): 2, ("n1", "n3"): 1}
