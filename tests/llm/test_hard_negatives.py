"""Hard negatives against all scores, with clusters, ties, repeats, null parts and scores that float64 can't hold."""

import math
import random

import numpy as np
import pytest
from conftest_helpers import rows
from pyspark.sql import functions as F

from tessera.llm import hard_negatives as hn, queries

COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def brute(table, is_anchor, positives=5, negatives=3, least=50, most=95):
    good = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in table
            if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = lambda found, k: sorted(found, key=lambda f: (-f[0], f[1] is None, f[1] or 0))[:k]
    out = []
    for n, (a, label, v) in enumerate(good):
        if not is_anchor(a):
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), b, other) for m, (b, other, w) in enumerate(good) if m != n]
        for p, positive, _ in first([s for s in scored if s[2] == label], positives):
            fit = [s for s in scored if s[2] != label and least * p <= 100 * s[0] <= most * p]
            out += [(a, positive, rank, b, p, s) for rank, (s, b, _) in enumerate(first(fit, negatives), 1)]
    return sorted(out, key=lambda r: tuple((x is None, x) for x in r))


def clustered(n=260, dim=6, seed=3):
    """Clusters, exact copies, and a label that holds a third of all rows."""
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    table = []
    for i in range(n):
        c = rng.choice(centres)
        table.append((i, rng.choice([0, 0, 1, 2, 3, 4]), [float(np.float32(x + rng.gauss(0, 0.15))) for x in c]))
    return table + [(n + i, i % 3, table[0][2]) for i in range(30)] + [(table[4][0], *table[4][1:])] * 2


SPECIAL = [(None, 1, [1.0] * 6), (700, None, [1.0] * 6), (701, 1, None), (702, 1, [1.0, None]), (703, 1, [float("nan")] * 6), (704, 2, [float("inf")]),
           (705, 1, []), (706, 0, [0.5, 0.25]), (710, 2, [0.0] * 6), (None, 2, [1.0] * 6), (720, 1, [-1.0] * 6), (730, 9, [1.0] * 6)]


@pytest.mark.parametrize("sizes", [(1024, 8, 16384, 1024), (7, 2, 40, 16)])
def test_mined_equal_all_scores(spark, monkeypatch, sizes):
    for name, size in zip(("BLOCK", "TREES", "SLICE", "TILE"), sizes, strict=True):
        monkeypatch.setattr(hn, name, size)
    table = clustered() + SPECIAL
    random.Random(1).shuffle(table)
    df = spark.createDataFrame(table, "vec_id long, label int, embedding array<float>").withColumns({c: F.lit("clash") for c in ("row", "block", "score", "id")}).repartition(4)
    got = rows(hn.mine(df, F.col("vec_id") % 10 == 0), *COLUMNS)
    assert got == brute(table, lambda i: i is not None and i % 10 == 0) and len(got) > 100
    got = rows(hn.mine(df, F.col("vec_id") % 3 == 0, 2, 4, 80, 100), *COLUMNS)
    assert got == brute(table, lambda i: i is not None and i % 3 == 0, 2, 4, 80, 100)


def test_scores_beyond_float64(spark):
    table = [(i, i % 2, [float(2.0 ** 20 + i), float(2 ** 21 - 3 * i), 1.0 / (i + 1)]) for i in range(40)]
    df = spark.createDataFrame(table, "vec_id long, label int, embedding array<double>")
    want = brute(table, lambda i: i % 5 == 0, most=100)
    assert rows(hn.mine(df, F.col("vec_id") % 5 == 0, most=100), *COLUMNS) == want and max(r[4] for r in want) > 1 << 53


def test_empty_tables_and_no_anchors(spark):
    df = spark.createDataFrame([(1, 0, [1.0]), (2, 1, [1.0])], "vec_id long, label int, embedding array<float>")
    for some, anchor in ((df.where("false"), F.lit(True)), (df, F.lit(False)), (df, F.lit(None).cast("boolean")), (df, F.lit(True))):
        assert hn.mine(some, anchor).collect() == []


def test_bounds_spare_scores_and_lose_none():
    """Over tight clusters most pairs are never scored; what the walk finds is what all scores give."""
    rng = np.random.default_rng(5)
    centres = 300 * rng.standard_normal((12, 16))
    points = np.floor(centres[rng.integers(0, 12, 4000)] + rng.standard_normal((4000, 16)))
    anchors = np.floor(centres[rng.integers(0, 12, 300)] + rng.standard_normal((300, 16)))
    order, parents, edges = hn.spanning_tree(anchors)
    anchors = anchors[order]
    tree = hn.Tree({"label": 0, "block": 0, "n": 300, "anchors": np.arange(300).tobytes(), "vectors": anchors.tobytes(), "parents": parents.tobytes(), "edges": edges.tobytes(), "own": np.zeros(300, np.int64).tobytes()})
    scores = anchors @ points.T
    best = scores.max(axis=1).astype(int).tolist()
    walk = hn.Walk(tree, [[(b * 99 // 100, b), (b * 98 // 100, b * 99 // 100)] for b in best], 3)
    for at in range(0, 4000, 500):
        walk.offer(points[at:at + 500], np.ones(500, bool), at)
    want = []
    for a, b in enumerate(best):
        for number, (low, high) in enumerate([(b * 99 // 100, b), (b * 98 // 100, b * 99 // 100)]):
            fit = [i for i in np.lexsort((np.arange(4000), -scores[a])) if low <= scores[a, i] <= high][:3]
            want += [(a, number, i, int(scores[a, i])) for i in fit]
    assert sorted(walk.rows()) == sorted(want) and walk.scored < 0.3 * scores.size
    for k in range(1, 300):
        assert parents[k] < k and edges[k] == pytest.approx(np.linalg.norm(anchors[k] - anchors[parents[k]]))


def test_registered_query_over_the_whole_table(spark, sf):
    table = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert rows(queries.QUERIES["op12_hard_negatives"](spark, sf), *COLUMNS) == brute(table, lambda i: i % 50 == 0)
