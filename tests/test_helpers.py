"""Joins, ranks, percentiles and vectors against plain Python."""

import math
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from tessera.functions import fulltext
from tessera.functions.matching import contains_join
from tessera.functions.ranking import exact_percentiles, seeded_hash, spread_rank, top_k
from tessera.functions.vectors import _best, mean_vectors, score_topk
from tessera.session import fits, materialise, shared_dir


def test_gram_join_equals_plain_substring_join(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    texts = [(f"t{i}", " ".join(rng.sample(words, 4))) for i in range(200)] + [("empty", "")]
    terms = sorted(set(words[:40]) | {"zzz", "a b"})
    t = spark.createDataFrame([(x,) for x in terms], "term string")
    d = spark.createDataFrame(texts, "node_id string, hay string")
    want = {(i, x) for i, s in texts for x in terms if x in s}
    assert {(r["node_id"], r["term"]) for r in contains_join(t, d).collect()} == want


def test_spread_rank_is_one_global_order(spark):
    df = spark.range(5000).withColumn("g", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))))
    df = df.withColumn("h", seeded_hash(1, "id"))
    rows = spread_rank(df, ["g"], "id", "h").withColumn("plain", F.row_number().over(Window.partitionBy("g").orderBy("h", "id")))
    rows = rows.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("g")))
    assert rows.where("rank <> plain or group_size <> size").count() == 0 and rows.count() == 5000


@pytest.mark.parametrize("n", [1, 2, 11, 30000])
def test_exact_percentiles(spark, n):
    rng = random.Random(n)
    values = [round(rng.lognormvariate(0, 2), 2) if i % 3 else 1.5 for i in range(n)]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", None)], "g string, v double")
    row = {r["g"]: r for r in exact_percentiles(df, ["g"], "v", {"p95": 0.95, "p50": 0.5}).collect()}["a"]
    assert row["p95"] == pytest.approx(np.percentile(values, 95)) and row["p50"] == pytest.approx(np.median(values))
    at = exact_percentiles(df, ["g"], "v", {"p90": 0.9}, interpolate=False).collect()[0]["p90"]
    assert at == sorted(values)[int(0.9 * (n - 1))]


def test_nearest_vectors(spark):
    rng = np.random.default_rng(3)
    left, right = rng.normal(size=(40, 5)), rng.normal(size=(6, 5))
    a = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(left)], "i int, embedding array<float>")
    b = spark.createDataFrame([(j, [float(x) for x in v]) for j, v in enumerate(right)], "j int, embedding array<float>")
    sims = (left / np.linalg.norm(left, axis=1, keepdims=True)) @ (right / np.linalg.norm(right, axis=1, keepdims=True)).T
    got = {(r["j"], r["rank"]): r["i"] for r in score_topk(a, "i", b, "j", 3).collect()}
    assert got == {(j, k + 1): int(i) for j in range(6) for k, i in enumerate(np.argsort(-sims[:, j])[:3])}
    best = {r["i"]: r["j"] for r in score_topk(a, "i", b, "j", 1, per="left").collect()}
    assert best == {i: int(np.argmax(sims[i])) for i in range(40)}


def test_mean_vectors(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 4.0]), ("b", [5.0, 6.0])], "label string, embedding array<double>")
    assert {r["label"]: r["embedding"] for r in mean_vectors(df, "label").collect()} == {"a": [2.0, 3.0], "b": [5.0, 6.0]}


def test_top_k_and_stage_tables(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 2)
    best = top_k(df, ["g"], [F.desc("id")], 2)
    assert sorted(r["id"] for r in best.collect()) == [96, 97, 98, 99]
    stored = materialise(best, "best")
    assert stored.columns == best.columns and stored.count() == 4
    assert fits(stored, 4) and not fits(stored, 3)
    assert shared_dir(spark) in stored.inputFiles()[0]


@pytest.mark.parametrize("per", ["right", "left"])
def test_vector_blocks_are_multiplied_in_tiles(per):
    """A task's memory does not hold a whole block's product: 134 MB and its copies for two blocks of 4,096."""
    rng = np.random.default_rng(1)
    a, b = rng.integers(-3, 4, (4096, 8)).astype(float), rng.integers(-3, 4, (4096, 8)).astype(float)
    tracemalloc.start()
    got = {}
    for li, ri, scores in _best(a, b, 3, per):
        for i, j, s in zip(li[:6].tolist(), ri[:6].tolist(), scores[:6].tolist()):
            got.setdefault(j if per == "right" else i, []).append((i if per == "right" else j, s))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    whole = a @ b.T if per == "left" else b @ a.T
    for owner, found in got.items():
        best = sorted((-s, other) for other, s in enumerate(whole[owner].tolist()))[:3]
        assert found == [(other, -s) for s, other in best]


def test_fulltext_topk_scores_blocks_like_brute_force(spark, monkeypatch):
    """Words and phrases, ties by id, over several blocks of documents and texts; terms that no document has score nothing."""
    rng = random.Random(3)
    docs = [(f"d{i:03}", " " + "".join(f"{w} " for w in (rng.choice("abcde") for _ in range(rng.randrange(9)))), 0) for i in range(300)]
    docs = [(i, d, len(d.split())) for i, d, _ in docs]
    asked = {"one": ["a", "b"], "two": ["a b", "c"], "three": ["zz", "e"], "none": ["zz"], "four": ["a a"]}
    terms = spark.createDataFrame([(t, w) for t, ws in asked.items() for w in ws], "text string, term string")
    documents = spark.createDataFrame(docs, "node_id string, doc string, doc_len int").repartition(5)
    mean = sum(n for _, _, n in docs) / len(docs)
    monkeypatch.setattr(fulltext, "BLOCK_TEXTS", 2)
    monkeypatch.setattr(fulltext, "BLOCK_TERMS", 2)
    rows = fulltext.bm25_topk(terms, documents, len(docs), mean, 7).collect()

    def tf(term, doc):
        return doc.replace(" ", "  ").count(f" {term.replace(' ', '  ')} ")

    for text, words in asked.items():
        want = []
        for i, d, n in docs:
            score = 0.0
            for t in sorted(words):
                df = sum(tf(t, other) > 0 for _, other, _ in docs)
                f = tf(t, d)
                score += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / mean)) if f else 0.0
            if score:
                want.append((-round(score, 9), i))
        got = sorted((r.rank, r.node_id, r.score) for r in rows if r.text == text)
        assert [i for _, i, _ in got] == [i for _, i in sorted(want)[:7]]
        assert [s for _, _, s in got] == pytest.approx([-s for s, _ in sorted(want)[:7]], abs=2e-9)
