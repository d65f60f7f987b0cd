"""The three near- and exact-duplicate operators against brute force, and their corner cases."""

import brute
import numpy as np
import pytest
from conftest_helpers import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import ngram_join, recompression, suffix_arrays
from tessera.llm.common import squeezed, stored, unsqueezed
from tessera.llm.graph import components, keep_members
from tessera.llm.queries import F


def digest(df):
    return df.withColumn("kept", F.sha2(F.col("kept").cast("binary"), 256))


def test_suffix_arrays_equal_brute_force(docs, made):
    found = digest(suffix_arrays.dedup(docs))
    assert rows(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept") == sorted(brute.byte_cuts(made))


def test_suffix_arrays_keep_other_columns_and_letters(docs, made):
    cut = suffix_arrays.cut_repeats(docs.withColumn("n_chars", F.length("text").cast("long")))
    assert cut.columns == [*docs.columns, "n_chars"]
    got = {r.doc_id: r for r in cut.select("doc_id", "text", "n_chars").collect()}
    assert len(got) == len(made)
    for doc, text in made:
        assert (got[doc].text is None) == (text is None)
        if text is not None:
            assert got[doc].n_chars == len(got[doc].text) and "�" not in got[doc].text


def test_recompression_equals_brute_force(docs, made):
    assert rows(digest(recompression.dedup(docs)), "doc_id", "n_words", "n_removed", "kept") == sorted(brute.word_cuts(made))


@pytest.mark.parametrize("rounds", [0, 1, 6])
def test_recompression_is_exact_at_any_depth(docs, made, rounds):
    found = recompression.dedup(docs, rounds=rounds, digest=True)
    assert rows(found, "doc_id", "n_removed") == sorted((d, n) for d, _, n, _ in brute.word_cuts(made))


def test_jaccard_join_equals_brute_force(docs, made):
    assert rows(ngram_join.join(docs), "doc_id", "n_shingles", "component_id") == sorted(brute.jaccard_components(made))


def test_jaccard_join_with_salted_tokens(docs, made, monkeypatch):
    monkeypatch.setattr(ngram_join, "SALT_ABOVE", 1)
    assert rows(ngram_join.join(docs, percent=70), "doc_id", "component_id") == sorted((d, c) for d, _, c in brute.jaccard_components(made, percent=70))


def test_keep_first_keeps_one_of_each_group(docs, made):
    want = sorted(d for d, _, c in brute.jaccard_components(made) if c == d)
    assert [d for d, in rows(ngram_join.keep_first(docs), "doc_id")] == want


@pytest.mark.parametrize("run", [lambda d: suffix_arrays.dedup(d), lambda d: recompression.dedup(d), lambda d: ngram_join.join(d), lambda d: ngram_join.keep_first(d)])
def test_empty_table(none, run):
    assert run(none).collect() == []


def test_repeated_rows_and_missing_ids(spark):
    text = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf at night"
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (2, text + " x"), (None, text), (3, None)], "doc_id long, text string")
    cut = recompression.dedup(df)
    assert rows(cut, "doc_id", "n_removed") == [(1, 0), (1, 0), (2, 19), (2, 19), (3, 0), (None, 0)]
    assert rows(suffix_arrays.dedup(df), "doc_id", "n_removed") == [(1, 0), (1, 0), (2, len(text)), (2, len(text)), (3, 0), (None, 0)]
    assert rows(ngram_join.join(df), "doc_id", "component_id") == [(1, 1), (1, 1), (2, 1), (2, 1), (3, 3), (None, None)]


def test_row_without_id_does_not_stand_for_its_copy(spark):
    text = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf at night"
    df = spark.createDataFrame([(None, text), (5, text), (None, text), (3, text + " x"), (7, text)], "doc_id long, text string").coalesce(1)
    assert rows(ngram_join.join(df), "doc_id", "n_shingles", "component_id") == [(3, 17, 3), (5, 16, 3), (7, 16, 3), (None, 16, None), (None, 16, None)]
    assert rows(ngram_join.keep_first(df), "doc_id") == [(3,), (None,), (None,)]


def test_components_of_a_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(20, 60)] + [(5, i) for i in range(100, 160)] + [(7, 7)]
    found = dict(tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect())
    assert set(found[i] for i in range(20, 61)) == {20} and set(found[i] for i in range(100, 160)) == {5} and 7 not in found


def test_keep_members(spark):
    some = spark.range(0, 4000, 7).withColumnRenamed("id", "m")
    assert keep_members(spark.range(4000), "id", some, "m").count() == some.count()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=0, max_size=80), st.lists(st.integers(0, 3), min_size=0, max_size=20), st.lists(st.integers(0, 3), min_size=0, max_size=20))
def test_symbols_inside_a_context_agree(core, left, right):
    """Wherever the words of a symbol's context stand, the same symbol stands."""
    a = np.array(core, np.uint64) + np.uint64(99)
    b = np.array(left + core + right, np.uint64) + np.uint64(99)
    name, low, high = recompression.recompress(a, np.zeros(len(a), np.int64), 3)
    other = set(zip(*(x.tolist() for x in recompression.recompress(b, np.zeros(len(b), np.int64), 3)), strict=True))
    for n, i, j in zip(name.tolist(), low.tolist(), high.tolist(), strict=True):
        if 0 <= i and j <= len(a):
            assert (n, i + len(left), j + len(left)) in other


def test_members_are_looked_up_before_rows_are_shuffled(spark):
    rows, some = spark.range(4000).withColumn("text", F.col("id").cast("string")), spark.range(0, 4000, 500).select(F.col("id").alias("m"))
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        twice = keep_members(rows, "id", some.unionAll(some), "m")
        plan = twice._jdf.queryExecution().executedPlan().toString()
        assert sorted(r["id"] for r in twice.collect()) == list(range(0, 4000, 500))
    finally:
        spark.conf.set(key, before)
    # The bitmap's join stands below the exact one, so that only likely members are shuffled.
    assert 0 <= plan.find("SortMergeJoin") < plan.find("BroadcastHashJoin")


def test_pairs_are_verified_without_storing_sets(spark, monkeypatch):
    schemas = {}
    monkeypatch.setattr(ngram_join, "stored", lambda rows, name: schemas.setdefault(name, rows.schema) and stored(rows, name))
    long = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, long), (2, long + " x"), (3, "quite another text than that"), (3, long), (4, None)], "doc_id long, text string")
    pairs = spark.createDataFrame([(2, 1), (3, 1), (3, 2), (4, 1)], "a long, b long")
    found = ngram_join.verified(pairs, docs, 4, 85)
    assert sorted(map(tuple, found.collect())) == [(2, 1), (3, 1), (3, 2)]
    assert schemas and all(f.dataType.typeName() != "array" for s in schemas.values() for f in s)


def test_squeezed_texts_come_back(spark):
    texts = ["", "ä\n" * 2000, None, "plain"]
    rows = squeezed(spark.createDataFrame([(i, t, -i) for i, t in enumerate(texts)], "doc_id long, text string, tag int"))
    out = rows.toArrow()
    assert list(unsqueezed(out.column("text"))) == [(t or "").encode() for t in texts]
    assert out.column("doc_id").to_pylist() == [0, 1, 2, 3] and out.column("tag").to_pylist() == [0, -1, -2, -3]
    assert sum(len(x) for x in out.column("text").to_pylist()) < 200
