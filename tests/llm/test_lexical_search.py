"""Lexical search against a plain scorer, with ties, repeats, degenerate rows and products that leave float64."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from conftest_helpers import rows
from pyspark.sql import functions as F

from tessera.llm import lexical_search as ls, queries

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, k=10):
    split = lambda t: TERM.findall((t or "").translate(LOWER))
    counts = [(d, Counter(split(t))) for d, t in docs]
    lengths = [sum(c.values()) for _, c in counts]
    n_docs, n_terms, df = sum(x > 0 for x in lengths), sum(lengths), Counter(w for _, c in counts for w in c)
    out = []
    for item, text in items:
        found = []
        for (d, c), n in zip(counts, lengths, strict=True):
            if n:
                m = 100 - 75 + (75 * n * n_docs) // n_terms
                s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10 ** 9 * c[w]) // (1000 * c[w] + 8 * m)) for w in split(text) if c[w])
                if s > 0:
                    found.append((-s, d is None, d or 0))
        out += [(item, rank, None if null else d, -s) for rank, (s, null, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=lambda r: tuple((x is None, x) for x in r))


COLUMNS = ("item_id", "rank", "doc_id", "score")


@pytest.mark.parametrize("tile", [(4 << 20, 256, 2048, 1024, 1 << 20), (300, 3, 7, 4, 50)])
def test_search_equals_the_plain_scorer(spark, docs, made, monkeypatch, tile):
    for name, size in zip(("PASS_BYTES", "ITEMS", "TERMS", "DOCUMENTS", "GROUP_BYTES"), tile, strict=True):
        monkeypatch.setattr(ls, name, size)
    items = [(1, made[0][1]), (2, "ve. VE, lu-no é"), (3, None), (4, ""), (5, "zzz"), (2, "ve. VE, lu-no é"), (None, "qui RA ra"), (7, " ".join((t or "")[:60] for _, t in made))]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns({"item": F.lit("clash"), "score": F.lit("clash")})
    for k in (10, 2):
        assert rows(ls.search(docs, asked, k), *COLUMNS) == brute(made, items, k)


def test_ties_and_empty_tables(spark, none):
    table = [(9, "a b"), (3, "a b"), (3, "b a"), (None, "A-b"), (5, "c"), (6, None), (7, "?!"), *((100 - i, "a b") for i in range(12))]
    df, items = spark.createDataFrame(table, "doc_id long, text string").repartition(3), [(1, "a"), (2, "b b c"), (3, "-")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert rows(ls.search(df, asked), *COLUMNS) == brute(table, items)
    assert rows(ls.search(df, asked, 40), *COLUMNS) == brute(table, items, 40)
    assert ls.search(none, asked).collect() == [] == ls.search(df, asked.where("false")).collect()


def test_products_beyond_float64_are_split():
    """Weights whose products with impacts would pass 2^53 come out exact, in several runs."""
    weights = np.array([30_011, 29_989, 7, 1], np.int64)
    tile = ls.Tile([(0, {0: 400_003, 1: 299_999, 2: 1}), (1, {1: 3, 3: 10 ** 9})], weights)
    assert len(tile.runs) > 2
    impact = np.array([999_983, 999_979, 3, 999_999], np.int64)
    got = tile.scores(np.full(4, -1, np.int64), np.zeros(4, np.int64), np.arange(4), impact, 1)
    want = [30_011 * 400_003 * 999_983 + 29_989 * 299_999 * 999_979 + 21, 29_989 * 3 * 999_979 + 10 ** 9 * 999_999]
    assert got.tolist() == [want] and want[0] > 1 << 53


def test_registered_query_over_the_whole_table(spark, sf):
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(i, "text").collect()] for t, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert rows(queries.QUERIES["op13_lexical_search"](spark, sf), *COLUMNS) == brute(docs, items)
