"""Ranked lexical search of many items over all documents by dense matrix products.

Documents are counted once against the items' vocabulary. Then tiles of items, each with its own compact vocabulary, meet tiles of documents: item weights
times document impacts in float64. A vocabulary tile is cut where an item's sum could reach 2^53, so every product is an exact integer; products add up in
64-bit integers. Each task keeps the best of each item, ties by id, and a window over those few takes the best of all tasks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import discard, schema, stored, text_bytes

#: ASCII letters lowered, digits kept, all other ASCII made blanks; bytes from 0x80 on belong to terms.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of item text that are searched in one pass; items, terms and documents of a tile; bytes of text counted at once.
PASS_BYTES, ITEMS, TERMS, DOCUMENTS, GROUP_BYTES = 4 << 20, 256, 2048, 1024, 1 << 20
#: No impact reaches this, since (10^9 tf) div (1000 tf + 8 m) stays below 10^6.
MOST = 10 ** 6
COUNTED = schema("doc_id long, n long, terms binary, counts binary")
HELD = schema("term long, df long")
FOUND = schema("item long, doc_id long, score long")


def terms(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Tile:
    """At most ``ITEMS`` items and their compact vocabulary, in runs of terms whose products are exact."""

    def __init__(self, items: list[tuple[int, dict[int, int]]], weights: np.ndarray):
        self.items = np.array([i for i, _ in items], np.int64)
        per_term: dict[int, list[tuple[int, int]]] = {}
        for column, (_, own) in enumerate(items):
            for term, times in own.items():
                if weights[term]:
                    per_term.setdefault(term, []).append((column, int(weights[term]) * times))
        limit, self.runs = ((1 << 53) - 1) // MOST, []
        sums = np.zeros(len(items), np.int64)
        self._open()
        for term in sorted(per_term):
            todo = per_term[term]
            while todo:  # a product too large for one run is spread over several
                part = [(c, min(w, limit)) for c, w in todo]
                if len(self.here) == TERMS or any(sums[c] + w > limit for c, w in part):
                    self._close()
                    sums[:] = 0
                for c, w in part:
                    sums[c] += w
                    self.cells.append((len(self.here), c, w))
                self.here.append(term)
                todo = [(c, w - p) for (c, w), (_, p) in zip(todo, part, strict=True) if w > p]
        self._close()

    def _open(self) -> None:
        self.here, self.cells = [], []

    def _close(self) -> None:
        if self.here:
            self.runs.append((np.array(self.here, np.int64), np.array(self.cells, np.int64)))
        self._open()

    def scores(self, place: np.ndarray, of: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int) -> np.ndarray:
        """Whole scores of documents and items. ``of``, ``term``, ``impact``: the documents' entries; ``place`` is scratch, one cell a term."""
        total = np.zeros((n_docs, len(self.items)), np.int64)
        for here, cells in self.runs:
            place[here] = np.arange(len(here))
            column = place[term]
            place[here] = -1
            own = column >= 0
            left = np.zeros((n_docs, len(here)))
            left[of[own], column[own]] = impact[own]
            right = np.zeros((len(here), len(self.items)))
            right[cells[:, 0], cells[:, 1]] = cells[:, 2]
            total += (left @ right).astype(np.int64)
        return total


class Best:
    """The ``k`` best documents of each item so far, equal scores by ascending id, null last."""

    def __init__(self, k: int, tiles: list[Tile]):
        self.k, self.held = k, {}
        self.floors = [np.zeros(len(t.items), np.int64) for t in tiles]

    def offer(self, number: int, items: np.ndarray, ids: np.ndarray, nulls: np.ndarray, scores: np.ndarray) -> None:
        floor = self.floors[number]
        good = (scores > 0) & (scores >= floor)
        for column in np.flatnonzero(good.any(axis=0)):
            at = np.flatnonzero(good[:, column])
            old = self.held.get(items[column])
            s, d, z = scores[at, column], ids[at], nulls[at]
            if old:
                s, d, z = (np.concatenate(p) for p in zip(old, (s, d, z)))
            keep = np.lexsort((d, z, -s))[:self.k]
            self.held[items[column]] = s[keep], d[keep], z[keep]
            if len(keep) == self.k:
                floor[column] = s[keep[-1]]

    def rows(self) -> Iterator[tuple[int, int | None, int]]:
        for item, (s, d, z) in self.held.items():
            yield from ((int(item), None if null else int(doc), int(score)) for score, doc, null in zip(s, d, z))


def _count(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Of each document its id, its terms, and how often those of the vocabulary occur."""
    arrow, shared = to_arrow_schema(COUNTED), docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        width = len(known) + 1

        def batch(ids: list, lengths: list[int], codes: list[np.ndarray]) -> pa.RecordBatch:
            flat = np.concatenate(codes)
            key, times = np.unique((np.repeat(np.arange(len(ids)), lengths) * width + flat)[flat >= 0], return_counts=True)
            edges = np.searchsorted(key, np.arange(len(ids) + 1) * width)
            term, times = (key % width).astype("<u4"), times.astype("<u4")
            cells = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
            columns = (ids, lengths, [term[a:b].tobytes() for a, b in cells], [times[a:b].tobytes() for a, b in cells])
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        ids, lengths, codes, size = [], [], [], 0
        for part in parts:
            for doc, text in zip(part.column("doc_id").to_pylist(), text_bytes(part.column("text")), strict=True):
                words = terms(text)
                ids.append(doc)
                lengths.append(len(words))
                codes.append(np.fromiter((known.get(w, -1) for w in words), np.int64, len(words)))
                size += len(text) + 64
                if size > GROUP_BYTES:
                    yield batch(ids, lengths, codes)
                    ids, lengths, codes, size = [], [], [], 0
        if ids:
            yield batch(ids, lengths, codes)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, COUNTED)


def _frequencies(counted: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term of the vocabulary: one sum per task and term, then one per term."""
    arrow = to_arrow_schema(HELD)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for part in parts:
            for cell in part.column("terms"):
                total[np.frombuffer(cell.as_buffer(), "<u4")] += 1  # a document names a term once
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], schema=arrow)

    df = np.zeros(size, np.int64)
    for term, held in counted.select("terms").mapInArrow(run, HELD).groupBy("term").agg(F.sum("df")).collect():  # at most the vocabulary of a pass
        df[term] = held
    return df


def _score(counted: DataFrame, tiles: list[Tile], size: int, n_docs: int, n_terms: int, k: int) -> DataFrame:
    arrow, shared = to_arrow_schema(FOUND), counted.sparkSession.sparkContext.broadcast(tiles)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, place = Best(k, shared.value), np.full(size, -1, np.int64)
        for part in (p.slice(a, DOCUMENTS) for p in parts for a in range(0, p.num_rows, DOCUMENTS)):
            ids = part.column("doc_id")
            nulls = np.array(ids.is_null())
            ids = ids.fill_null(0).to_numpy()
            lists = [np.frombuffer(c.as_buffer(), "<u4") for c in part.column("terms")]
            of = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            term = np.concatenate(lists).astype(np.int64)
            tf = np.concatenate([np.frombuffer(c.as_buffer(), "<u4") for c in part.column("counts")]).astype(np.int64)
            m = np.array([25 + 75 * n * n_docs // n_terms for n in part.column("n").to_pylist()], np.int64)  # Python's integers don't overflow
            impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[of])
            for number, tile in enumerate(shared.value):
                best.offer(number, tile.items, ids, nulls, tile.scores(place, of, term, impact, len(lists)))
        found = list(best.rows())
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), arrow, strict=True)], schema=arrow)

    return counted.mapInArrow(run, FOUND)


def _passes(items: DataFrame) -> Iterator[list]:
    """The items, as rows of ``item, text``, in groups of about ``PASS_BYTES`` of text."""
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // PASS_BYTES) or 1
    for i in range(n):
        yield items.where(F.pmod(F.xxhash64("item"), F.lit(n)) == i).select("item", "text").orderBy("item").collect()


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best documents ``(item_id, rank, doc_id, score)`` of each item.

    Terms are runs of ASCII letters, digits and characters beyond ASCII, with A-Z lowered; null has none. A document's score sums, over an item's terms with
    repeats, ``w * ((10^9 tf) div (1000 tf + 8 m))``, with ``w = floor(1000 ln((2N + 2) / (2 df + 1)))`` and ``m = 25 + (75 n N) div L`` over all documents.

    Documents without a score above 0 are left out, so items without terms, or with none that a document has, get no rows. Equal scores fall to the smaller
    ``doc_id``, null last. A repeated document counts, and is found, as often as it occurs; a repeated item is answered as often. Other columns are
    ignored; empty tables give no rows. Each pass holds about ``PASS_BYTES`` of item text, or one longer item whole; the documents are read once a pass.
    """
    spark = docs.sparkSession
    asked = stored(items.select("item_id", "text").withColumn("item", F.monotonically_increasing_id()), "items")
    found = None
    for group in _passes(asked):
        vocabulary: dict[bytes, int] = {}
        wanted = [(r.item, Counter(vocabulary.setdefault(w, len(vocabulary)) for w in terms((r.text or "").encode()))) for r in group]
        wanted = [(i, own) for i, own in wanted if own]
        if not wanted:
            continue
        counted = stored(_count(docs, vocabulary), "counted")
        n_docs, n_terms = counted.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        if not n_docs:
            break
        df = _frequencies(counted, len(vocabulary))
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) if d else 0 for d in df.tolist()], np.int64)
        tiles = [Tile(wanted[i:i + ITEMS], weights) for i in range(0, len(wanted), ITEMS)]
        part = stored(_score(counted, tiles, len(vocabulary), n_docs, n_terms, k), "found")
        discard(counted)
        found = part if found is None else found.unionAll(part)
    found = _nothing(spark) if found is None else found
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], FOUND)


#: The same in DuckDB's SQL, over ``documents`` and ``benchmark``.
ORACLE = r"""
WITH terms AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
     tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
     lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
     whole AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths),
     weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, whole GROUP BY term, n_docs),
     asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
     scored AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
                FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN lengths USING (doc_id), whole GROUP BY item_id, doc_id),
     ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
