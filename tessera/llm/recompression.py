"""Substring dedup over words by recompression.

Rounds rewrite every document at once: first runs of one word become a symbol, then, round by round, a pair of neighbours becomes a symbol if a hash
puts the first on the left side and the second on the right. A symbol's name is a hash of what it stands for, so equal strings get equal names in
every task without a table of names, and inside a repeated passage all symbols agree but for a few at its ends. With each symbol goes its
context, the words that settled it: wherever these words stand, the same symbol stands.

One shuffle of the top symbols finds those met in two documents. A window that holds the whole context of a symbol that no other document has
occurs in no other document; the windows left are compared with each other in full.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import partitions, schema, squeezed, stored, text_bytes, unsqueezed
from .graph import likely_members
from .ngram_join import MAX_CACHED_WORDS, mixed
from .suffix_arrays import (CUT, MARK, MARKS, RANGE, TAG, U64, extents, gather_cuts, gather_marks, homed, of_kind, planes, read, route_of, routed,
                            runs)

ROUNDS, CHUNK, HELD = 4, 100_000, 1_000_000
FAR = 1 << 40
SYMBOL = schema("route int, kind int, name binary, doc binary")
WINDOW = schema("route int, kind int, hash binary, check binary, doc binary, tag binary, start binary")


class Words:
    """64-bit hashes of a text's words (parted at white space), each word hashed once."""

    def __init__(self):
        self.known = {}

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.split()  # of bytes: at exactly \x20 and \x09-\x0D
        if len(self.known) > MAX_CACHED_WORDS:
            self.known.clear()
        for w in set(words).difference(self.known):
            self.known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))


def recompress(words: np.ndarray, owner: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the symbols after ``rounds`` and the word ranges of their contexts. ``owner`` parts the words into documents."""
    n = len(words)
    if not n:
        return words, np.zeros(0, np.int64), np.zeros(0, np.int64)
    same = owner[1:] == owner[:-1]
    first = np.flatnonzero(np.r_[True, (words[1:] != words[:-1]) | ~same])
    end = np.r_[first[1:], n]
    length = end - first
    name = np.where(length > 1, mixed(words[first] ^ mixed(length.astype(U64), 3), 3), words[first])
    # A run is known to be whole by the words on either side. At a document's edge nothing tells, so no window holds the context.
    low = np.where(np.r_[False, same][first], first - 1, -FAR)
    high = np.where(np.r_[same, False][end - 1], end + 1, FAR)
    own = owner[first]
    for r in range(rounds):
        right = (mixed(name, 10 + r) >> U64(63)).astype(bool)
        near = own[1:] == own[:-1]
        pair = np.r_[~right[:-1] & right[1:] & near, False]
        keep = ~np.r_[False, pair[:-1]]
        next_low, next_high = np.r_[low[1:], -FAR], np.r_[high[1:], FAR]
        before_low, before_high = np.r_[-FAR, low[:-1]], np.r_[FAR, high[:-1]]
        has_next, has_before = np.r_[near, False], np.r_[False, near]
        # A pair settles itself. A lone left symbol depends on its right neighbour, a lone right one on its left neighbour.
        new_low = np.where(pair, np.minimum(low, next_low), np.where(right, np.where(has_before, np.minimum(low, before_low), -FAR), np.where(has_next, np.minimum(low, next_low), low)))
        new_high = np.where(pair, np.maximum(high, next_high), np.where(right, np.where(has_before, np.maximum(high, before_high), high), np.where(has_next, np.maximum(high, next_high), FAR)))
        named = np.where(pair, mixed(name * U64(0x9E3779B97F4A7C15) + np.r_[name[1:], U64(0)], 4), name)
        name, low, high, own = named[keep], new_low[keep], new_high[keep], own[keep]
    return name, low, high


def groups_of_texts(parts: Iterator[pa.RecordBatch], columns: tuple[str, ...], texts: Callable = text_bytes) -> Iterator[tuple[list[tuple], np.ndarray, np.ndarray]]:
    """About CHUNK words at a time: each text's columns, the hashes of all words, and the text each word is of."""
    hashed, held, some, size = Words(), [], [], 0
    for part in parts:
        for *values, text in zip(*(part.column(c).to_pylist() for c in columns), texts(part.column("text")), strict=True):
            held.append(tuple(values))
            some.append(hashed(text))
            size += len(some[-1])
            if size >= CHUNK:
                yield held, np.concatenate(some), np.repeat(np.arange(len(some)), [len(x) for x in some])
                held, some, size = [], [], 0
    if held:
        yield held, np.concatenate(some), np.repeat(np.arange(len(some)), [len(x) for x in some])


def window_starts(owner: np.ndarray, length: int) -> np.ndarray:
    """Where ``length`` consecutive words are of one text."""
    last = len(owner) - length + 1
    return np.flatnonzero(owner[:last] == owner[length - 1:]) if last > 0 else np.zeros(0, np.int64)


def holding(starts: np.ndarray, low: np.ndarray, high: np.ndarray, n: int, length: int) -> np.ndarray:
    """Which windows hold one of the ranges ``[low, high)`` as a whole."""
    fits = (high - low <= length) & (low >= 0) & (high <= n)
    edge = np.zeros(n + 2, np.int64)
    np.add.at(edge, np.maximum(high[fits] - length, 0), 1)
    np.add.at(edge, low[fits] + 1, -1)
    return np.cumsum(edge)[starts] > 0


def name_key(name: np.ndarray) -> np.ndarray:
    """16 bits by which a document knows its own symbol again."""
    return (mixed(name, 6) >> U64(48)).astype(np.uint16)


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)


def symbols(docs: DataFrame, routes: int, length: int, rounds: int) -> DataFrame:
    """Top symbols with a context that fits a window (kind 0), one entry per symbol and task; marks (kind 1) of those a task met in two
    documents, and of documents with a window that holds no context at all (key 0 alone)."""
    arrow = to_arrow_schema(SYMBOL)

    def emit(name: np.ndarray, doc: np.ndarray, bare: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((doc, name))
        begins = runs(order, name)
        sizes = np.diff(np.r_[begins, len(order)])
        several = np.repeat(doc[order][begins] != doc[order][begins + sizes - 1], sizes) if len(order) else np.zeros(0, bool)
        marked, kept = order[several], order[begins]
        rows = [(r, 0, planes(name[kept[e]]), planes(doc[kept[e]])) for r, e in routed(route_of(name[kept], routes))]
        key, of = np.r_[name_key(name[marked]), np.zeros(len(bare), np.uint16)], np.r_[doc[marked], bare]
        rows += [(r, 1, planes(key[e]), planes(of[e])) for r, e in routed(route_of(of.view(U64), routes))]
        if rows:
            yield _batch(rows, arrow)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bare, size = [], [], 0
        for texts, words, owner in groups_of_texts(parts, ("doc_id",)):
            docs = np.array([d for d, in texts], np.int64)
            name, low, high = recompress(words, owner, rounds)
            starts = window_starts(owner, length)
            none = starts[~holding(starts, low, high, len(words), length)]
            bare.append(docs[np.unique(owner[none])])
            fits = high - low <= length
            held.append((name[fits], docs[owner[np.maximum(low[fits], 0)]]))
            size += len(words)
            if size >= HELD:
                yield from emit(*(np.concatenate(x) for x in zip(*held, strict=True)), np.concatenate(bare))
                held, bare, size = [], [], 0
        if held:
            yield from emit(*(np.concatenate(x) for x in zip(*held, strict=True)), np.concatenate(bare))

    return docs.select("doc_id", "text").mapInArrow(run, SYMBOL)


def shared_symbols(part: pa.Table, routes: int) -> pa.Table:
    """Marks of one route's symbols that two documents have."""
    zero, one = of_kind(part, 0), of_kind(part, 1)
    name, doc = read(zero, "name", "<u8"), read(zero, "doc", "<i8")
    order = np.argsort(name, kind="stable")
    begins = runs(order, name)
    met = np.zeros(len(order), bool)
    if len(order):
        d = doc[order]
        met[order] = np.repeat(np.minimum.reduceat(d, begins) != np.maximum.reduceat(d, begins), np.diff(np.r_[begins, len(order)]))
    return homed(to_arrow_schema(MARK), routes, np.r_[doc[met], read(one, "doc", "<i8")], np.r_[name_key(name[met]), read(one, "name", "<u2")])


def open_windows(rows: DataFrame, routes: int, length: int, rounds: int) -> DataFrame:
    """The windows of ``doc_id, tag, keys, text``, texts squeezed, that hold no context of an unshared symbol (kind 0). Of a window that a task meets again the
    first document's stays, and later documents' are cut at once (kind 1)."""
    arrow = to_arrow_schema(WINDOW)

    def emit(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        h, check, doc, tag, start = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((doc, check, h))
        begins = runs(order, h, check)
        low = np.repeat(doc[order][begins], np.diff(np.r_[begins, len(order)]))
        rows = []
        for kind, some in ((0, order[doc[order] == low]), (1, order[doc[order] > low])):
            for r, e in routed(route_of(h[some] if kind == 0 else doc[some].view(U64), routes)):
                e = some[e]
                rows.append((r, kind, planes(h[e]) if kind == 0 else b"", planes(check[e]) if kind == 0 else b"", planes(doc[e]), planes(tag[e]), planes(start[e])))
        if rows:
            yield _batch(rows, arrow)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for texts, words, owner in groups_of_texts(parts, ("doc_id", "tag", "keys"), unsqueezed):
            name, low, high = recompress(words, owner, rounds)
            fits = (high - low <= length) & (low >= 0)
            name, low, high = name[fits], low[fits], high[fits]
            key, of, alone = name_key(name), owner[low], np.ones(len(name), bool)
            begins = runs(np.arange(len(of)), of)
            for i, j in extents(begins, len(of)):
                alone[i:j] = ~np.isin(key[i:j], np.frombuffer(texts[of[i]][2], "<u2"))
            starts = window_starts(owner, length)
            s = starts[~holding(starts, low[alone], high[alone], len(words), length)]
            if not len(s):
                continue
            h, check = np.zeros(len(s), U64), np.zeros(len(s), U64)
            for j in range(length):  # two polynomials in the words' hashes
                word = words[s + j]
                h, check = h * U64(0x9E3779B97F4A7C15) + word, check * U64(0xC2B2AE3D27D4EB4F) + word
            h = mixed(h, 8)
            begin = np.searchsorted(owner, np.arange(len(texts)))
            held.append((h, (check >> U64(32)).astype(np.uint32), np.array([t[0] for t in texts], np.int64)[owner[s]],
                         np.array([t[1] for t in texts], np.int32)[owner[s]], (s - begin[owner[s]]).astype(np.int32)))
            size += len(s)
            if size >= HELD:
                yield from emit(held)
                held, size = [], 0
        if held:
            yield from emit(held)

    return rows.mapInArrow(run, WINDOW)


def compare_windows(part: pa.Table, length: int, routes: int) -> pa.Table:
    """The cuts of one route: windows that also start in a document with a smaller id."""
    zero, one = of_kind(part, 0), of_kind(part, 1)
    h, check = read(zero, "hash", "<u8"), read(zero, "check", "<u4")
    doc, tag, start = (read(zero, c, k) for c, k in (("doc", "<i8"), ("tag", "<i4"), ("start", "<i4")))
    order = np.lexsort((doc, check, h))
    begins = runs(order, h, check)
    gone = order[doc[order] > np.repeat(doc[order][begins], np.diff(np.r_[begins, len(order)]))]
    doc, tag, start = (np.r_[x[gone], read(one, c, k)] for x, c, k in ((doc, "doc", "<i8"), (tag, "tag", "<i4"), (start, "start", "<i4")))
    return homed(to_arrow_schema(RANGE), routes, doc, tag, start, (start + length).astype("<i4"))


def find_cuts(docs: DataFrame, length: int = 13, rounds: int = ROUNDS) -> DataFrame:
    """``doc, tag, cuts``: the word ranges to remove from each document, packed."""
    routes = partitions(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    marks = symbols(docs, routes, length, rounds).repartition(routes, "route").groupBy("route").applyInArrow(lambda part: shared_symbols(part, routes), MARK)
    found = stored(marks.groupBy("home").applyInArrow(gather_marks, MARKS), "recompression_found")
    texts = squeezed(likely_members(docs, "doc_id", found, "doc").select("doc_id", TAG("text").alias("tag"), "text"))
    rows = texts.join(found, F.col("doc_id") == F.col("doc")).select("doc_id", "tag", "keys", "text")
    windows = open_windows(rows, routes, length, rounds).repartition(routes, "route")
    cuts = windows.groupBy("route").applyInArrow(lambda part: compare_windows(part, length, routes), RANGE)
    return cuts.groupBy("home").applyInArrow(gather_cuts, CUT)


def dedup(docs: DataFrame, length: int = 13, rounds: int = ROUNDS, digest: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` of every row: ``kept`` is the words that stay, joined by one space, or with ``digest`` their SHA-256.

    A word goes if it lies in ``length`` consecutive words of its document that also start in a document with a smaller ``doc_id``; windows are
    judged on the input. Null and empty texts have no words. Rows with a null ``doc_id`` neither cut nor are cut; rows that share a ``doc_id`` don't cut
    each other and are told apart by their texts. Extra columns are ignored, and an empty table gives no rows.
    """
    cuts = stored(find_cuts(docs, length, rounds), "recompression_cuts")
    out_schema = schema("cut_doc long, cut_tag int, cut_removed long, cut_kept string")
    own_schema = schema("doc_id long, own_tag int, n_words long, own_kept string")

    def finish(words: list[bytes]) -> str:
        text = b" ".join(words)
        if not digest:
            return text.decode()
        import hashlib

        return hashlib.sha256(text).hexdigest()

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for doc, tag, ranges, text in zip(*(part.column(c).to_pylist() for c in ("doc", "tag", "cuts")), unsqueezed(part.column("text")), strict=True):
                words = text.split()
                edges = [0, *np.frombuffer(ranges, "<i4").tolist(), len(words)]
                stays = [w for i, j in zip(edges[::2], edges[1::2], strict=True) for w in words[i:j]]
                rows.append((doc, tag, len(words) - len(stays), finish(stays)))
            if rows:
                yield _batch(rows, to_arrow_schema(out_schema))

    def whole(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = [(doc, tag, len(words := text.split()), finish(words)) for doc, tag, text in zip(
                part.column("doc_id").to_pylist(), part.column("tag").to_pylist(), text_bytes(part.column("text")), strict=True)]
            if rows:
                yield _batch(rows, to_arrow_schema(own_schema))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), TAG("text").alias("tag"), "text")
    some = squeezed(likely_members(texts.withColumnRenamed("tag", "of_tag"), "doc_id", cuts, "doc")).join(cuts, (F.col("doc_id") == F.col("doc")) & (F.col("of_tag") == F.col("tag")))
    done = stored(some.select("doc", "tag", "cuts", "text").mapInArrow(cut, out_schema).dropDuplicates(["cut_doc", "cut_tag"]), "recompression_done")
    joined = texts.mapInArrow(whole, own_schema).join(done, (F.col("doc_id") == F.col("cut_doc")) & (F.col("own_tag") == F.col("cut_tag")), "left")
    return joined.select("doc_id", "n_words", F.coalesce("cut_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("cut_kept", "own_kept").alias("kept"))
