"""Substring dedup by a logarithmic family of sparse suffix arrays.

Of each document's suffixes those are indexed that start at an anchor: the smallest hash of 8 bytes among the 8-byte strings of a window of
``length`` bytes. A window's anchor depends on the window alone, so two documents that share ``length`` bytes share an anchored suffix there.

Batches of documents arrive in order of ``doc_id``. A batch gets its suffix array; a scan merges it with itself and with every level and
marks the suffixes met in two documents; levels of equal size merge when the next batch arrives, so there are at most log2(batches) of them and
each suffix is rewritten as often. Levels are tables bucketed by suffix, so scans and merges shuffle nothing but the new batch.
Then the marked suffixes alone are looked up in the texts, and each window around them is compared in full.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import carry, partitions, restore, schema, squeezed, stored, text_bytes, unsqueezed
from .graph import likely_members
from .ngram_join import mixed

GRAM, CHUNK, HELD = 8, 1 << 20, 8 << 20
ENTRY = schema("route int, kind int, prefix binary, right binary, left binary, doc binary")
MARK, MARKS = schema("home int, doc binary, key binary"), schema("doc long, keys binary")
SPAN = schema("route int, kind int, prefix binary, doc binary, tag binary, start binary, lead binary, size binary, bytes binary")
RANGE, CUT = schema("home int, doc binary, tag binary, low binary, high binary"), schema("doc long, tag int, cuts binary")
U64 = np.uint64


def grams(b: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a big-endian number, without a copy: numbers order as the bytes do."""
    return np.ndarray((len(b) - 7,), ">u8", b, strides=(1,))


def load(b: np.ndarray, at: np.ndarray) -> np.ndarray:
    return grams(b)[at].astype(U64)


def planes(a: np.ndarray) -> bytes:
    """The bytes of an integer array, all first bytes, then all second ones: runs that Spark's compression sees."""
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def unplanes(b: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).ravel()


#: Tells apart texts that share a ``doc_id``.
TAG = F.hash


class Anchors:
    """The anchored suffixes of a chunk of texts. Parallel arrays, one element per run of windows with one anchor."""

    def __init__(self, pieces: list[tuple[int, int, int, bytes]], length: int):
        # pieces: document, tag, where in the document, bytes
        reach, half = length - GRAM + 1, (length - GRAM) // 2
        sizes = np.array([len(p[3]) for p in pieces], np.int64)
        ends = np.cumsum(sizes)
        b = np.frombuffer(b"".join(p[3] for p in pieces) + bytes(GRAM), np.uint8)
        n = int(ends[-1])
        gram = grams(b)[:n].astype(U64)
        low = (mixed(gram) & ~U64(0xFFFFFF)) | np.arange(n, dtype=U64)  # smallest hash, of equals the leftmost
        step = 1
        while step * 2 <= reach:
            low = np.minimum(low[:-step], low[step:]) if len(low) > step else low[:0]
            step *= 2
        rest = reach - step
        low = np.minimum(low[:len(low) - rest], low[rest:]) if len(low) > rest else low[:0]
        owner = np.repeat(np.arange(len(pieces)), np.maximum(sizes - length + 1, 0))
        begins = ends - sizes
        s = np.arange(len(owner)) - (np.cumsum(np.maximum(sizes - length + 1, 0)) - np.maximum(sizes - length + 1, 0))[owner] + begins[owner]
        a = (low[s] & U64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (owner[1:] != owner[:-1])]) if len(s) else np.zeros(0, np.int64)
        last = np.r_[first[1:], len(s)] - 1 if len(s) else first
        self.bytes, self.at, self.begin, self.end = b, a[first], s[first], s[last]  # windows start at begin..end
        self.piece = owner[first] if len(s) else first
        self.prefix = gram[self.at]
        has_right, has_left = self.at - self.end <= half, self.at - self.begin >= half
        # Every window holds the anchor with `half` bytes and a gram to its right or `half` to its left.
        self.right = self._print(has_right, [self.at + GRAM + x for x in self._steps(half)])
        self.left = self._print(has_left, [self.at - half + x for x in self._steps(half)])
        ids = np.array([p[0] for p in pieces], np.int64)
        self.doc = ids[self.piece]
        self.tag = np.array([p[1] for p in pieces], np.int32)[self.piece]
        self.start = self.begin - begins[self.piece] + np.array([p[2] for p in pieces], np.int64)[self.piece]

    @staticmethod
    def _steps(size: int) -> list[int]:
        return [*range(0, size - 7, 8), size - 8] if size >= 8 else []

    def _print(self, where: np.ndarray, at: list[np.ndarray]) -> np.ndarray:
        out, some = np.zeros(len(where), np.uint16), np.flatnonzero(where)
        h = self.prefix[some]
        for x in at:
            h = mixed(h ^ load(self.bytes, x[some]))
        out[some] = (h >> U64(48)).astype(np.uint16) | np.uint16(1)
        return out


def mark_of(prefix: np.ndarray, right: np.ndarray, left: np.ndarray) -> np.ndarray:
    """16 bits by which a document knows its own suffix again."""
    return (mixed(prefix ^ (right.astype(U64) << U64(16)) ^ left.astype(U64), 5) >> U64(48)).astype(np.uint16)


def chunks(texts: Iterable[tuple], length: int) -> Iterator[tuple[Anchors, list]]:
    """Anchors of about CHUNK bytes at a time. Texts are ``document, tag, extra, bytes``; long ones are parted so that each window falls in one part."""
    held, size, extras = [], 0, []
    for doc, tag, extra, text in texts:
        for p in range(0, max(1, len(text) - length + 1), CHUNK):
            held.append((doc, tag, p, text[p:p + CHUNK + length - 1]))
            extras.append(extra)
            size += len(held[-1][3])
            if size >= CHUNK:
                yield Anchors(held, length), extras
                held, size, extras = [], 0, []
    if held:
        yield Anchors(held, length), extras


def route_of(prefix: np.ndarray, routes: int) -> np.ndarray:
    return ((mixed(prefix, 7) >> U64(32)) % U64(routes)).astype(np.int32)


def runs(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Where groups of equal keys begin in ``order``."""
    change = np.zeros(max(len(order) - 1, 0), bool)
    for k in keys:
        change |= k[order][1:] != k[order][:-1]
    return np.flatnonzero(np.r_[True, change]) if len(order) else np.zeros(0, np.int64)


def extents(begins: np.ndarray, total: int) -> Iterator[tuple[int, int]]:
    """Begin and end of each group."""
    return zip(begins.tolist(), [*begins[1:].tolist(), total][:len(begins)], strict=True)


def per_document(doc: np.ndarray, value: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Each document with its distinct values."""
    both = np.unique(np.rec.fromarrays([doc, value], names="d,v"))
    begins = runs(np.arange(len(both)), both.d)
    for i, j in extents(begins, len(both)):
        yield int(both.d[i]), both.v[i:j].tobytes()


def routed(route: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each route with the places that go there."""
    order = np.argsort(route, kind="stable")
    return ((int(route[order[i]]), order[i:j]) for i, j in extents(runs(order, route), len(order)))


def read(rows: pa.Table, column: str, kind: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(unplanes(x.as_py(), kind) for x in rows.column(column))])


def of_kind(part: pa.Table, kind: int) -> pa.Table:
    return part.filter(pc.equal(part.column("kind"), kind))


def homed(names: pa.Schema, routes: int, doc: np.ndarray, *columns: np.ndarray) -> pa.Table:
    """Results of many documents, one packed row for each route that their documents belong to."""
    rows = [(r, planes(doc[e]), *(planes(c[e]) for c in columns)) for r, e in routed(route_of(doc.view(U64), routes))]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [()] * len(names), names, strict=True)], schema=names)


def gather_marks(part: pa.Table) -> pa.Table:
    """One row per document with its distinct marks."""
    rows = list(per_document(read(part, "doc", "<i8"), read(part, "key", "<u2")))
    return pa.table({"doc": pa.array([d for d, _ in rows], pa.int64()), "keys": pa.array([k for _, k in rows], pa.binary())})


def gather_cuts(part: pa.Table) -> pa.Table:
    """One row per document with its ranges, those that touch made one."""
    doc, tag, low, high = (read(part, c, k) for c, k in (("doc", "<i8"), ("tag", "<i4"), ("low", "<i4"), ("high", "<i4")))
    order = np.lexsort((low, tag, doc))
    begins, ranges = runs(order, doc, tag), np.c_[low, high][order]
    return pa.table({"doc": pa.array(doc[order][begins]), "tag": pa.array(tag[order][begins]), "cuts": pa.array(
        [merged_cuts(ranges[i:j]).tobytes() for i, j in extents(begins, len(order))], pa.binary())})


def batch_entries(texts: DataFrame, routes: int, length: int) -> DataFrame:
    """The suffix array of ``texts`` in one sorted part per route and task (kind 0), and marks (kind 1) of suffixes that a task met
    in two documents. Of such suffixes the first document's alone is indexed, so a passage of very many documents gives one entry a task."""
    arrow = to_arrow_schema(ENTRY)

    def emit(held: list[Anchors]) -> Iterator[pa.RecordBatch]:
        prefix, right, left, doc = (np.concatenate([getattr(x, c) for x in held]) for c in ("prefix", "right", "left", "doc"))
        order = np.lexsort((doc, left, right, prefix))
        begins = runs(order, prefix, right, left)
        sizes = np.diff(np.r_[begins, len(order)])
        several = np.repeat(doc[order][begins] != doc[order][begins + sizes - 1], sizes)
        marked = order[several]
        kept = order[begins]
        rows = [(r, 0, planes(prefix[e]), planes(right[e]), planes(left[e]), planes(doc[e]))
                for r, e in ((r, kept[at]) for r, at in routed(route_of(prefix[kept], routes)))]
        key = mark_of(prefix[marked], right[marked], left[marked])
        rows += [(r, 1, b"", planes(key[at]), b"", planes(doc[marked][at])) for r, at in routed(route_of(doc[marked].view(U64), routes))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = ((d, 0, None, t) for part in parts for d, t in zip(part.column("doc_id").to_pylist(), text_bytes(part.column("text")), strict=True))
        held, size = [], 0
        for anchors, _ in chunks(texts, length):
            held.append(anchors)
            size += len(anchors.bytes)
            anchors.bytes = anchors.bytes[:0]
            size += CHUNK
            if size >= HELD:
                yield from emit(held)
                held, size = [], 0
        if held:
            yield from emit(held)

    return texts.mapInArrow(run, ENTRY)


def _entries(part: pa.Table) -> tuple[np.ndarray, ...]:
    rows = of_kind(part, 0)
    return read(rows, "prefix", "<u8"), read(rows, "right", "<u2"), read(rows, "left", "<u2"), read(rows, "doc", "<i8")


def _meet(prefix: np.ndarray, side: np.ndarray, doc: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Which entries share prefix and fingerprint with another document, one of them being new."""
    order = np.lexsort((side, prefix))
    begins = runs(order, prefix, side)
    sizes = np.diff(np.r_[begins, len(order)])
    out = np.zeros(len(order), bool)
    if len(order):
        d = doc[order]
        met = (np.minimum.reduceat(d, begins) != np.maximum.reduceat(d, begins)) & np.maximum.reduceat(new[order], begins) & (side[order][begins] != 0)
        out[order] = np.repeat(met, sizes)
    return out


def merge_scan(part: pa.Table, level: pa.Table | None, routes: int) -> pa.Table:
    """Marks of all suffixes that the batch shares with the level, or within itself if there is none."""
    sides = [_entries(part)] + ([_entries(level)] if level is not None else [])
    prefix, right, left, doc = (np.concatenate(x) for x in zip(*sides, strict=True))
    new = np.arange(len(doc)) < len(sides[0][3])
    met = _meet(prefix, right, doc, new) | _meet(prefix, left, doc, new)
    docs, keys = doc[met], mark_of(prefix[met], right[met], left[met])
    if level is None:
        known = of_kind(part, 1)
        docs, keys = np.r_[docs, read(known, "doc", "<i8")], np.r_[keys, read(known, "right", "<u2")]
    return homed(to_arrow_schema(MARK), routes, docs, keys)


def merge_levels(a: pa.Table, b: pa.Table) -> pa.Table:
    """Two levels' parts as one sorted part. Of a suffix in several documents, all marked by now, the first document's entry stays."""
    route = (a if a.num_rows else b).column("route")[0].as_py()
    prefix, right, left, doc = (np.concatenate(x) for x in zip(_entries(a), _entries(b), strict=True))
    order = np.lexsort((doc, left, right, prefix))
    kept = order[runs(order, prefix, right, left)]
    row = [route], [0], [planes(prefix[kept])], [planes(right[kept])], [planes(left[kept])], [planes(doc[kept])]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(row, to_arrow_schema(ENTRY), strict=True)], schema=to_arrow_schema(ENTRY))


class SuffixIndex:
    """The family of levels. ``append`` batches in order of ``doc_id``; it returns the marks that the batch adds."""

    def __init__(self, spark: SparkSession, length: int = 50):
        self.spark, self.length, self.routes = spark, length, partitions(spark)
        self.levels: list[tuple[int, str]] = []  # batches in it, table

    def _store(self, entries: DataFrame) -> str:
        name = f"tessera_suffixes_{uuid.uuid4().hex}"
        entries.write.bucketBy(self.routes, "route").format("parquet").saveAsTable(name)
        self.spark.sparkContext._jvm.System.gc()  # as in ``stored``
        return name

    def _by_route(self, name: str):
        return self.spark.table(name).groupBy("route")

    def append(self, texts: DataFrame) -> list[DataFrame]:
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (n, a), (m, b) = self.levels.pop(), self.levels.pop()
            merged = self._by_route(b).cogroup(self._by_route(a)).applyInArrow(merge_levels, ENTRY)
            self.levels.append((n + m, self._store(merged)))
            for old in (a, b):
                self.spark.sql(f"DROP TABLE {old}")
        new = self._store(batch_entries(texts, self.routes, self.length).repartition(self.routes, "route"))
        routes = self.routes
        marks = [self._by_route(new).applyInArrow(lambda part: merge_scan(part, None, routes), MARK)]
        marks += [self._by_route(new).cogroup(self._by_route(level)).applyInArrow(lambda part, old: merge_scan(part, old, routes), MARK)
                  for _, level in self.levels]
        marks = [stored(m, "suffix_marks") for m in marks]
        self.levels.append((1, new))
        return marks

    def drop(self) -> None:
        for _, name in self.levels:
            self.spark.sql(f"DROP TABLE {name}")
        self.levels = []


def _window_hash(b: np.ndarray, at: np.ndarray, length: int, seed: int) -> np.ndarray:
    h = np.full(len(at), seed, U64)
    for j in [*range(0, length - 7, 8), length - 8]:
        h = mixed(h ^ load(b, at + j), seed)
    return h


class Spans:
    """Byte strings around marked suffixes, as parallel arrays and one buffer."""

    FIELDS = (("prefix", "<u8"), ("doc", "<i8"), ("tag", "<i4"), ("start", "<i4"), ("lead", "<i4"), ("size", "<i4"))

    def __init__(self, arrays: list[np.ndarray], whole: np.ndarray, base: np.ndarray):
        self.prefix, self.doc, self.tag, self.start, self.lead, self.size = arrays
        self.bytes, self.base = whole, base

    def gather(self, some: np.ndarray) -> bytes:
        size = self.size[some].astype(np.int64)
        return self.bytes[np.repeat(self.base[some] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))].tobytes()

    def by_content(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order in which equal spans stand together, the first document first; which of them are that document's; and which a later one's."""
        whole = np.zeros(len(self.doc), U64)
        for n in np.unique(self.size):
            at = np.flatnonzero(self.size == n)
            whole[at] = _window_hash(self.bytes, self.base[at], int(n), 11) ^ mixed(np.full(len(at), n, U64))
        order = np.lexsort((self.doc, whole, self.lead, self.prefix))
        begins = runs(order, self.prefix, self.lead, whole)
        lowest = np.repeat(self.doc[order][begins], np.diff(np.r_[begins, len(order)]))
        return order, self.doc[order] == lowest, self.doc[order] > lowest

    def ranges(self, some: np.ndarray) -> tuple[np.ndarray, ...]:
        start = self.start[some].astype(np.int64)
        return self.doc[some], self.tag[some], start, start + self.size[some]


def marked_spans(rows: DataFrame, routes: int, length: int) -> DataFrame:
    """The bytes around each marked suffix of ``doc_id, tag, text, keys``, texts squeezed (kind 0): all windows that have it as their anchor. A task that meets the
    same bytes in a later document cuts them there at once (kind 1)."""
    arrow = to_arrow_schema(SPAN)

    def emit(held: list[Spans]) -> Iterator[pa.RecordBatch]:
        arrays = [np.concatenate([getattr(x, name) for x in held]) for name, _ in Spans.FIELDS]
        size = arrays[-1].astype(np.int64)
        s = Spans(arrays, np.concatenate([*(x.bytes for x in held), np.zeros(8, np.uint8)]), np.cumsum(size) - size)
        order, first, later = s.by_content()
        rows = []
        for kind, some in ((0, order[first]), (1, order[later])):
            for r, e in routed(route_of(s.prefix[some] if kind == 0 else s.doc[some].view(U64), routes)):
                e = some[e]
                fields = [planes(getattr(s, name)[e]) for name, _ in Spans.FIELDS]
                rows.append((r, kind, *fields, s.gather(e) if kind == 0 else b""))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = ((d, g, k, t) for part in parts for d, g, k, t in zip(
            part.column("doc_id").to_pylist(), part.column("tag").to_pylist(), part.column("keys").to_pylist(), unsqueezed(part.column("text")), strict=True))
        held, size = [], 0
        for a, keys in chunks(texts, length):
            own = mark_of(a.prefix, a.right, a.left)
            wanted = np.zeros(len(own), bool)
            for i, j in extents(runs(np.arange(len(own)), a.piece), len(own)):
                wanted[i:j] = np.isin(own[i:j], np.frombuffer(keys[a.piece[i]], "<u2"))
            i = np.flatnonzero(wanted)
            found = Spans([x.astype(kind) for x, (_, kind) in zip((a.prefix[i], a.doc[i], a.tag[i], a.start[i], a.at[i] - a.begin[i], a.end[i] + length - a.begin[i]),
                                                                 Spans.FIELDS, strict=True)], a.bytes, a.begin[i])
            found.bytes = np.frombuffer(found.gather(np.arange(len(i))), np.uint8)
            held.append(found)
            size += len(found.bytes)
            if size >= HELD:
                yield from emit(held)
                held, size = [], 0
        if held:
            yield from emit(held)

    return rows.mapInArrow(run, SPAN)


def compare_spans(part: pa.Table, length: int, routes: int) -> pa.Table:
    """The cuts of one route: windows whose bytes start in a document with a smaller id as well."""
    done, rows, half = of_kind(part, 1), of_kind(part, 0), (length - GRAM) // 2
    start = read(done, "start", "<i4").astype(np.int64)
    out = [(read(done, "doc", "<i8"), read(done, "tag", "<i4"), start, start + read(done, "size", "<i4"))]
    arrays = [read(rows, name, kind) for name, kind in Spans.FIELDS]
    size = arrays[-1].astype(np.int64)
    s = Spans(arrays, np.frombuffer(b"".join(x.as_py() for x in rows.column("bytes")) + bytes(8), np.uint8), np.cumsum(size) - size)
    # Equal spans first: a later document's are cut whole. All of the first document's stay, for each needs its own cuts.
    order, first, later = s.by_content()
    out.append(s.ranges(order[later]))
    rest = order[first]
    # A window holds the anchor and `half` bytes on one side of it. Where no other span has these, none of the windows on that side is met again.
    meets = {}
    for side, has, at in (("right", s.size[rest] - s.lead[rest] >= half + GRAM, s.lead[rest]), ("left", s.lead[rest] >= half, s.lead[rest] - half)):
        some = np.flatnonzero(has)
        h = _window_hash(s.bytes, s.base[rest[some]] + at[some], half + GRAM, 17)
        by = np.lexsort((h, s.prefix[rest[some]]))
        begins = runs(by, s.prefix[rest[some]], h)
        counts = np.diff(np.r_[begins, len(by)])
        meets[side] = np.zeros(len(rest), bool)
        meets[side][some[by]] = np.repeat(counts > 1, counts)
    some = np.flatnonzero(meets["right"] | meets["left"])
    right, left = np.zeros(len(s.doc), bool), np.zeros(len(s.doc), bool)
    right[rest], left[rest] = meets["right"], meets["left"]
    rest = rest[some]
    for i, j in _slices(rest, s.prefix, s.size - length + 1):
        e = rest[i:j]
        each = (s.size[e] - length + 1).astype(np.int64)
        of = np.repeat(e, each)
        shift = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
        place = s.lead[of] - shift  # of the anchor in the window
        wanted = np.where(place <= half, right[of], left[of])
        of, shift, place = of[wanted], shift[wanted], place[wanted]
        h = _window_hash(s.bytes, s.base[of] + shift, length, 13)
        order = np.lexsort((s.doc[of], h, place, s.prefix[of]))
        begins = runs(order, s.prefix[of], place, h)
        low = np.repeat(s.doc[of][order][begins], np.diff(np.r_[begins, len(order)]))
        gone = order[s.doc[of][order] > low]
        at = s.start[of[gone]].astype(np.int64) + shift[gone]
        out.append((s.doc[of[gone]], s.tag[of[gone]], at, at + length))
    doc, tag, low, high = (np.concatenate(x) for x in zip(*out, strict=True))
    return homed(to_arrow_schema(RANGE), routes, doc, tag, low.astype("<i4"), high.astype("<i4"))


def _slices(rest: np.ndarray, prefix: np.ndarray, windows: np.ndarray, most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Parts of whole prefix groups, of about ``most`` windows each."""
    groups = runs(rest, prefix)
    total, begin = 0, 0
    for i, j in extents(groups, len(rest)):
        total += int(windows[rest[i:j]].sum())
        if total >= most:
            yield begin, int(j)
            total, begin = 0, int(j)
    if begin < len(rest):
        yield begin, len(rest)


def merged_cuts(cuts: np.ndarray) -> np.ndarray:
    """Ranges ``[low, high)`` as disjoint ones in order; ranges that touch become one."""
    cuts = cuts[np.argsort(cuts[:, 0], kind="stable")]
    high = np.maximum.accumulate(cuts[:, 1])
    begin = np.flatnonzero(np.r_[True, cuts[1:, 0] > high[:-1]])
    return np.c_[cuts[begin, 0], high[np.r_[begin[1:] - 1, len(cuts) - 1]]].astype("<i4")


def find_cuts(docs: DataFrame, length: int = 50, batches: int = 4) -> DataFrame:
    """``doc, tag, cuts``: the byte ranges to remove from each document, packed."""
    spark, routes = docs.sparkSession, partitions(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    bounds = docs.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01)
    bounds = sorted({int(x) for x in bounds})
    index, marks = SuffixIndex(spark, length), []
    for low, high in zip([None, *bounds], [*bounds, None], strict=True):
        part = docs if low is None else docs.where(F.col("doc_id") > low)
        marks += index.append(part if high is None else part.where(F.col("doc_id") <= high))
    found = marks[0]
    for m in marks[1:]:
        found = found.unionAll(m)
    found = stored(found.groupBy("home").applyInArrow(gather_marks, MARKS), "suffix_found")
    index.drop()
    texts = squeezed(likely_members(docs, "doc_id", found, "doc").select("doc_id", TAG("text").alias("tag"), "text"))
    rows = texts.join(found, F.col("doc_id") == F.col("doc")).select("doc_id", "tag", "text", "keys")
    spans = marked_spans(rows, routes, length).repartition(routes, "route")
    cuts = spans.groupBy("route").applyInArrow(lambda part: compare_spans(part, length, routes), RANGE)
    return cuts.groupBy("home").applyInArrow(gather_cuts, CUT)


def dedup(docs: DataFrame, length: int = 50, batches: int = 4, outputs: dict[str, Callable[[Column], Column]] | None = None,
          whole_letters: bool = False) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_removed``, ``n_spans`` and the ``outputs``, each a function of the bytes that stay; by default ``kept``,
    the bytes themselves. Columns of those names are replaced.

    A byte goes if it lies in a string of ``length`` bytes of its document that also starts in a document with a smaller ``doc_id``; strings
    are judged on the input. Null and empty texts have no bytes. Rows with a null ``doc_id`` neither cut nor are cut; rows that share a
    ``doc_id`` don't cut each other and are told apart by their texts. An empty table gives an empty result.

    ``outputs`` are worked out before the rows meet their cuts, so that one that is short (a digest) keeps texts out of that shuffle.
    With ``whole_letters`` a cut takes along the rest of a letter that it runs through, and what stays is valid UTF-8.
    """
    outputs = outputs or {"kept": lambda b: b}
    rows = docs.drop("n_bytes", "n_removed", "n_spans", "cut_doc", "cut_tag", "cuts", *(f"own_{o}" for o in outputs))
    cuts = stored(find_cuts(docs, length, batches), "suffix_cuts")
    done = stored(cut_texts(rows, cuts, whole_letters).select("cut_doc", "cut_tag", F.col("n_removed").alias("cut_removed"), F.col("n_spans").alias("cut_spans"), *(
        f(F.col("kept")).alias(f"cut_{o}") for o, f in outputs.items())).dropDuplicates(["cut_doc", "cut_tag"]), "suffix_done")
    whole = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    own = rows.withColumns({"n_bytes": F.octet_length(whole).cast("long"), "own_tag": TAG("text"), **{f"own_{o}": f(whole) for o, f in outputs.items()}})
    columns = [c for c in rows.columns if c not in outputs]
    joined = own.join(done, (F.col("doc_id") == F.col("cut_doc")) & (F.col("own_tag") == F.col("cut_tag")), "left")
    return joined.select(*columns, "n_bytes", F.coalesce("cut_removed", F.lit(0).cast("long")).alias("n_removed"),
                         F.coalesce("cut_spans", F.lit(0).cast("long")).alias("n_spans"), *(F.coalesce(f"cut_{o}", f"own_{o}").alias(o) for o in outputs))


def _whole(text: bytes, low: int, high: int) -> tuple[int, int]:
    """The range widened to letters: UTF-8 marks the further bytes of one by 10 as their first bits."""
    while low > 0 and text[low] & 0xC0 == 0x80:
        low -= 1
    while high < len(text) and text[high] & 0xC0 == 0x80:
        high += 1
    return low, high


def cut_texts(rows: DataFrame, cuts: DataFrame, whole_letters: bool = False) -> DataFrame:
    """``cut_doc, cut_tag, kept, n_removed, n_spans`` of the texts that lose something; only these are shuffled."""
    out_schema = schema("cut_doc long, cut_tag int, kept binary, n_removed long, n_spans long")
    arrow = to_arrow_schema(out_schema)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for doc, tag, ranges, text in zip(*(part.column(c).to_pylist() for c in ("doc", "tag", "cuts")), unsqueezed(part.column("text")), strict=True):
                ranges = np.frombuffer(ranges, "<i4").reshape(-1, 2)
                if whole_letters:
                    ranges = merged_cuts(np.array([_whole(text, *x) for x in ranges.tolist()], "<i4"))
                edges = [0, *ranges.ravel().tolist(), len(text)]
                stays = b"".join(text[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True))
                out.append((doc, tag, stays, len(text) - len(stays), len(ranges)))
            columns = list(zip(*out, strict=True)) or [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    texts = rows.select(F.col("doc_id").cast("long").alias("doc_id"), TAG("text").alias("of_tag"), "text")
    same = (F.col("doc_id") == F.col("doc")) & (F.col("of_tag") == F.col("tag"))
    return squeezed(likely_members(texts, "doc_id", cuts, "doc")).join(cuts, same).select("doc", "tag", "cuts", "text").mapInArrow(run, out_schema)


def cut_repeats(docs: DataFrame, length: int = 50, batches: int = 4) -> DataFrame:
    """``docs`` with ``text`` (and ``n_chars``, if there) as the cuts of ``dedup`` leave it; a letter that a cut runs through goes as a whole.

    Texts that lose nothing stay as they are, null included, and no row goes.
    """
    own = [c for c in ("doc_id", "text", "n_chars") if c in docs.columns]
    found = dedup(carry(docs, *own).withColumn("no_text", F.col("text").isNull()), length, batches, {"text": lambda b: b.cast("string")}, whole_letters=True)
    cut = F.col("n_removed") > 0
    found = found.withColumn("text", F.when(~F.col("no_text"), F.col("text")))
    if "n_chars" in own:
        found = found.withColumn("n_chars", F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return restore(found, docs, *own)
