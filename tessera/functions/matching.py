"""Exact substring joins between a table of terms and a table of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import fits, materialise
from .members import likely_members

GRAM = 3
#: So many terms are looked for in every text, in one pass; finding and keying grams costs a text more than that. Both ways are exact.
FEW_TERMS = 64
#: Bits of a gram's cell: maps and counts of grams have a fixed size, whatever the number of terms.
CELL_BITS = 18


def _cells(data: np.ndarray, size: int) -> np.ndarray:
    """The cell of the ``size`` bytes from each place of ``data`` on."""
    n = max(0, len(data) - size + 1)
    h = np.full(n, 2166136261 + size, np.uint32)
    for i in range(size):
        h = (h ^ data[i:i + n]) * np.uint32(16777619)
    return (h ^ (h >> np.uint32(15))) >> np.uint32(32 - CELL_BITS)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes, one after another, and where each begins, with the end of the last."""
    texts = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    values = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return values[offsets[0]:offsets[-1]], offsets - offsets[0]


def _term_cells(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, size, cell) for every gram of every term; a term shorter than a gram is its own gram."""
    for part in parts:
        rows = []
        for term in part.column(0).to_pylist():
            data = np.frombuffer(term.encode(), np.uint8)
            size = min(GRAM, len(data))
            rows += [(term, size, int(c)) for c in set(_cells(data, size).tolist())]
        columns = list(zip(*rows)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32())], ["term", "size", "cell"])


def _counting(wanted: np.ndarray, sizes: list[int]) -> Callable:
    """(cell, n): how often the wanted cells occur, one row a cell and task."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted), np.int64)
        for part in parts:
            data, _ = _flat(part.column(1))
            for size in sizes:
                cells = _cells(data, size)
                total += np.bincount(cells[wanted[cells]], minlength=len(total))
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], ["cell", "n"])

    return run


def _finding(taken: np.ndarray, sizes: list[int]) -> Callable:
    """(key, text, cell) for the texts that hold a taken cell."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            data, starts = _flat(part.column(1))
            found = []
            for size in sizes:
                cells = _cells(data, size)
                at = np.flatnonzero(taken[cells])
                row = np.searchsorted(starts, at, side="right") - 1
                inside = at + size <= starts[row + 1]
                found.append((row[inside] << CELL_BITS) | cells[at[inside]].astype(np.int64))
            pairs = np.unique(np.concatenate(found))
            row = pa.array(pairs >> CELL_BITS)
            yield pa.RecordBatch.from_arrays([part.column(0).take(row), part.column(1).take(row), pa.array((pairs & ((1 << CELL_BITS) - 1)).astype(np.int32))], ["key", "text", "cell"])

    return run


def _map_of(cells: DataFrame) -> np.ndarray:
    """Which cells there are; at most 2^CELL_BITS numbers come to the driver."""
    taken = np.zeros(1 << CELL_BITS, bool)
    taken[[r[0] for r in cells.select("cell").distinct().collect()]] = True
    return taken


def contains_join(terms: DataFrame, texts: DataFrame, term: str = "term", text: str = "hay",
                  key: str = "node_id") -> DataFrame:
    """Rows of ``texts`` beside every distinct term they contain, as an equi-join for a term table of any size.

    ``terms`` holds distinct non-empty terms in column ``term``; ``texts`` holds
    one row per ``key``. Both sides must already be folded.

    A text holding a term holds every gram of it, three bytes long. How often the
    terms' grams occur is counted over all texts first, in cells of a sketch of
    fixed size, so that nothing is written per text. Each term is keyed by its
    rarest cell, so that common grams do not become hot keys. A second pass sends
    on only texts that hold a keyed cell, the join is by cell, and the literal
    test settles each match. A few terms are tested on every text instead.
    """
    kind = texts.schema[key].dataType
    named = materialise(terms.select(F.col(term).alias("term")).distinct(), "terms")
    if fits(named, FEW_TERMS):
        return _beside(texts.select(key, F.col(text).alias("text")).join(F.broadcast(named), F.contains("text", "term")).select(key, "term"), texts, key)
    of_terms = materialise(named.mapInArrow(_term_cells, "term string, size int, cell int"), "term_grams")
    sizes = sorted(r[0] for r in of_terms.select("size").distinct().collect())  # at most three
    if not sizes:
        return texts.where("false").withColumn(term, F.lit(None).cast("string"))
    keyed_texts = texts.select(F.col(key).alias("key"), F.col(text).alias("text"))
    counts = keyed_texts.mapInArrow(_counting(_map_of(of_terms), sizes), "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    keyed = materialise(of_terms.join(counts, "cell", "left").groupBy("term").agg(
        F.min_by("cell", F.struct(F.coalesce("n", F.lit(0)), "cell")).alias("cell")), "keyed_terms")
    found = T.StructType([T.StructField("key", kind), T.StructField("text", T.StringType()), T.StructField("cell", T.IntegerType())])
    matches = (
        keyed_texts.mapInArrow(_finding(_map_of(keyed), sizes), found).join(keyed, "cell")
        .where(F.contains("text", "term")).select(F.col("key").alias(key), F.col("term").alias(term)))
    return _beside(matches, texts, key)


def _beside(matches: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """The matches (key, term), stored, beside the texts they are of; other texts stay where they lie."""
    matched = materialise(matches, "term_matches")
    return matched.join(likely_members(texts, key, matched), key)
