"""Packing into training sequences: bounded-space online best fit in every task, leftovers merged level by level.

Each task keeps a fixed number of open windows. A piece goes into the window it fills best; when none has room and all are open,
the fullest is emitted. What is still open at a task's end is packed again with that of a few other tasks, and so on until one task is left, so that
no task ever holds more than ``FAN_IN`` times the open windows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import batches, schema, stored, text_bytes
from .encoding import GROUP_BYTES, worker_encoder

SEQUENCE, OPEN_WINDOWS, FAN_IN, END_ID = 4096, 64, 16, 2
PIECE = schema("doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
PLACED = schema("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, open boolean, task long")


class Packer:
    """Windows being filled; rows come out as windows close."""

    def __init__(self, level: int, task: int, size: int, open_windows: int):
        self.base, self.task, self.size, self.open_windows = (level << 56) | (task << 28), task, size, open_windows
        self.free: list[tuple[int, int]] = []  # room left and number of each open window, in order
        self.held: dict[int, list[tuple]] = {}
        self.count = 0

    def _emit(self, number: int, still_open: bool) -> list[tuple]:
        rows, offset = [], 0
        for piece in self.held.pop(number):
            rows.append((*piece, self.base | number, offset, still_open, self.task))
            offset += piece[2]
        return rows

    def _new(self) -> int:
        self.count += 1
        self.held[self.count - 1] = []
        return self.count - 1

    def place(self, piece: tuple) -> list[tuple]:
        length, out = piece[2], []
        at = bisect_left(self.free, (length, -1))
        if at < len(self.free):
            room, number = self.free.pop(at)
        else:
            if length < self.size and len(self.free) >= self.open_windows:
                out = self._emit(self.free.pop(0)[1], False)
            room, number = self.size, self._new()
        self.held[number].append(piece)
        if room == length:
            return out + self._emit(number, False)
        insort(self.free, (room - length, number))
        return out

    def rest(self, still_open: bool) -> list[tuple]:
        return [r for _, number in self.free for r in self._emit(number, still_open)]


def pack(docs: DataFrame, tokenizer: str, size: int = SEQUENCE, open_windows: int = OPEN_WINDOWS, end_id: int = END_ID) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    ``tokenizer`` is the file of a white-space dropping tokenizer, at the same place on every machine. A document's ids end with ``end_id``, so
    null and empty texts have one id. Documents longer than a sequence give full sequences from their start; only their rest is
    packed, uncut. A sequence is full, or lacks what no open piece fitted. Repeated rows are packed as often as they occur, null ids
    of documents stay null, extra columns are ignored, and an empty table gives no rows. Ids of sequences are unique, not dense.
    """
    arrow = to_arrow_schema(PLACED)
    def first(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, last = worker_encoder(tokenizer), Packer(0, TaskContext.get().partitionId(), size, open_windows), np.array([end_id], "<u4")

        def placed(docs: list[int | None], texts: list[bytes]) -> Iterator[tuple]:
            for doc, found in zip(docs, encode(texts), strict=True):
                ids = np.append(found, last).astype("<u4")
                for start in range(0, len(ids), size):
                    cut = ids[start:start + size]
                    yield from packer.place((doc, start, len(cut), zlib.crc32(cut), len(ids)))

        def rows() -> Iterator[tuple]:
            docs, texts, held = [], [], 0
            for part in parts:
                for doc, text in zip(part.column("doc_id").to_pylist(), text_bytes(part.column("text")), strict=True):
                    docs.append(doc)
                    texts.append(text)
                    held += len(text) + 64
                    if held > GROUP_BYTES:
                        yield from placed(docs, texts)
                        docs, texts, held = [], [], 0
            yield from placed(docs, texts)
            yield from packer.rest(True)

        yield from batches(arrow, rows())

    def again(level: int, last: bool):
        def run(part: pa.Table) -> pa.Table:
            task = part.column("task")[0].as_py() // FAN_IN
            packer = Packer(level, task, size, open_windows)
            # Larger pieces first; the other columns make the order the same in every attempt.
            pieces = sorted(zip(*(part.column(c).to_pylist() for c in PIECE.names), strict=True), key=lambda p: (-p[2], p[0] is None, p))
            rows = [r for p in pieces for r in packer.place(p)] + packer.rest(not last)
            return pa.Table.from_batches(list(batches(arrow, rows)), schema=arrow)

        return run

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    placed = stored(text.mapInArrow(first, PLACED), "packed_0")
    done, left, level = placed.where("not open"), placed.where("open"), 0
    tasks = (left.agg(F.max("task")).first()[0] or 0) + 1
    while True:
        tasks, level = -(-tasks // FAN_IN), level + 1
        repacked = left.groupBy(F.floor(F.col("task") / FAN_IN).alias("group")).applyInArrow(again(level, tasks == 1), PLACED)
        if tasks == 1:
            return done.unionAll(repacked).drop("open", "task")
        repacked = stored(repacked, f"packed_{level}")
        done, left = done.unionAll(repacked.where("not open")), repacked.where("open")
