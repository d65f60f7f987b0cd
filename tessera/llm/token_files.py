"""Token ids in binary files: every document a zstandard frame of its own, all with one dictionary, behind an index of offsets.

A folder holds ``files`` (the binary files), ``index`` (document to file and offset, Parquet) and ``dictionary`` (one row). A file is, in little-endian order,

    magic 8 bytes | width of an id 1 | SHA-256 of the dictionary 32 | ids before the file 8 | documents n 8
    n flags 1 (1: the document has an id) | n ids of documents 8 | n numbers of tokens 8 | n + 1 offsets of frames 8
    the frames | line feed

with offsets counted from the first frame. Files are written by Spark's text writer, one row a file, so they go through Spark's committer to any
store that Spark can write and a lost executor leaves no half file behind.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import discard, partitions, schema, stored, text_bytes
from .encoding import GROUP_BYTES, Encoder, forget_encoder, worker_encoder

END_ID, LEVEL = 1, 3
#: The dictionary is trained on at most so many documents' first bytes, those of the smallest hashes; everything else reads all rows whole.
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES = 1000, 4096, 32768
FILE_BYTES = 8 << 20
MAGIC, HEAD = b"tokfile1", "<8sB32sQQ"
ENCODED = schema("bucket int, doc_id long, n_tokens long, ids_crc32 long, ids binary")
FRAME = schema("path string, doc_id long, start long, n_tokens long, offset long, length long")
TOKENS = schema("doc_id long, start long, n_tokens long, ids_crc32 long")


def _encoded(docs: DataFrame, tokenizer: str, end_id: int, bounds: list[int]) -> DataFrame:
    arrow = to_arrow_schema(ENCODED)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = worker_encoder(tokenizer), np.array([end_id], "<u4")

        def batch(ids: list[int | None], texts: list[bytes]) -> pa.RecordBatch:
            every = [np.append(x, last).astype("<u4") for x in encode(texts)]
            at = np.searchsorted(np.array(bounds, np.int64), np.array([-(1 << 63) if d is None else d for d in ids], np.int64), side="right")
            columns = (at, ids, [len(x) for x in every], [zlib.crc32(x) for x in every], [x.astype(f"<u{encode.width}").tobytes() for x in every])
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        ids, texts, size = [], [], 0
        for part in parts:
            for doc, text in zip(part.column("doc_id").to_pylist(), text_bytes(part.column("text")), strict=True):
                ids.append(doc)
                texts.append(text)
                size += len(text) + 64
                if size > GROUP_BYTES:
                    yield batch(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield batch(ids, texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ENCODED)


def train(samples: list[bytes]) -> bytes:
    """A dictionary of at most ``DICTIONARY_BYTES``; samples too few to train one are the dictionary themselves."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _dictionary(content: bytes):
    import zstandard

    # Shorter ones than 8 bytes count as none.
    return zstandard.ZstdCompressionDict(content) if len(content) >= 8 else None


def pack_file(width: int, digest: bytes, before: int, docs: list[tuple[int | None, int, bytes]]) -> bytes:
    """One file, without the line feed, of ``(doc_id, n_tokens, frame)``."""
    n = len(docs)
    offsets = np.cumsum([0, *(len(f) for _, _, f in docs)]).astype("<u8")
    return b"".join([struct.pack(HEAD, MAGIC, width, digest, before, n), np.array([d is not None for d, _, _ in docs], "u1").tobytes(),
                     np.array([d or 0 for d, _, _ in docs], "<i8").tobytes(), np.array([k for _, k, _ in docs], "<u8").tobytes(), offsets.tobytes(),
                     *(f for _, _, f in docs)])


class TokenFile:
    """A file's index; frames are decompressed one at a time, when asked for."""

    def __init__(self, content: bytes, dictionary: bytes):
        import zstandard

        magic, self.width, digest, before, n = struct.unpack_from(HEAD, content)
        if magic != MAGIC:
            raise ValueError("not a token file")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("the file was written with another dictionary")
        self.content, at = memoryview(content), struct.calcsize(HEAD) + n
        there = np.frombuffer(content, "u1", n, at - n)
        self.doc_ids = [d if t else None for d, t in zip(np.frombuffer(content, "<i8", n, at).tolist(), there, strict=True)]
        self.n_tokens = np.frombuffer(content, "<u8", n, at + 8 * n).astype(np.int64)
        self.offsets = np.frombuffer(content, "<u8", n + 1, at + 16 * n).astype(np.int64)
        self.starts = before + np.cumsum(self.n_tokens) - self.n_tokens
        self.frames = at + 24 * n + 8
        self.reader = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def ids(self, k: int) -> np.ndarray:
        """Ids of the file's document number ``k``, from its own frame alone."""
        frame = self.content[self.frames + self.offsets[k]:self.frames + self.offsets[k + 1]]
        return np.frombuffer(self.reader.decompress(frame), f"<u{self.width}").astype("<u4")


def _written(rows: DataFrame, width: int, dictionary: bytes, before: list[int], file_bytes: int) -> DataFrame:
    """Rows of one column, a file each, of rows that come bucket by bucket in ascending order."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        forget_encoder()
        shared, digest = _dictionary(dictionary), hashlib.sha256(dictionary).digest()
        if shared:
            shared.precompute_compress(level=LEVEL)
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=True)
        held, size, at, bucket = [], 0, 0, None

        def flush() -> pa.RecordBatch:
            total = sum(k for _, k, _ in held)
            return pa.RecordBatch.from_pydict({"file": pa.array([pack_file(width, digest, at - total, held)], pa.binary())})

        for part in parts:
            for b, doc, n, ids in zip(part.column("bucket").to_pylist(), part.column("doc_id").to_pylist(), part.column("n_tokens").to_pylist(), part.column("ids"), strict=True):
                if held and (b != bucket or size >= file_bytes):
                    yield flush()
                    held, size = [], 0
                if b != bucket:
                    bucket, at = b, before[b]
                held.append((doc, n, press.compress(ids.as_buffer())))
                size, at = size + len(held[-1][2]), at + n
        if held:
            yield flush()

    # As a string the bytes stay what they are: Spark does not check them, and the text writer copies them.
    return rows.mapInArrow(run, schema("file binary")).select(F.col("file").cast("string").alias("value"))


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> None:
    """Writes ``docs (doc_id, text)`` to ``folder``, a new folder in a store that all executors reach, in ascending order of ``doc_id``.

    ``tokenizer`` is the file of a white-space dropping tokenizer, at the same place on every machine. A document's ids end with ``end_id``; a null or empty text
    has that one alone. Rows without an id come first; rows that share an id follow one another, by number of tokens and checksum; repeated
    rows are written as often as they occur. Extra columns are ignored; an empty table gives a folder without files. Ids of documents are
    taken to be nearly unique: those of one id go to one task.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [i / n for i in range(1, n)], 100 * n)).first()[0] if n > 1 else []
    bounds = sorted(set(cuts or []))
    encoded = stored(_encoded(docs, tokenizer, end_id, bounds), "encoded")
    totals = {b: t for b, t in encoded.groupBy("bucket").agg(F.sum("n_tokens")).collect()}  # one row a bucket
    before = np.cumsum([0, *(totals.get(b, 0) for b in range(len(bounds) + 1))]).tolist()
    key = F.xxhash64("doc_id", "ids_crc32")
    last = encoded.select(key.alias("key")).distinct().orderBy("key").limit(SAMPLE).agg(F.max("key")).first()[0]
    sample = encoded.where(key <= F.lit(last)).groupBy(key.alias("key")).agg(F.min(F.substring("ids", 1, SAMPLE_BYTES)).alias("ids")).orderBy("key").collect() if last is not None else []
    dictionary = train([bytes(r.ids) for r in sample])
    spark.createDataFrame([(hashlib.sha256(dictionary).hexdigest(), dictionary)], "sha256 string, dictionary binary").write.parquet(f"{folder}/dictionary")
    rows = encoded.repartition(n, "bucket").sortWithinPartitions("bucket", "doc_id", "n_tokens", "ids_crc32")
    _written(rows, Encoder(tokenizer).width, dictionary, before, file_bytes).write.option("maxRecordsPerFile", 1).option("compression", "none").text(f"{folder}/files")
    discard(encoded)
    _opened(spark, folder).mapInArrow(_frames(dictionary), FRAME).write.parquet(f"{folder}/index")


def _opened(spark: SparkSession, folder: str, paths: list[str] | None = None) -> DataFrame:
    return spark.read.format("binaryFile").load(paths or f"{folder}/files").where("length > 0").select("path", "content")


def _parsed(dictionary: bytes, parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, TokenFile]]:
    for part in parts:
        for path, content in zip(part.column("path").to_pylist(), part.column("content"), strict=True):
            yield path, TokenFile(content.as_buffer(), dictionary)


def _columns(fields: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)


def _frames(dictionary: bytes):
    arrow = to_arrow_schema(FRAME)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, f in _parsed(dictionary, parts):
            yield _columns(arrow, [path] * len(f.doc_ids), f.doc_ids, f.starts, f.n_tokens, f.offsets[:-1], np.diff(f.offsets))

    return run


def stored_dictionary(spark: SparkSession, folder: str) -> bytes:
    row = spark.read.parquet(f"{folder}/dictionary").first()
    if hashlib.sha256(row.dictionary).hexdigest() != row.sha256:
        raise ValueError("the dictionary is damaged")
    return bytes(row.dictionary)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the ids decompressed."""
    dictionary, arrow = stored_dictionary(spark, folder), to_arrow_schema(TOKENS)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, f in _parsed(dictionary, parts):
            every = [f.ids(k) for k in range(len(f.doc_ids))]
            yield _columns(arrow, f.doc_ids, f.starts, [len(x) for x in every], [zlib.crc32(x) for x in every])

    return _opened(spark, folder).mapInArrow(run, TOKENS)


def fetch(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """``doc_id, ids`` of some documents: the index names their files, only those are opened, and only their frames decompressed."""
    asked, dictionary = set(doc_ids), stored_dictionary(spark, folder)
    paths = [r.path for r in spark.read.parquet(f"{folder}/index").where(F.col("doc_id").isin(*asked)).select("path").distinct().collect()]
    kind = "doc_id long, ids array<long>"
    if not paths:
        return spark.createDataFrame([], kind)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, f in _parsed(dictionary, parts):
            found = [k for k, d in enumerate(f.doc_ids) if d in asked]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([f.doc_ids[k] for k in found], pa.int64()), "ids": pa.array([f.ids(k).tolist() for k in found], pa.list_(pa.int64()))})

    return _opened(spark, folder, paths).mapInArrow(run, kind)
