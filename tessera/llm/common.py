"""Small helpers the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from tessera.session import materialise

KINDS = {"long": LongType(), "int": IntegerType(), "binary": BinaryType(), "boolean": BooleanType(), "string": StringType()}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def schema(text: str) -> StructType:
    """``"a long, b binary"`` as a schema, without a session, so that tasks may import it."""
    return StructType([StructField(name, KINDS[kind]) for name, kind in (x.split() for x in text.split(","))])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z, and nothing else, in lower case."""
    return F.translate(text, UPPER, LOWER)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def stored(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` as a stage table in the shared folder, read back.

    Shuffle files go when the driver collects the garbage that refers to them, which a small driver may not do for half an hour. After a stage table
    nothing needs the shuffles before it, so the collection is asked for here and disks hold one stage's shuffles at a time.
    """
    # Before the stage, since right after the last one its last events still held on to the plan.
    rows.sparkSession.sparkContext._jvm.System.gc()
    return materialise(rows, name)


def discard(*tables: DataFrame) -> None:
    """Deletes stage tables that ``stored`` gave, once all that was made from them is stored itself."""
    for table in tables:
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def carry(rows: DataFrame, *own: str) -> DataFrame:
    """``rows`` with the columns ``own`` and all others in one, so that their names can't clash with an operator's."""
    others = [F.col(f"`{c}`") for c in rows.columns if c not in own]
    return rows.select(*own, (F.struct(*others) if others else F.lit(None)).alias("carried"))


def restore(rows: DataFrame, like: DataFrame, *own: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """The columns of ``like`` from rows made by ``carry``, and ``extra`` ones."""
    return rows.select(*(F.col(c) if c in own else F.col("carried").getField(c).alias(c) for c in like.columns), *extra)


def text_bytes(column: pa.ChunkedArray | pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text, one at a time; null is empty."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def squeezed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``text`` as zstandard frames, for a shuffle of whole texts; null is empty."""
    out = StructType([StructField("text", BinaryType()) if f.name == "text" else f for f in rows.schema.fields])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        frames = zstandard.ZstdCompressor(level=1)
        for part in parts:
            yield part.set_column(part.schema.get_field_index("text"), "text", pa.array([frames.compress(t) for t in text_bytes(part.column("text"))], pa.binary()))

    return rows.mapInArrow(run, out)


def unsqueezed(column: pa.ChunkedArray | pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text that ``squeezed`` packed, one at a time."""
    import zstandard

    frames = zstandard.ZstdDecompressor()
    for value in column:
        yield frames.decompress(value.as_py())


def sliced(parts: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """``parts`` in slices of at most ``rows`` rows; what Arrow holds beyond them is given back at the end of each part."""
    for part in parts:
        for at in range(0, part.num_rows, rows):
            yield part.slice(at, rows)
        del part
        pa.default_memory_pool().release_unused()


def batches(schema: pa.Schema, rows: Iterable[tuple], size: int = 4096) -> Iterator[pa.RecordBatch]:
    """``rows`` as Arrow batches of at most ``size`` rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _batch(schema, held)
            held = []
    if held:
        yield _batch(schema, held)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
