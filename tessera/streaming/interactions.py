"""The interaction log as a stream source and sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..session import stage_path
from ..sources.interactions import INTERACTION_SCHEMA, append_interactions


def follow_interactions(spark: SparkSession, path: str) -> DataFrame:
    """New log rows as files arrive under ``path``."""
    return spark.readStream.schema(INTERACTION_SCHEMA).option("recursiveFileLookup", "true").json(path)


def append_stream(rows: DataFrame, path: str, checkpoint: str | None = None, once: bool = False, name: str = "stream") -> StreamingQuery:
    """Append a stream of log rows, one batch of the log per micro-batch.

    The batch is named by ``name`` and the micro-batch's number, so one that
    is run again after a failure replaces its own rows. Streams into one log need different names.
    """
    def append(batch: DataFrame, number: int) -> None:
        append_interactions(batch, path, f"{name}-{number}")

    writer = rows.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint or stage_path(rows.sparkSession, "interactions"))
    return (writer.trigger(availableNow=True) if once else writer).start()
