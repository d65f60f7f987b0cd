"""Run records as JSON lines, and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schema import RUN_SCHEMA


def load_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run records; blank lines are skipped, absent fields are null."""
    return spark.read.schema(RUN_SCHEMA).json(path).where("query_id is not null")


def write_run(records: DataFrame, summary: DataFrame, path: str) -> None:
    """Write the records as JSON lines under ``path``/runs and the summary under ``path``/summary."""
    records.write.mode("overwrite").json(f"{path}/runs")
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
