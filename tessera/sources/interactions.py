"""The append-only log of answered questions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

INTERACTION_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("timestamp", T.StringType()), T.StructField("question", T.StringType()),
    T.StructField("contexts", T.ArrayType(T.StringType())), T.StructField("answer", T.StringType()),
    T.StructField("ground_truth", T.StringType())])


def node_context() -> Column:
    """One line of the known properties of a node."""
    def named(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.col(c).cast("string")))
    return F.concat_ws(" | ", "fsn", named("trade_name"), named("generic_name"), named("manufacturer"), named("nlem"))


def interaction_rows(answered: DataFrame, found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Log rows: ``answered`` has query_id, question, answer, ground_truth; ``found`` (query_id, node_id, place).

    ``found`` is a capped list of seeds and expanded nodes, so a question's
    contexts stay short.
    """
    lines = found.join(nodes.select("node_id", node_context().alias("line")), "node_id").where("line <> ''")
    gathered = lines.groupBy("query_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("place", "node_id", "line"))), lambda x: x["line"]).alias("contexts"))
    return answered.join(gathered, "query_id", "left").select(
        F.col("query_id").alias("id"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), "question",
        F.coalesce("contexts", F.array().cast("array<string>")).alias("contexts"), "answer", "ground_truth")


def append_interactions(rows: DataFrame, path: str, batch: str | None = None) -> None:
    """Append ``rows`` to the log under ``path``.

    A ``batch`` has a folder of its own: a job that is run again with the same
    name replaces what its earlier attempt wrote, so no row is logged twice.
    """
    rows.select(*INTERACTION_SCHEMA.names).write.mode("overwrite").json(f"{path}/batch-{batch or uuid.uuid4().hex}")


def load_interactions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INTERACTION_SCHEMA).option("recursiveFileLookup", "true").json(path)
