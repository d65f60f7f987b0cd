"""Labelled texts: a JSON document that maps each label to its texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

LABEL_MAP = "map<string,array<string>>"


def explode_label_map(df: DataFrame, column: str) -> DataFrame:
    """(label, text_no, text) from a column holding ``{label: [text, ...]}`` as JSON text."""
    parsed = df.select(F.from_json(column, LABEL_MAP).alias("m"))
    per_label = parsed.select(F.explode("m").alias("label", "texts"))
    return per_label.select(normal_label(F.col("label")).alias("label"), F.posexplode("texts").alias("text_no", "text"))


def normal_label(label: Column) -> Column:
    """Older files say ``ingredient_*`` for what is now ``substance_*``."""
    return F.regexp_replace(label, "^ingredient(?=_|$)", "substance")


def load_labelled_texts(spark: SparkSession, path: str, per_line: bool = False) -> DataFrame:
    """Read one or many such documents: one JSON object a file, or one a line, so that a large file is read by many tasks."""
    return explode_label_map(spark.read.text(path, wholetext=not per_line), "value")
