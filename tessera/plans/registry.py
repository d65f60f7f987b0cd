"""All registered queries, and the flagship among them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import catalogue_queries, evaluation_queries, question_queries, retrieval_queries, route_queries, tagging_queries

_MODULES = (catalogue_queries, retrieval_queries, evaluation_queries, tagging_queries, question_queries, route_queries)
QUERIES = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}
ORACLES = {name: text for m in _MODULES for name, text in m.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["l12_search_batch"](spark, sf_dir)
