"""The corpus pipeline: quality rules, near-duplicate join, suffix-array dedup, benchmark decontamination, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before it kept. Between stages the rows are written as Parquet
to the shared folder and read again, so a lost executor costs no more than the stage at hand. No stage drops a row that it has no case against.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontamination, ngram_join, packing, quality_rules, suffix_arrays
from tessera.llm.common import table
from tessera.session import materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive rules reject go."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, five-word shingles at a similarity of 0.8 or more, the document with the smallest id stays."""
    return ngram_join.keep_first(docs, size=5, percent=80)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes and more that an earlier document has are cut; a letter that a cut runs through goes as a whole."""
    return suffix_arrays.cut_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are contaminated by the benchmark go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in training sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality), ("ngram_jaccard_join", near_duplicates), ("suffix_array_dedup", repeats),
    ("benchmark_decontamination", decontaminate), ("packing", pack)]

#: SQL has neither the sketches, the similarity join nor the tokenizer; the tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
