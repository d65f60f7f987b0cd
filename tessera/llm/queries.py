"""Registered queries of the training-data operators, and their SQL twins where SQL is quick enough."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import stage_path

from . import (decontamination, hard_negatives, html_extraction, lexical_search, license_scans, ngram_join, packing,
               quality_classifier, quality_rules, recompression, suffix_arrays, token_files, url_filters)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

URL_RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages judged by rules and trees; a page is labelled by the quality of the document whose number its path holds."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    number = F.regexp_extract(url_filters.url_path(F.col("url")), r"/(\d+)(?:\.\w+)?/?$", 1)
    labelled = (pages.withColumn("doc_id", number.try_cast("long"))
                .join(table(spark, sf_dir, "labels"), "doc_id").select("url", (1 - F.col("quality")).alias("bad")))
    return url_filters.judge_urls(pages, labelled, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "p_block")


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.apply_rules(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                        F.array_join("failed", ",").alias("failed"))


@query
def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


@query
def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = suffix_arrays.dedup(docs, outputs={"kept_sha256": lambda b: F.sha2(b, 256)})
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


@query
def op6_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.dedup(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files ``source/lang/thousand/doc_id``; those that speak of a licence are their folders' licence files."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 1000).cast("string"), F.col("doc_id").cast("string"))
    files = docs.select("doc_id", "text", path.alias("path"), F.col("text").rlike("(?i)licen[cs]e").alias("is_licence_file"))
    found = license_scans.scan(files)
    return found.select("doc_id", "path", "is_licence_file", "own_licence", "score", "licence", "inherited_from")


@query
def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources are the sites, languages their paths."""
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


@query
def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = stage_path(spark, "token_files")
    token_files.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder)
    return token_files.read(spark, folder)


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh row is given another label first; every fiftieth is an anchor."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 50 == 0)


ORACLES["op12_hard_negatives"] = hard_negatives.ORACLE


@query
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op13_lexical_search"] = lexical_search.ORACLE
