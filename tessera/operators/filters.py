"""Property filters, search profiles and the caps applied to answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import lexicon as lx
from ..functions.matching import contains_join
from ..functions.text import folded, haystack, matches_any
from ..schema import CONTAINS_COLUMNS, LEVELS

# A request carries its filters in these columns; a null one lets every node pass.
REQUEST_FILTERS = ("levels", "f_nlem", "f_nlem_category", "f_manufacturer", "f_tmtid")
FINAL_SEEDS = 25


def passes_filters() -> Column:
    """The request's filters, as a condition over joined request and node columns."""
    test = (
        (F.col("levels").isNull() | F.array_contains("levels", F.col("level")))
        & (F.col("f_nlem").isNull() | (F.col("nlem") == F.col("f_nlem")))
        & (F.col("f_nlem_category").isNull() | (F.col("nlem_category") == F.col("f_nlem_category")))
        & (F.col("f_manufacturer").isNull() | F.contains(folded("manufacturer"), F.lower("f_manufacturer")))
        & (F.col("f_tmtid").isNull() | (F.col("tmtid") == F.col("f_tmtid"))))
    return F.coalesce(test, F.lit(False))


def filter_nodes(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, node columns) for every node passing a request's filters.

    Each request goes the way of its sharpest filter, and each way is an
    equi-join: by id, by the distinct manufacturer names that match, or by level.
    """
    asked = requests.select("query_id", *REQUEST_FILTERS)
    by_id = asked.where(F.col("f_tmtid").isNotNull())
    by_maker = asked.where(F.col("f_tmtid").isNull() & F.col("f_manufacturer").isNotNull())
    by_level = asked.where(F.col("f_tmtid").isNull() & F.col("f_manufacturer").isNull())
    makers = nodes.where("manufacturer is not null").select(folded("manufacturer").alias("maker")).distinct()
    terms = by_maker.select(F.lower("f_manufacturer").alias("term")).distinct()
    matched = contains_join(terms, makers, text="maker", key="maker")
    ways = [
        nodes.join(by_id, F.col("tmtid") == F.col("f_tmtid")),
        nodes.withColumn("maker", folded("manufacturer")).join(matched, "maker")
        .join(by_maker, F.col("term") == F.lower("f_manufacturer")).drop("maker", "term"),
        nodes.join(
            by_level.withColumn("lv", F.explode(F.coalesce("levels", F.array(*[F.lit(v) for v in LEVELS])))),
            F.col("level") == F.col("lv")).drop("lv"),
    ]
    kept = [w.where(passes_filters()).select("query_id", *nodes.columns) for w in ways]
    return kept[0].unionByName(kept[1]).unionByName(kept[2])


def profiles(spark) -> DataFrame:
    """target_type -> allowed levels, kept fields, most entities."""
    rows = [(t, list(levels), list(fields), cap) for t, levels, fields, cap in lx.SEARCH_PROFILES]
    return spark.createDataFrame(
        rows, "target_type string, allowed_levels array<string>, required_fields array<string>, max_entities int")


def search_profile(questions: DataFrame) -> DataFrame:
    """Add the search profile of ``target_type``; an unknown target gets the general one."""
    known = [t for t, *_ in lx.SEARCH_PROFILES]
    target = F.when(F.col("target_type").isin(*known), F.col("target_type")).otherwise("general")
    return (
        questions.withColumn("_target", target)
        .join(profiles(questions.sparkSession).withColumnRenamed("target_type", "_target"), "_target")
        .drop("_target"))


def contains_any(nodes: DataFrame, terms: DataFrame, columns: Sequence[str] = CONTAINS_COLUMNS) -> DataFrame:
    """Nodes beside each term (folded, distinct) one of the columns contains."""
    return contains_join(terms, nodes.withColumn("hay", haystack(columns))).drop("hay")


def split_unsupported(questions: DataFrame, enabled: bool = False) -> tuple[DataFrame, DataFrame]:
    """(answerable, set aside): essential-medicine questions are set aside unless enabled."""
    text = F.trim(F.coalesce("question", F.lit("")))
    blank = text == ""
    refused = matches_any(text, lx.UNSUPPORTED_PATTERNS) & F.lit(not enabled)
    return questions.where(~blank & ~refused), questions.where(~blank & refused)


def keep_strength(strength: Column, fsn: Column) -> Column:
    """A blank strength passes; else the fsn holds it as written or with all blanks removed."""
    want, text = F.lower(strength), folded(fsn)
    return ((want == "") | F.contains(text, want)
            | F.contains(F.replace(text, F.lit(" "), F.lit("")), F.replace(want, F.lit(" "), F.lit(""))))


def is_deterministic(operator: Column, fallback_used: Column) -> Column:
    return operator.isin("id_lookup", "analyze_count") | (
        (operator == "list") & ~F.coalesce(fallback_used, F.lit(False)))


def final_cap(seeds: DataFrame, routes: DataFrame, limit: int = FINAL_SEEDS) -> DataFrame:
    """Keep at most ``limit`` seeds per question, except on deterministic routes."""
    return (
        seeds.join(routes.select("query_id", "operator", "fallback_used"), "query_id")
        .where((F.col("rank") <= limit) | is_deterministic(F.col("operator"), F.col("fallback_used"))))
