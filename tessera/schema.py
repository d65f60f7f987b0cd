"""Table schemas and the fixed enumerations of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Catalogue levels, from the most abstract to the most concrete.
LEVELS = ("SUBS", "VTM", "GP", "GPU", "TP", "TPU")
PRODUCT_LEVELS = ("GP", "GPU", "TP", "TPU")
# Order in which lexical anchors are preferred.
ANCHOR_LEVEL_ORDER = ("SUBS", "VTM", "GP", "TP", "GPU", "TPU")
# Edge types a traversal may follow.
TRAVERSAL_TYPES = (
    "HAS_ACTIVE_SUBSTANCE", "IS_ACTIVE_SUBSTANCE_OF", "HAS_VTM", "IS_VTM_OF",
    "HAS_GENERIC_UNIT", "IS_GENERIC_UNIT_OF", "HAS_TRADE_PRODUCT", "IS_TRADE_PRODUCT_OF",
    "HAS_TRADE_UNIT", "IS_UNIT_OF_TRADE_PRODUCT", "HAS_TRADE_EQUIVALENT", "IS_TRADE_EQUIVALENT_OF",
)
# Edge types the count and list routes accept for each step.
SUBSTANCE_TO_VTM = ("IS_ACTIVE_SUBSTANCE_OF", "IS_ACTIVE_INGREDIENT_OF")
GP_TO_VTM = ("HAS_VTM", "HAS_ACTIVE_INGREDIENT")
# Sentinel rank of a candidate a channel did not return.
NO_RANK = 9999

_STRINGS = ("node_id", "tmtid", "name", "fsn", "trade_name", "generic_name", "manufacturer",
            "active_substance", "active_substances", "strength", "strengths", "dosageform",
            "container_text", "common_name")
NODE_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in _STRINGS]
    + [T.StructField("nlem", T.BooleanType()),
       T.StructField("nlem_category", T.StringType()),
       T.StructField("nlem_section", T.StringType()),
       T.StructField("embedding_vec", T.ArrayType(T.FloatType())),
       T.StructField("level", T.StringType())])
EDGE_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("edge_id", "src_id", "dst_id", "type")])

# Text properties searched literally, and those in the text index.
CONTAINS_COLUMNS = ("fsn", "trade_name", "name", "generic_name", "active_substance", "active_substances")
INDEX_COLUMNS = ("name", "fsn", "trade_name", "generic_name", "active_substance", "active_substances",
                 "strength", "strengths", "dosageform", "manufacturer")

RUN_SCHEMA = T.StructType([
    T.StructField("query_id", T.StringType()), T.StructField("query", T.StringType()),
    T.StructField("policy", T.StringType()), T.StructField("expected_operator", T.StringType()),
    T.StructField("metric_family", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("strategy", T.StringType()), T.StructField("latency_ms", T.DoubleType()),
    T.StructField("metrics", T.StructType([
        T.StructField(c, T.DoubleType()) for c in (
            "hit@1", "hit@3", "hit@5", "hit@10", "p@5", "r@5", "mrr", "ndcg@10",
            "pred_count", "gold_count", "exact_match", "abs_error", "ape", "accuracy")]
        + [T.StructField("gold_label", T.BooleanType()), T.StructField("pred_label", T.BooleanType())])),
    T.StructField("ranked_tmtids", T.ArrayType(T.StringType())),
    T.StructField("gold_relevant_tmtids", T.ArrayType(T.StringType())),
    T.StructField("search_counts", T.StructType([
        T.StructField(c, T.LongType()) for c in ("seed_count", "expanded_count", "relationship_count")])),
    T.StructField("route_plan", T.StructType([
        T.StructField(c, T.DoubleType()) for c in ("vector_weight", "fulltext_weight", "graph_weight")])),
])
