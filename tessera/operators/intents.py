"""Intent classification by vectors, and the experiments around it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import lexicon as lx
from ..functions.ranking import seeded_hash, spread_rank, top_k
from ..functions.vectors import mean_vectors, score_topk
from ..session import materialise


def target_of(fine: Column) -> Column:
    """The fine label without its action suffix."""
    return F.regexp_replace(fine, "_(?:" + "|".join(lx.ACTION_SUFFIXES) + ")$", "")


def action_of(fine: Column) -> Column:
    suffix = F.regexp_extract(fine, "_(" + "|".join(lx.ACTION_SUFFIXES) + ")$", 1)
    return F.when(suffix == "", "find").otherwise(suffix)


def fit_centroids(vectors: DataFrame, label: str) -> DataFrame:
    """(label, embedding): the element-wise mean vector of each label."""
    return mean_vectors(vectors, label).withColumnRenamed(label, "label")


def classify_centroid(vectors: DataFrame, fine: DataFrame, target: DataFrame,
                      floor: float = lx.CONFIDENCE_FLOOR, margin_floor: float = lx.MARGIN_FLOOR) -> DataFrame:
    """Best fine label and target of each vector, its margin over the second target, and whether that is too close.

    An ambiguous vector gets the target ``general``.
    """
    best_fine = score_topk(vectors, "query_id", fine, "label", 1, per="left").select(
        "query_id", F.col("label").alias("intent"), F.col("score").alias("confidence"))
    near = score_topk(vectors, "query_id", target, "label", 3, per="left")
    tops = near.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", F.col("label").alias("target"), "score"))).alias("t"))
    rows = best_fine.join(tops, "query_id")
    best = F.col("t")[0]["score"]
    second = F.coalesce(F.try_element_at("t", F.lit(2))["score"], F.lit(-1.0))
    ambiguous = (best < floor) | ((best - second) < margin_floor)
    return rows.select(
        "query_id", "intent", "confidence", action_of(F.col("intent")).alias("suffix"),
        F.when(ambiguous, "general").otherwise(F.col("t")[0]["target"]).alias("target"),
        best.alias("target_confidence"), (best - second).alias("target_margin"), ambiguous.alias("is_ambiguous"),
        F.transform("t", lambda x: F.struct(x["target"].alias("target"), x["score"].alias("score"))).alias("top_targets"))


def intent_top_k(vectors: DataFrame, centroids: DataFrame, k: int) -> DataFrame:
    """(query_id, label, score, rank): the k best labels at the level of the given centroids."""
    return score_topk(vectors, "query_id", centroids, "label", k, per="left")


def predict_nearest(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """(query_id, predicted): the label of the nearest centroid."""
    return score_topk(vectors, "query_id", centroids, "label", 1, per="left").select(
        "query_id", F.col("label").alias("predicted"))


# ---------------------------------------------------------------- splits
def stratified_split(rows: DataFrame, label: str, key: str, seed: int | str, ratio: float = 0.33,
                     round_up: bool = False) -> DataFrame:
    """Add ``split``: per label, max(1, round(n * ratio)) rows in seeded order are the test rows."""
    ranked = spread_rank(rows.withColumn("_h", seeded_hash(seed, key)), [label], key, "_h", "_rank")
    share = F.col("group_size") * ratio
    n_test = F.ceil(share) if round_up else F.greatest(F.lit(1), F.rint(share))
    return ranked.withColumn("split", F.when(F.col("_rank") <= n_test, "test").otherwise("train")).drop(
        "_h", "_rank", "group_size")


def holdout_split(rows: DataFrame, labels: Sequence, label: str = "label") -> DataFrame:
    """Add ``split``: rows of the held-out labels are the test rows."""
    return rows.withColumn("split", F.when(F.col(label).isin(*labels), "test").otherwise("train"))


def few_shot(rows: DataFrame, label: str, key: str, n: int, seed: int | str) -> DataFrame:
    """``n`` rows per label in seeded order, with ``shot_no``."""
    return top_k(rows.withColumn("_h", seeded_hash(seed, key)), [label], [F.col("_h"), F.col(key)], n, "shot_no").drop("_h")


# ---------------------------------------------------------------- nearest neighbours
def knn_predictions(train: DataFrame, test: DataFrame, ks: Sequence[int]) -> DataFrame:
    """(query_id, k, predicted) by distance-weighted vote of the k nearest training rows.

    ``train`` has vec_id, embedding, label; ``test`` has query_id, embedding. An
    exact match outvotes everything else; ties go to the first label. The
    neighbours are found once, for the largest k.
    """
    near = materialise(
        score_topk(train, "vec_id", test, "query_id", max(ks)).join(train.select("vec_id", "label"), "vec_id"), "neighbours")
    votes = near.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where("rank <= k").withColumn(
        "d", F.round(1 - F.col("score"), 9))
    tally = votes.groupBy("query_id", "k", "label").agg(
        F.count_if(F.col("d") <= 0).alias("same"), F.sum(F.when(F.col("d") > 0, 1 / F.col("d"))).alias("w"))
    exact = tally.groupBy("query_id", "k").agg(F.max("same").alias("any_same"))
    weight = F.when(F.col("any_same") > 0, F.col("same").cast("double")).otherwise(F.round(F.coalesce("w", F.lit(0.0)), 6))
    return top_k(tally.join(exact, ["query_id", "k"]).withColumn("weight", weight), ["query_id", "k"],
                 [F.desc("weight"), F.col("label")], 1).select("query_id", "k", F.col("label").alias("predicted"))


def knn_sweep(train: DataFrame, test: DataFrame, ks: Sequence[int] = tuple(range(3, 16))) -> DataFrame:
    """(k, accuracy, is_best); ``test`` also has its true ``label``."""
    hits = knn_predictions(train, test, ks).join(test.select("query_id", "label"), "query_id").groupBy("k").agg(
        F.avg((F.col("predicted") == F.col("label")).cast("double")).alias("accuracy"))
    # One row per k is left by now.
    best = Window.partitionBy(F.lit(1)).orderBy(F.desc("accuracy"), "k")
    return hits.withColumn("is_best", F.row_number().over(best) == 1)


# ---------------------------------------------------------------- scores
def confusion(predicted: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, label, predicted, n)."""
    return predicted.groupBy(*keys, "label", "predicted").agg(F.count(F.lit(1)).alias("n"))


def class_metrics(predicted: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, accuracy, precision, recall, f1): macro averages over all true and predicted labels, 0 where undefined."""
    cells = confusion(predicted, keys)
    sides = cells.select(*keys, F.explode(F.array(
        F.struct(F.col("label").alias("c"), F.lit(1).alias("true"), F.lit(0).alias("pred")),
        F.struct(F.col("predicted").alias("c"), F.lit(0).alias("true"), F.lit(1).alias("pred")))).alias("s"),
        (F.col("label") == F.col("predicted")).alias("hit"), "n")
    per = sides.groupBy(*keys, F.col("s.c").alias("c")).agg(
        F.sum(F.when(F.col("hit") & (F.col("s.true") == 1), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.col("s.true") * F.col("n")).alias("support"), F.sum(F.col("s.pred") * F.col("n")).alias("called"))
    p = F.when(F.col("called") > 0, F.col("tp") / F.col("called")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    scored = per.withColumn("p", p).withColumn("r", r).withColumn(
        "f", F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0))
    return scored.groupBy(*keys).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg("p").alias("precision"), F.avg("r").alias("recall"),
        F.avg("f").alias("f1"))


def flat_vs_split(train: DataFrame, test: DataFrame) -> DataFrame:
    """(variant, action_acc, action_f1, topic_acc, topic_f1, joint_acc) of one fine head against two separate heads.

    ``train`` has embedding, fine, topic, action; ``test`` has query_id as well.
    The fine head's prediction is read back into its topic and action.
    """
    labels = train.select("fine", "topic", "action").distinct()
    fine = predict_nearest(test, fit_centroids(train, "fine")).join(
        labels.withColumnRenamed("fine", "predicted"), "predicted").select(
        "query_id", F.col("topic").alias("p_topic"), F.col("action").alias("p_action"), F.lit("flat").alias("variant"))
    topic = predict_nearest(test, fit_centroids(train, "topic")).withColumnRenamed("predicted", "p_topic")
    action = predict_nearest(test, fit_centroids(train, "action")).withColumnRenamed("predicted", "p_action")
    split = topic.join(action, "query_id").select("query_id", "p_topic", "p_action", F.lit("split").alias("variant"))
    both = materialise(fine.unionByName(split).join(test.select("query_id", "topic", "action"), "query_id"), "heads")

    def head(name: str) -> DataFrame:
        scored = class_metrics(both.select("variant", F.col(name).alias("label"), F.col(f"p_{name}").alias("predicted")), ["variant"])
        return scored.select("variant", F.col("accuracy").alias(f"{name}_acc"), F.col("f1").alias(f"{name}_f1"))

    joint = both.groupBy("variant").agg(F.avg(
        ((F.col("topic") == F.col("p_topic")) & (F.col("action") == F.col("p_action"))).cast("double")).alias("joint_acc"))
    return head("action").join(head("topic"), "variant").join(joint, "variant")


# ---------------------------------------------------------------- free-text answers of a model
def parse_label(text: Column, labels: Sequence[str]) -> Column:
    """The label in a model's answer: its JSON, else JSON within braces, else the first label it mentions, else unknown."""
    whole = F.try_variant_get(F.try_parse_json(text), "$.intent", "string")
    inner = F.try_variant_get(F.try_parse_json(F.regexp_extract(text, r"(?s)\{.*\}", 0)), "$.intent", "string")
    low = F.lower(F.trim(text))
    named = F.coalesce(*[F.when(F.contains(low, F.lit(lb)), F.lit(lb)) for lb in labels])
    parsed = F.coalesce(whole, inner, named, F.lit("unknown"))
    return parsed


def score_responses(responses: DataFrame, labels: Sequence[str]) -> DataFrame:
    """(model, mode, parse_errors, latency_ms, accuracy, precision, recall, f1) of raw model answers.

    ``responses`` has model, mode, label, response, latency_ms.
    """
    pred = parse_label(F.col("response"), labels)
    rows = responses.withColumn("parsed", pred)
    rows = rows.withColumn("predicted", F.when(F.col("parsed").isin(*labels), F.col("parsed")).otherwise("unknown"))
    basics = rows.groupBy("model", "mode").agg(
        F.count_if(~F.col("parsed").isin(*labels)).alias("parse_errors"), F.avg("latency_ms").alias("latency_ms"))
    return basics.join(class_metrics(rows, ["model", "mode"]), ["model", "mode"])
