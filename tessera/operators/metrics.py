"""Quality metrics over ranked lists, counts, claims and runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import lexicon as lx
from ..functions.ranking import exact_percentiles, top_k
from ..functions.text import squash
from ..session import materialise

RANKING_METRICS = ("hit@1", "hit@3", "hit@5", "hit@10", "p@5", "r@5", "mrr", "ndcg@10")


def ranked_ids(seeds: DataFrame, key: str = "query_id", item: str = "tmtid", cap: int | None = None) -> DataFrame:
    """(key, item, rank): distinct ids in rank order, all or at most ``cap``.

    Repeats are taken out on the first ``rank`` of each id, before the cut.
    """
    firsts = seeds.groupBy(key, item).agg(F.min("rank").alias("_r"))
    if cap is not None:
        return top_k(firsts, [key], [F.col("_r"), F.col(item)], cap).drop("_r")
    return firsts.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("_r", item))).drop("_r")


def ranking_metrics(ranked: DataFrame, gold: DataFrame, asked: DataFrame, key: str = "query_id", item: str = "tmtid") -> DataFrame:
    """One row per asked query: hit@k, p@5, r@5, mrr and binary ndcg@10; 0 where nothing is ranked or relevant.

    ``ranked`` has (key, item, rank from 1), ``gold`` distinct (key, item).
    The gold size is a plain count, so a query with a vast gold set costs one
    partial sum per task; only the ranked ids are joined with it.
    """
    sizes = gold.groupBy(key).agg(F.count(F.lit(1)).alias("gold_n"))
    hits = ranked.join(gold, [key, item], "left_semi")
    r = F.col("rank")
    per = hits.groupBy(key).agg(
        F.min(r).alias("first"), F.count_if(r <= 5).alias("in5"),
        F.sum(F.when(r <= 10, 1.0 / F.log2(r + 1))).alias("dcg"))
    rows = asked.select(key).distinct().join(per, key, "left").join(sizes, key, "left")
    n = F.coalesce("gold_n", F.lit(0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(10), n)).cast("int")), F.lit(0.0),
                        lambda acc, i: acc + 1.0 / F.log2(i + 1))
    hit = [F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0)).alias(f"hit@{k}") for k in (1, 3, 5, 10)]
    in5 = F.coalesce("in5", F.lit(0))
    return rows.select(
        key, *hit, (in5 / 5.0).alias("p@5"), F.when(n > 0, in5 / n).otherwise(0.0).alias("r@5"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.col("dcg") / ideal, F.lit(0.0)).alias("ndcg@10"))


def count_metrics(pairs: DataFrame) -> DataFrame:
    """Add exact_match, abs_error and ape to (pred_count, gold_count); no ape without a positive gold count."""
    pred, gold = F.coalesce("pred_count", F.lit(0)), F.coalesce("gold_count", F.lit(0))
    error = F.abs(pred - gold).cast("double")
    return (
        pairs.withColumn("exact_match", (pred == gold).cast("double")).withColumn("abs_error", error)
        .withColumn("ape", F.when(gold > 0, error / gold)))


def verify_labels(seeds: DataFrame, claims: DataFrame) -> DataFrame:
    """(query_id, gold_label, pred_label, accuracy): whether any seed bears the claim out.

    ``seeds`` has query_id, tmtid, manufacturer; ``claims`` query_id,
    claim_tmtid, claim_manufacturer, gold_label. A missing part of a claim passes.
    """
    ok = ((F.coalesce("claim_tmtid", F.lit("")) == "") | (squash("tmtid") == squash("claim_tmtid"))) & F.contains(
        F.lower(squash("manufacturer")), F.lower(squash("claim_manufacturer")))
    proven = claims.join(seeds, "query_id").groupBy("query_id").agg(F.bool_or(ok).alias("p"))
    pred = F.coalesce("p", F.lit(False))
    return claims.join(proven, "query_id", "left").select(
        "query_id", "gold_label", pred.alias("pred_label"), (pred == F.col("gold_label")).cast("double").alias("accuracy"))


def ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def verify_metrics(labels: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, tp, fp, fn, tn, accuracy, precision, recall, f1)."""
    g, p = F.col("gold_label"), F.col("pred_label")
    cells = labels.groupBy(*keys).agg(
        F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"),
        F.count_if(~g & ~p).alias("tn"), F.avg("accuracy").alias("accuracy"))
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    rows = cells.withColumn("precision", precision).withColumn("recall", recall)
    return rows.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def _mean(value: Column, when: Column) -> Column:
    return F.round(F.coalesce(F.avg(F.when(when, F.coalesce(value, F.lit(0.0)))), F.lit(0.0)), 6)


def summarise_runs(runs: DataFrame) -> DataFrame:
    """One row per policy: totals, mean latency and the means of each metric family; 0 where there is nothing."""
    ok = F.col("status") == "ok"
    family = {f: ok & (F.col("metric_family") == f) for f in ("retrieval", "count", "verify")}
    g, p = F.col("metrics.gold_label"), F.col("metrics.pred_label")
    v = family["verify"]
    rows = runs.groupBy("policy").agg(
        F.count(F.lit(1)).alias("records_total"), F.count_if(ok).alias("success_count"), F.count_if(~ok).alias("error_count"),
        _mean(F.col("latency_ms"), ok).alias("latency_ms_avg"),
        *[F.count_if(c).alias(f"{f}_count") for f, c in family.items()],
        *[_mean(F.col(f"metrics.`{m}`"), family["retrieval"]).alias(m) for m in RANKING_METRICS],
        _mean(F.col("metrics.exact_match"), family["count"]).alias("exact_match"),
        _mean(F.col("metrics.abs_error"), family["count"]).alias("mae"),
        F.round(F.coalesce(F.avg(F.when(family["count"], F.col("metrics.ape"))), F.lit(0.0)), 6).alias("mape"),
        _mean(F.col("metrics.accuracy"), v).alias("accuracy"),
        F.count_if(v & g & p).alias("tp"), F.count_if(v & ~g & p).alias("fp"), F.count_if(v & g & ~p).alias("fn"),
        F.count_if(v & ~g & ~p).alias("tn"))
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = ratio(2 * precision * recall, precision + recall)
    return rows.withColumn("precision", F.round(precision, 6)).withColumn("recall", F.round(recall, 6)).withColumn(
        "f1", F.round(f1, 6))


def summarise_operators(runs: DataFrame) -> DataFrame:
    """(policy, operator, metric_family, n and the means that family reports) of the successful runs."""
    ok = runs.where("status = 'ok'")
    always = F.lit(True)

    def of(family: str, metric: str) -> Column:
        return F.when(F.col("metric_family") == family, _mean(F.col(f"metrics.`{metric}`"), always))

    return ok.groupBy("policy", F.col("expected_operator").alias("operator"), "metric_family").agg(
        F.count(F.lit(1)).alias("n"), *[_mean(F.col(f"metrics.`{m}`"), always).alias(f"_{m}") for m in
                                        ("hit@10", "mrr", "exact_match", "abs_error", "accuracy")]).select(
        "policy", "operator", "metric_family", "n",
        *[F.when(F.col("metric_family") == fam, F.col(f"`_{m}`")).alias(name) for fam, m, name in (
            ("retrieval", "hit@10", "hit@10"), ("retrieval", "mrr", "mrr"), ("count", "exact_match", "exact_match"),
            ("count", "abs_error", "mae"), ("verify", "accuracy", "accuracy"))])


def acceptance_metrics(runs: DataFrame, key: str = "policy") -> DataFrame:
    """(policy, metric, value, n): the acceptance measures; a null value where no run counts."""
    op, fam, m = F.lower("expected_operator"), F.col("metric_family"), F.col("metrics")
    semantic = (fam == "retrieval") & op.isin(*lx.SEMANTIC_OPERATORS)
    groups = {
        "overall_semantic_hit@10": (semantic, m["hit@10"]), "lookup_hit@10": (semantic & (op == "lookup"), m["hit@10"]),
        "list_hit@10": (semantic & (op == "list"), m["hit@10"]),
        "compare_hit@10": (semantic & op.isin(*lx.COMPARE_OPERATORS), m["hit@10"]),
        "overall_semantic_mrr": (semantic, m["mrr"]), "overall_semantic_ndcg@10": (semantic, m["ndcg@10"]),
        "count_exact_match": (fam == "count", m["exact_match"]), "count_mape": (fam == "count", m["ape"]),
        "verify_non_id_accuracy": ((fam == "verify") & (F.lower(F.coalesce("strategy", F.lit(""))) != "id_lookup"), m["accuracy"]),
    }
    wide = runs.groupBy(key).agg(
        *[F.avg(F.when(c, v)).alias(name) for name, (c, v) in groups.items()],
        *[F.count_if(c).alias(f"n {name}") for name, (c, _) in groups.items()],
        (1.0 - F.count_if(F.col("status") == "ok") / F.count(F.lit(1))).alias("error_rate"),
        F.count(F.lit(1)).alias("n error_rate"), F.count("latency_ms").alias("n latency_p95_ms"))
    p95 = exact_percentiles(runs, [key], "latency_ms", {"latency_p95_ms": 0.95})
    names = [*groups, "error_rate", "latency_p95_ms"]
    return wide.join(p95, key, "left").select(key, F.explode(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(f"`{n}`").alias("value"), F.col(f"`n {n}`").alias("n")) for n in names])).alias("x")
    ).select(key, "x.metric", "x.value", "x.n")


def acceptance_limits(spark) -> DataFrame:
    return spark.createDataFrame(list(lx.ACCEPTANCE), "metric string, op string, target double")


def acceptance_gate(metrics: DataFrame, limits: DataFrame | None = None, key: str = "policy") -> DataFrame:
    """(policy, metric, value, op, target, passed): each limit; a missing value fails."""
    limits = acceptance_limits(metrics.sparkSession) if limits is None else limits
    test = F.when(F.col("op") == ">=", F.col("value") >= F.col("target")).when(F.col("op") == "<=", F.col("value") <= F.col("target"))
    keys = metrics.select(key).distinct().withColumn("_l", F.lit(1)).join(limits.withColumn("_l", F.lit(1)), "_l").drop("_l")
    return keys.join(metrics.select(key, "metric", "value"), [key, "metric"], "left").withColumn(
        "passed", F.coalesce(test, F.lit(False)))


def acceptance_verdict(gate: DataFrame, key: str = "policy") -> DataFrame:
    return gate.groupBy(key).agg(F.bool_and("passed").alias("passed"))


def policy_pairs(runs: DataFrame, first: str, second: str) -> DataFrame:
    """The two policies' runs of each query side by side, as structs ``u`` and ``s``."""
    columns = [c for c in runs.columns if c not in ("query_id", "policy")]
    def side(policy: str, name: str) -> DataFrame:
        return runs.where(F.col("policy") == policy).select("query_id", F.struct(*columns).alias(name))
    return side(first, "u").join(side(second, "s"), "query_id")


def policy_diff(runs: DataFrame, first: str = "uniform", second: str = "static") -> tuple[DataFrame, DataFrame]:
    """(summary row, changed rankings): how far two policies differ on the same queries."""
    pairs = materialise(policy_pairs(runs, first, second), "policy_pairs")
    def moved(w: str) -> Column:
        return F.abs(F.coalesce(f"u.route_plan.{w}", F.lit(0.0)) - F.coalesce(f"s.route_plan.{w}", F.lit(0.0))) > 1e-9
    changed = F.slice("u.ranked_tmtids", 1, 10) != F.slice("s.ranked_tmtids", 1, 10)
    rows = pairs.withColumn("delta", F.coalesce("s.latency_ms", F.lit(0.0)) - F.coalesce("u.latency_ms", F.lit(0.0)))
    totals = rows.agg(
        F.count(F.lit(1)).alias("pairs"),
        F.count_if(moved("vector_weight") | moved("fulltext_weight") | moved("graph_weight")).alias("weight_diff_count"),
        F.count_if(changed).alias("rank_diff_count"), F.coalesce(F.avg("delta"), F.lit(0.0)).alias("delta_mean"))
    middle = exact_percentiles(rows, [], "delta", {"delta_median": 0.5}).withColumn("_l", F.lit(1))
    p90 = exact_percentiles(rows, [], "delta", {"delta_p90": 0.9}, interpolate=False).withColumn("_l", F.lit(1))
    summary = totals.withColumn("_l", F.lit(1)).join(middle, "_l", "left").join(p90, "_l", "left").select(
        "pairs", "weight_diff_count", "rank_diff_count", "delta_mean",
        F.coalesce("delta_median", F.lit(0.0)).alias("delta_median"), F.coalesce("delta_p90", F.lit(0.0)).alias("delta_p90"))
    diffs = rows.where(changed).select(
        "query_id", F.col("u.expected_operator").alias("operator"), F.concat_ws(", ", F.slice("u.ranked_tmtids", 1, 3)).alias("first_top3"),
        F.concat_ws(", ", F.slice("s.ranked_tmtids", 1, 3)).alias("second_top3"))
    return summary, diffs


def ablation_delta(base: DataFrame, other: DataFrame, metrics: Sequence[str] = RANKING_METRICS) -> DataFrame:
    """(metric, baseline, fallback, delta): means over the queries both runs answered; 0 where there are none."""
    names = [*metrics, "latency_ms"]
    both = base.select("query_id", *[F.col(f"`{m}`").alias(f"a {m}") for m in names]).join(
        other.select("query_id", *[F.col(f"`{m}`").alias(f"b {m}") for m in names]), "query_id")
    means = both.agg(*[F.round(F.coalesce(F.avg(f"`{s} {m}`"), F.lit(0.0)), 6).alias(f"{s} {m}") for s in "ab" for m in names])
    return means.select(F.explode(F.array(*[F.struct(
        F.lit(m).alias("metric"), F.col(f"`a {m}`").alias("baseline"), F.col(f"`b {m}`").alias("fallback"),
        F.round(F.col(f"`b {m}`") - F.col(f"`a {m}`"), 6).alias("delta")) for m in names])).alias("x")).select("x.*")


def fallback_counts(routes: DataFrame) -> DataFrame:
    return routes.agg(F.count(F.lit(1)).alias("total"), F.count_if("attempted").alias("fallback_attempt_count"),
                      F.count_if("fallback_used").alias("fallback_used_count"))


def win_loss(base: DataFrame, other: DataFrame, metrics: Sequence[str] = ("mrr", "hit@10")) -> DataFrame:
    """(scope, operator, metric, better, worse, same): other against base, overall, semantic only, and by operator."""
    both = base.select("query_id", F.col("expected_operator").alias("operator"), *[F.col(f"`{m}`").alias(f"a {m}") for m in metrics]).join(
        other.select("query_id", *[F.col(f"`{m}`").alias(f"b {m}") for m in metrics]), "query_id")
    sign = both.select(
        F.explode(F.array(F.struct(F.lit("overall").alias("scope"), F.lit("*").alias("operator")),
                          F.struct(F.lit("operator").alias("scope"), F.col("operator").alias("operator")),
                          F.when(F.col("operator").isin(*lx.SEMANTIC_OPERATORS),
                                 F.struct(F.lit("semantic").alias("scope"), F.lit("*").alias("operator"))))).alias("g"),
        F.array(*[F.struct(F.lit(m).alias("metric"), F.signum(F.round(F.col(f"`b {m}`") - F.col(f"`a {m}`"), 9)).alias("s"))
                  for m in metrics]).alias("m")).where("g is not null")
    flat = sign.select("g.scope", "g.operator", F.explode("m").alias("m"))
    return flat.groupBy("scope", "operator", F.col("m.metric").alias("metric")).agg(
        F.count_if(F.col("m.s") > 0).alias("better"), F.count_if(F.col("m.s") < 0).alias("worse"),
        F.count_if(F.col("m.s") == 0).alias("same"))


def replay_summary(runs: DataFrame) -> DataFrame:
    """One row: totals, changed weights and mean result sizes of replayed questions.

    ``runs`` has status, retrieval_mode, old_vector, new_vector, old_fulltext,
    new_fulltext, operator, seed_count, expanded_count, relationship_count.
    """
    ok = F.col("status") == "ok"
    moved = (F.abs(F.coalesce("old_vector", "new_vector") - F.col("new_vector")) > 1e-9) | (
        F.abs(F.coalesce("old_fulltext", "new_fulltext") - F.col("new_fulltext")) > 1e-9)
    return runs.agg(
        F.count(F.lit(1)).alias("total_cases"), F.count_if(ok).alias("success_count"), F.count_if(~ok).alias("fail_count"),
        F.count_if(ok & moved).alias("weight_changed_count"),
        *[F.round(F.coalesce(F.avg(F.when(ok, F.col(c))), F.lit(0.0)), 3).alias(f"avg_{c}")
          for c in ("seed_count", "expanded_count", "relationship_count")])


def replay_distributions(runs: DataFrame) -> DataFrame:
    """(dimension, value, n) of the retrieval modes and operators of the successful replays."""
    return runs.where("status = 'ok'").select(F.explode(F.array(
        F.struct(F.lit("mode").alias("dimension"), F.col("retrieval_mode").alias("value")),
        F.struct(F.lit("operator").alias("dimension"), F.col("operator").alias("value")))).alias("x")).where(
        "x.value <> ''").groupBy("x.dimension", "x.value").agg(F.count(F.lit(1)).alias("n"))


def intent_consistency(old: DataFrame, new: DataFrame) -> DataFrame:
    """(query_id, action_equal, topics_contain_target, weights_equal, status) of an older and a newer reading."""
    action = F.when(F.col("o.strategy").isin("count", "list", "verify"), F.col("o.strategy")).otherwise("lookup")
    rows = old.alias("o").join(new.alias("n"), "query_id").select(
        "query_id", (action == F.col("n.action")).alias("action_equal"),
        F.array_contains("n.topics", F.col("o.target_type")).alias("topics_contain_target"),
        ((F.abs(F.col("o.vector_weight") - F.col("n.vector_weight")) < 1e-9)
         & (F.abs(F.col("o.fulltext_weight") - F.col("n.fulltext_weight")) < 1e-9)).alias("weights_equal"))
    fine = F.col("action_equal") & F.col("topics_contain_target") & F.col("weights_equal")
    return rows.withColumn("status", F.when(fine, "PASS").otherwise("REVIEW"))


def slot_expectations(structured: DataFrame, checks: DataFrame) -> DataFrame:
    """(query_id, failures): what a question's slots lack or hold too much of.

    ``checks`` has must_have, must_not_have (arrays) and min_drug_count.
    """
    have = F.array_distinct(F.transform(F.filter("slots", lambda s: s["value"] != ""), lambda s: s["name"]))
    drugs = F.size(F.filter("slots", lambda s: (s["name"] == "drug") & (s["value"] != "")))
    rows = checks.join(structured.select("query_id", have.alias("have"), drugs.alias("drugs")), "query_id", "left")
    none = F.array().cast("array<string>")
    have, drugs = F.coalesce("have", none), F.coalesce("drugs", F.lit(0))
    missing = F.transform(F.array_except(F.coalesce("must_have", none), have), lambda s: F.concat(F.lit("missing_required_slot:"), s))
    extra = F.transform(F.array_intersect(F.coalesce("must_not_have", none), have), lambda s: F.concat(F.lit("unexpected_slot:"), s))
    few = F.when(drugs < F.col("min_drug_count"), F.array(F.format_string("drug_count_below_min:%d<%d", drugs, "min_drug_count"))).otherwise(none)
    return rows.select("query_id", F.concat(missing, extra, F.coalesce(few, none)).alias("failures"))


def sanity_rates(structured: DataFrame, nlem_flag: str = "expect_nlem", size: int = 1000, seed: int | str = 42) -> DataFrame:
    """(check, rate, evaluated, passed): non-empty search terms over a sample, and the flag on its own group."""
    from ..functions.ranking import seeded_hash
    rows = structured.withColumn("_h", seeded_hash(seed, "query_id")).withColumn("_all", F.lit(1))
    order = [F.col("_h"), F.col("query_id")]
    first = top_k(rows, ["_all"], order, size).agg(F.avg((F.trim("query") != "").cast("double")).alias("rate"), F.count(F.lit(1)).alias("evaluated"))
    second = top_k(rows.where(F.col(nlem_flag)), ["_all"], order, size).agg(
        F.avg(F.coalesce("nlem_filter", F.lit(False)).cast("double")).alias("rate"), F.count(F.lit(1)).alias("evaluated"))
    def named(df: DataFrame, check: str, limit: float) -> DataFrame:
        rate = F.coalesce("rate", F.lit(0.0))
        return df.select(F.lit(check).alias("check"), F.round(rate, 6).alias("rate"), "evaluated", (rate >= limit).alias("passed"))
    return named(first, "query_non_empty", 0.90).unionByName(named(second, "nlem_filter_true", 0.85))
