"""Registered queries of ground truth, metrics, classifier experiments and token data."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import lexicon as lx
from ..operators import groundtruth as gt, intents as nt, metrics as mt
from ..operators.counts import count_levels
from ..session import materialise
from . import fixtures as fx, sql as S
from .catalogue_queries import event_runs, pairs, ranked_pairs

QUERIES = {}
ORACLES = {}


def registered(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


# ---------------------------------------------------------------- ground truth
PER_LEVEL, CASES, MIN_GP, MIN_PRODUCTS, SETS = 200, 120, 5, 20, 80
S.fragment("level_sample", f"SELECT *, row_number() OVER (PARTITION BY level ORDER BY {S.digest('42', 'tmtid')}, tmtid) AS sample_no FROM nodes QUALIFY sample_no <= {PER_LEVEL}", "nodes")
S.fragment("subs_sets", f"""SELECT s.tmtid AS subs_tmtid, s.name AS substance_name, c.*, l.* EXCLUDE (qid), row_number() OVER (ORDER BY md5('42|' || s.tmtid), s.tmtid) AS set_no FROM nodes s
    JOIN (SELECT query_id, {', '.join(f"count(*) FILTER (level = '{lv}') AS {lv.lower()}_n" for lv in ('VTM', 'GP', 'GPU', 'TP', 'TPU'))} FROM members GROUP BY query_id) c ON c.query_id = s.tmtid AND c.gp_n >= {MIN_GP}
    JOIN (SELECT query_id AS qid, {', '.join(f"coalesce(list_sort(list(node_id) FILTER (level = '{lv}')), []) AS {lv.lower()}_ids" for lv in ('VTM', 'GP', 'GPU', 'TP', 'TPU'))} FROM members GROUP BY query_id) l ON l.qid = s.tmtid
    WHERE s.level = 'SUBS' QUALIFY set_no <= {SETS}""", "members", "nodes")
S.fragment("maker_members", """SELECT lower(trim(manufacturer)) AS maker, 'tp' AS level, node_id FROM nodes WHERE level = 'TP' AND trim(coalesce(manufacturer, '')) <> ''
    UNION ALL SELECT DISTINCT lower(trim(n.manufacturer)), 'tpu', e.dst_id FROM nodes n JOIN edges e ON e.src_id = n.node_id AND e.type = 'HAS_TRADE_UNIT' WHERE n.level = 'TP' AND trim(coalesce(n.manufacturer, '')) <> ''""", "nodes", "edges")
S.fragment("maker_sets", f"""SELECT maker AS manufacturer_norm, count(*) FILTER (level = 'tp') AS tp_n, count(*) FILTER (level = 'tpu') AS tpu_n, count(*) AS total_n,
    coalesce(list_sort(list(node_id) FILTER (level = 'tp')), []) AS tp_ids, coalesce(list_sort(list(node_id) FILTER (level = 'tpu')), []) AS tpu_ids,
    row_number() OVER (ORDER BY md5('42|' || maker), maker) AS set_no FROM maker_members GROUP BY maker HAVING count(*) >= {MIN_PRODUCTS} QUALIFY set_no <= {SETS}""", "maker_members")


def sample(spark, d):
    return gt.stratified_sample(fx.catalogue(spark, d).nodes.drop("embedding_vec"), PER_LEVEL, 42)


def subs_sets(spark, d, listed=None):
    cat = fx.catalogue(spark, d)
    return gt.substance_sets(cat.nodes, cat.edges, MIN_GP, None, SETS, 42, listed)


def maker_sets(spark, d):
    cat = fx.catalogue(spark, d)
    return gt.manufacturer_sets(cat.nodes, cat.edges, MIN_PRODUCTS, None, SETS, 42)


@registered("g1_stratified_sample", S.query("SELECT level, tmtid, sample_no FROM level_sample", "level_sample"))
def g1(spark, d):
    return sample(spark, d).select("level", "tmtid", "sample_no")


@registered("g1_id_lookup_cases", S.query(
    f"SELECT tmtid, level, coalesce(nullif(trade_name, ''), nullif(fsn, ''), name) AS name FROM level_sample QUALIFY row_number() OVER (ORDER BY {S.digest('42', 'tmtid')}, tmtid) <= {CASES}", "level_sample"))
def g1_cases(spark, d):
    return gt.id_lookup_cases(sample(spark, d), CASES, 42)


@registered("g2_substance_sets", S.query(
    "SELECT subs_tmtid, substance_name, vtm_n, gp_n, gpu_n, tp_n, tpu_n, array_to_string(vtm_ids, ',') AS vtm_ids, array_to_string(gp_ids, ',') AS gp_ids, "
    "array_to_string(gpu_ids, ',') AS gpu_ids, array_to_string(tp_ids, ',') AS tp_ids, array_to_string(tpu_ids, ',') AS tpu_ids FROM subs_sets", "subs_sets"))
def g2(spark, d):
    lv = ("vtm", "gp", "gpu", "tp", "tpu")
    return subs_sets(spark, d).select("anchor.subs_tmtid", "anchor.substance_name", *[F.col(f"counts.{x}").alias(f"{x}_n") for x in lv],
                                      *[F.concat_ws(",", f"gold.{x}").alias(f"{x}_ids") for x in lv])


@registered("g3_manufacturer_sets", S.query(
    "SELECT manufacturer_norm, tp_n, tpu_n, total_n, array_to_string(tp_ids, ',') AS tp_ids, array_to_string(tpu_ids, ',') AS tpu_ids FROM maker_sets", "maker_sets"))
def g3(spark, d):
    return maker_sets(spark, d).select("anchor.manufacturer_norm", F.col("counts.tp").alias("tp_n"), F.col("counts.tpu").alias("tpu_n"),
                                       F.col("counts.total_products").alias("total_n"), F.concat_ws(",", "gold.tp").alias("tp_ids"), F.concat_ws(",", "gold.tpu").alias("tpu_ids"))


def silver(spark, d) -> DataFrame:
    cat = fx.catalogue(spark, d)
    picked = materialise(sample(spark, d), "node_sample")
    made = gt.silver_queries(picked, gt.id_lookup_cases(picked, CASES, 42), materialise(subs_sets(spark, d, ["GP"]), "subs_sets"),
                             materialise(maker_sets(spark, d), "maker_sets"), count_levels(cat.nodes), 160, 30, 42)
    return gt.with_claim_names(made, cat.nodes)


def _phrase(phrase: str, *cols: str) -> str:
    parts = phrase.split("%s")
    out = [S.quote(parts[0])]
    for c, rest in zip(cols, parts[1:]):
        out += [c, S.quote(rest)]
    return "(" + " || ".join(out) + ")"


def _silver_parts() -> str:
    rows = []
    def add(section, i, j, query, lang, op, family, relevant, difficulty, source, count="NULL", label="NULL"):
        rows.append(f"SELECT {section} * 100000000 + ({i}) * 100 + {j} AS place, {query} AS query, '{lang}' AS language, '{op}' AS expected_operator, '{family}' AS metric_family, "
                    f"{difficulty} AS difficulty, {relevant} AS gold, CAST({count} AS BIGINT) AS count_value, CAST({label} AS BOOLEAN) AS verify_label FROM {source}")
    for j, (lang, p) in enumerate(lx.ID_PHRASES):
        add(1, "i", j, _phrase(p, "tmtid"), lang, "id_lookup", "retrieval", "[tmtid]", "'easy'", "silver_cases")
    for j, (lang, p) in enumerate(lx.NAME_PHRASES):
        add(2, "i", 0, _phrase(p, "display"), lang, "lookup", "retrieval", "[tmtid]", "CASE WHEN level IN ('TP', 'TPU') THEN 'medium' ELSE 'easy' END", f"silver_named WHERE i % 2 = {1 - j}")
    for j, (lang, p) in enumerate(lx.SUBSTANCE_LIST_PHRASES):
        add(3, "i", j, _phrase(p, "s"), lang, "list", "retrieval", "gp_ids", "'medium'", "silver_subs")
    add(3, "i", 2, _phrase(lx.SUBSTANCE_COUNT_PHRASE[1], "s"), lx.SUBSTANCE_COUNT_PHRASE[0], "analyze_count", "count", "gp_ids", "'medium'", "silver_subs", count="gp_n")
    for j, (lang, p) in enumerate(lx.MANUFACTURER_LIST_PHRASES):
        add(4, "i", j, _phrase(p, "m"), lang, "list", "retrieval", "tp_ids", "'medium'", "silver_makers")
    add(4, "i", 2, _phrase(lx.MANUFACTURER_COUNT_PHRASE[1], "m"), lx.MANUFACTURER_COUNT_PHRASE[0], "analyze_count", "count", "tp_ids", "'medium'", "silver_makers", count="tp_n")
    for j, (col, label) in enumerate((("m", "true"), ("other", "false"))):
        add(4, "i", 3 + j, _phrase(lx.CLAIM_PHRASE[1], "id", col), lx.CLAIM_PHRASE[0], "verify", "verify", "[id]", "'hard'", f"silver_makers WHERE id IS NOT NULL AND {col} IS NOT NULL", label=label)
    for j, (lang, p) in enumerate(lx.COMPARE_PHRASES):
        add(5, "p", j, _phrase(p, "a", "b"), lang, "analyze_compare", "retrieval", "list_sort(list_distinct(list_concat(ga, gb)))", "'hard'", "silver_pairs")
    add(6, "0", 0, S.quote(lx.PRODUCT_TOTAL_PHRASE[1]), lx.PRODUCT_TOTAL_PHRASE[0], "analyze_count", "count", "[]", "'easy'", "silver_totals", count="product_n")
    add(6, "0", 1, S.quote(lx.NODE_TOTAL_PHRASE[1]), lx.NODE_TOTAL_PHRASE[0], "analyze_count", "count", "[]", "'easy'", "silver_totals", count="all_n")
    return " UNION ALL ".join(rows)


S.fragment("silver_cases", f"SELECT tmtid, row_number() OVER (ORDER BY tmtid) AS i FROM (SELECT tmtid FROM level_sample QUALIFY row_number() OVER (ORDER BY {S.digest('42', 'tmtid')}, tmtid) <= {CASES})", "level_sample")
S.fragment("silver_named", f"""SELECT *, row_number() OVER (ORDER BY tmtid) AS i FROM (SELECT tmtid, level, coalesce(trade_name, name) AS display FROM level_sample
    WHERE length(coalesce(trade_name, name)) >= 3 QUALIFY row_number() OVER (ORDER BY {S.digest('42n', 'tmtid')}, tmtid) <= 160)""", "level_sample")
S.fragment("silver_subs", "SELECT substance_name AS s, subs_tmtid AS id, gp_ids, gp_n, row_number() OVER (ORDER BY subs_tmtid) AS i FROM subs_sets", "subs_sets")
S.fragment("silver_makers", """SELECT *, CASE WHEN i = 1 THEN nth_value(m, 2) OVER w ELSE first_value(m) OVER w END AS other FROM (SELECT manufacturer_norm AS m, tp_ids, tp_n, coalesce(tp_ids[1], tpu_ids[1]) AS id,
    row_number() OVER (ORDER BY manufacturer_norm) AS i FROM maker_sets) WINDOW w AS (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""", "maker_sets")
S.fragment("silver_pairs", """SELECT a.p, a.s AS a, b.s AS b, a.gp_ids AS ga, b.gp_ids AS gb FROM (SELECT *, row_number() OVER (ORDER BY md5('42p|' || id), id) AS rr, (rr + 1) // 2 AS p FROM silver_subs) a
    JOIN (SELECT *, row_number() OVER (ORDER BY md5('42p|' || id), id) AS rr, (rr + 1) // 2 AS p FROM silver_subs) b ON b.p = a.p AND a.rr % 2 = 1 AND b.rr % 2 = 0 WHERE a.p <= 30 AND lower(a.s) <> lower(b.s)""", "silver_subs")
S.fragment("silver_totals", "SELECT count(*) AS all_n, count(*) FILTER (level IN ('GP', 'GPU', 'TP', 'TPU')) AS product_n FROM nodes", "nodes")
S.fragment("silver", f"""SELECT *, 'silver_q_' || lpad(CAST(row_number() OVER (ORDER BY place) AS VARCHAR), 6, '0') AS query_id FROM (
    SELECT * FROM ({_silver_parts()}) QUALIFY row_number() OVER (PARTITION BY lower(query), expected_operator ORDER BY place) = 1)""",
           "silver_cases", "silver_named", "silver_subs", "silver_makers", "silver_pairs", "silver_totals")


@registered("g4_silver_queries", S.query(
    "SELECT query_id, query, language, difficulty, expected_operator, metric_family, array_to_string(gold, ',') AS gold, count_value, verify_label FROM silver", "silver"))
def g4(spark, d):
    return silver(spark, d).select("query_id", "query", "language", "difficulty", "expected_operator", "metric_family",
                                   F.concat_ws(",", "relevant_tmtids").alias("gold"), "count_value", "verify_label")


@registered("g5_silver_summary", S.query(
    "SELECT dimension, value, count(*) AS n FROM (SELECT UNNEST([{'dimension': 'expected_operator', 'value': expected_operator}, {'dimension': 'language', 'value': language}, "
    "{'dimension': 'metric_family', 'value': metric_family}, {'dimension': 'difficulty', 'value': difficulty}], recursive := true) FROM silver) GROUP BY ALL", "silver"))
def g5(spark, d):
    return gt.silver_summary(silver(spark, d))


def _anchor_parts() -> str:
    rows = []
    for j, (lang, tag, p) in enumerate(lx.ANCHOR_SUBSTANCE_PHRASES):
        rows.append(f"SELECT 0 AS section, i, {j} AS j, {_phrase(p, 'anchor')} AS query, '{lang}' AS language, '{tag}' AS template, gold FROM anchor_subs")
    for j, (lang, tag, p) in enumerate(lx.ANCHOR_MANUFACTURER_PHRASES):
        rows.append(f"SELECT 1, i, {j}, {_phrase(p, 'anchor')}, '{lang}', '{tag}', gold FROM anchor_makers")
    return " UNION ALL ".join(rows)


S.fragment("anchor_subs", "SELECT substance_name AS anchor, list_concat(tp_ids, tpu_ids) AS gold, row_number() OVER (ORDER BY md5('42|' || substance_name), substance_name) AS i FROM subs_sets WHERE len(tp_ids) + len(tpu_ids) > 0 QUALIFY i <= 20", "subs_sets")
S.fragment("anchor_makers", "SELECT manufacturer_norm AS anchor, list_concat(tp_ids, tpu_ids) AS gold, row_number() OVER (ORDER BY md5('42|' || manufacturer_norm), manufacturer_norm) AS i FROM maker_sets QUALIFY i <= 20", "maker_sets")
S.fragment("anchor_parts", _anchor_parts(), "anchor_subs", "anchor_makers")


@registered("g6_anchor_lookup_queries", S.query(
    "SELECT 'lookup_anchor_q_' || lpad(CAST(row_number() OVER (ORDER BY section, i, j) AS VARCHAR), 6, '0') AS query_id, query, language, template, array_to_string(gold, ',') AS gold FROM anchor_parts", "anchor_parts"))
def g6(spark, d):
    return gt.anchor_lookup_queries(subs_sets(spark, d), maker_sets(spark, d), 20, 20, 42).select(
        "query_id", "query", "language", F.col("tags")[1].alias("template"), F.concat_ws(",", "relevant_tmtids").alias("gold"))


# ---------------------------------------------------------------- ranking metrics
_RANKING = """SELECT q.query_id, coalesce(CAST(first <= 1 AS DOUBLE), 0) AS "hit@1", coalesce(CAST(first <= 3 AS DOUBLE), 0) AS "hit@3", coalesce(CAST(first <= 5 AS DOUBLE), 0) AS "hit@5",
    coalesce(CAST(first <= 10 AS DOUBLE), 0) AS "hit@10", round(coalesce(in5, 0) / 5.0, 6) AS "p@5", round(CASE WHEN gold_n > 0 THEN coalesce(in5, 0) / gold_n::DOUBLE ELSE 0 END, 6) AS "r@5",
    round(coalesce(1.0 / first, 0), 6) AS mrr, round(coalesce(dcg / list_sum(list_transform(range(1, CAST(least(10, gold_n) AS BIGINT) + 1), lambda i: 1.0 / log2(i + 1))), 0), 6) AS "ndcg@10"
    FROM (SELECT DISTINCT query_id FROM {r}) q LEFT JOIN (SELECT query_id, min(rank) AS first, count(*) FILTER (rank <= 5) AS in5, sum(1.0 / log2(rank + 1)) FILTER (rank <= 10) AS dcg FROM {r} WHERE relevant AND rank <= 200 GROUP BY query_id) h USING (query_id)
    LEFT JOIN (SELECT query_id, count(*) AS gold_n FROM {r} WHERE relevant GROUP BY query_id) g USING (query_id)"""
S.fragment("ranked_quantity", "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY quantity DESC, l_suppkey) AS rank FROM pairs", "pairs")
S.fragment("metrics_price", _RANKING.format(r="ranked_pairs"), "ranked_pairs")
S.fragment("metrics_quantity", _RANKING.format(r="ranked_quantity"), "ranked_quantity")


def pair_metrics(spark, d, by: str) -> DataFrame:
    ranked = mt.ranked_ids(ranked_pairs(spark, d, by))
    gold = pairs(spark, d)
    return mt.ranking_metrics(ranked, gold.where("relevant").select("query_id", "tmtid"), gold)


@registered("m1_ranking_metrics", S.query("SELECT * FROM metrics_price", "metrics_price"))
def m1(spark, d):
    rows = pair_metrics(spark, d, "price")
    return rows.select("query_id", *[F.round(f"`{m}`", 6).alias(m) for m in mt.RANKING_METRICS])


@registered("m2_count_metrics", """
    SELECT query_id, pred_count, gold_count, CAST(coalesce(pred_count, 0) = gold_count AS DOUBLE) AS exact_match, CAST(abs(coalesce(pred_count, 0) - gold_count) AS DOUBLE) AS abs_error,
      round(CASE WHEN gold_count > 0 THEN abs(coalesce(pred_count, 0) - gold_count) / gold_count::DOUBLE END, 6) AS ape FROM (
      SELECT CAST(l_partkey AS VARCHAR) AS query_id, count(*) FILTER (l_returnflag = 'R') AS gold_count, CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE count(DISTINCT l_suppkey) FILTER (l_returnflag = 'R') END AS pred_count FROM lineitem GROUP BY l_partkey)""")
def m2(spark, d):
    li = fx.table(spark, d, "lineitem").where("l_returnflag = 'R'")
    counts = fx.table(spark, d, "lineitem").select("l_partkey").distinct().join(
        li.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("g"), F.countDistinct("l_suppkey").alias("p")), "l_partkey", "left")
    rows = counts.select(F.col("l_partkey").cast("string").alias("query_id"), F.when(F.col("l_partkey") % 9 != 0, F.coalesce("p", F.lit(0))).alias("pred_count"), F.coalesce("g", F.lit(0)).alias("gold_count"))
    return mt.count_metrics(rows).withColumn("ape", F.round("ape", 6))


S.fragment("claims", "SELECT CAST(p_partkey AS VARCHAR) AS query_id, CAST(p_partkey * 1000000000 + p_partkey % 10 AS VARCHAR) AS claim_tmtid, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'NATION_' || (p_partkey % 25) END AS claim_manufacturer, p_size % 2 = 0 AS gold_label FROM part")
S.fragment("claim_labels", """SELECT c.query_id, c.gold_label, coalesce(bool_or(s.query_id IS NOT NULL), false) AS pred_label FROM claims c LEFT JOIN (SELECT p.query_id, p.tmtid, lower(m.maker) AS maker FROM pairs p JOIN maker m ON m.s_suppkey = p.l_suppkey) s
    ON s.query_id = c.query_id AND s.tmtid = c.claim_tmtid AND contains(s.maker, lower(c.claim_manufacturer)) GROUP BY ALL""", "claims", "pairs", "maker")


def claim_labels(spark, d) -> DataFrame:
    p = fx.table(spark, d, "part")
    k = F.col("p_partkey")
    claims = p.select(k.cast("string").alias("query_id"), (k * 1000000000 + k % 10).cast("string").alias("claim_tmtid"),
                      F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("NATION_"), (k % 25).cast("string"))).alias("claim_manufacturer"), (F.col("p_size") % 2 == 0).alias("gold_label"))
    maker = fx.table(spark, d, "supplier").join(fx.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("l_suppkey"), F.concat_ws(", ", "s_name", "n_name").alias("manufacturer"))
    return mt.verify_labels(pairs(spark, d).join(maker, "l_suppkey").select("query_id", "tmtid", "manufacturer"), claims)


@registered("m3_verify_metrics", S.query("""
    SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM (
      SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS r FROM (
        SELECT count(*) FILTER (gold_label AND pred_label) AS tp, count(*) FILTER (NOT gold_label AND pred_label) AS fp, count(*) FILTER (gold_label AND NOT pred_label) AS fn, count(*) FILTER (NOT gold_label AND NOT pred_label) AS tn FROM claim_labels))""", "claim_labels"))
def m3(spark, d):
    rows = mt.verify_metrics(claim_labels(spark, d))
    return rows.select("tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


_MEANS = ", ".join(f'round(coalesce(avg({c}) FILTER (status = \'ok\' AND metric_family = \'{f}\'), 0), 6) AS "{n}"' for c, n, f in (
    ("hit1", "hit@1", "retrieval"), ("hit3", "hit@3", "retrieval"), ("hit5", "hit@5", "retrieval"), ("hit10", "hit@10", "retrieval"), ("p5", "p@5", "retrieval"), ("r5", "r@5", "retrieval"),
    ("mrr", "mrr", "retrieval"), ("ndcg10", "ndcg@10", "retrieval"), ("exact_match", "exact_match", "count"), ("abs_error", "mae", "count"), ("ape", "mape", "count"), ("accuracy", "accuracy", "verify")))


@registered("m4_summarise_runs", S.query(f"""
    SELECT * EXCLUDE (pr, rc), round(pr, 6) AS precision, round(rc, 6) AS recall, round(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END, 6) AS f1 FROM (
      SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS rc FROM (
        SELECT policy, count(*) AS records_total, count(*) FILTER (status = 'ok') AS success_count, count(*) FILTER (status <> 'ok') AS error_count, round(avg(latency_ms) FILTER (status = 'ok'), 6) AS latency_ms_avg,
          count(*) FILTER (status = 'ok' AND metric_family = 'retrieval') AS retrieval_count, count(*) FILTER (status = 'ok' AND metric_family = 'count') AS count_count, count(*) FILTER (status = 'ok' AND metric_family = 'verify') AS verify_count,
          {_MEANS}, count(*) FILTER (status = 'ok' AND gold_label AND pred_label) AS tp, count(*) FILTER (status = 'ok' AND NOT gold_label AND pred_label) AS fp,
          count(*) FILTER (status = 'ok' AND gold_label AND NOT pred_label) AS fn, count(*) FILTER (status = 'ok' AND NOT gold_label AND NOT pred_label) AS tn FROM run_rows GROUP BY policy))""", "run_rows"))
def m4(spark, d):
    return mt.summarise_runs(event_runs(spark, d))


@registered("m4_summarise_operators", S.query("""
    SELECT policy, expected_operator AS operator, metric_family, count(*) AS n, CASE WHEN metric_family = 'retrieval' THEN round(avg(hit10), 6) END AS "hit@10", CASE WHEN metric_family = 'retrieval' THEN round(avg(mrr), 6) END AS mrr,
      CASE WHEN metric_family = 'count' THEN round(avg(exact_match), 6) END AS exact_match, CASE WHEN metric_family = 'count' THEN round(avg(abs_error), 6) END AS mae, CASE WHEN metric_family = 'verify' THEN round(avg(accuracy), 6) END AS accuracy
    FROM run_rows WHERE status = 'ok' GROUP BY policy, expected_operator, metric_family""", "run_rows"))
def m4_operators(spark, d):
    return mt.summarise_operators(event_runs(spark, d))


_SEM = "metric_family = 'retrieval' AND expected_operator IN ('lookup', 'list', 'analyze_compare', 'compare')"
ACCEPT = [("overall_semantic_hit@10", "hit10", _SEM), ("lookup_hit@10", "hit10", f"{_SEM} AND expected_operator = 'lookup'"), ("list_hit@10", "hit10", f"{_SEM} AND expected_operator = 'list'"),
           ("compare_hit@10", "hit10", f"{_SEM} AND expected_operator IN ('analyze_compare', 'compare')"), ("overall_semantic_mrr", "mrr", _SEM), ("overall_semantic_ndcg@10", "ndcg10", _SEM),
           ("count_exact_match", "exact_match", "metric_family = 'count'"), ("count_mape", "ape", "metric_family = 'count'"), ("verify_non_id_accuracy", "accuracy", "metric_family = 'verify' AND strategy <> 'id_lookup'")]
S.fragment("acceptance", " UNION ALL ".join(
    [f"SELECT policy, '{n}' AS metric, round(avg({c}) FILTER ({w}), 6) AS value, count(*) FILTER ({w}) AS n FROM run_rows GROUP BY policy" for n, c, w in ACCEPT]
    + ["SELECT policy, 'error_rate', round(1.0 - count(*) FILTER (status = 'ok') / count(*)::DOUBLE, 6), count(*) FROM run_rows GROUP BY policy",
       "SELECT policy, 'latency_p95_ms', round(quantile_cont(latency_ms, 0.95), 6), count(latency_ms) FROM run_rows GROUP BY policy"]), "run_rows")


@registered("m6_acceptance_metrics", S.query("SELECT * FROM acceptance", "acceptance"))
def m6(spark, d):
    return mt.acceptance_metrics(event_runs(spark, d)).withColumn("value", F.round("value", 6))


_LIMITS = ", ".join(f"('{m}', '{op}', {v}::DOUBLE)" for m, op, v in lx.ACCEPTANCE)


@registered("m7_acceptance_gate", S.query(f"""
    SELECT p.policy, l.metric, l.op, l.target, a.value, coalesce(CASE WHEN l.op = '>=' THEN a.value >= l.target ELSE a.value <= l.target END, false) AS passed
    FROM (SELECT DISTINCT policy FROM run_rows) p CROSS JOIN (VALUES {_LIMITS}) l(metric, op, target) LEFT JOIN acceptance a ON a.policy = p.policy AND a.metric = l.metric""", "acceptance"))
def m7(spark, d):
    measured = mt.acceptance_metrics(event_runs(spark, d)).withColumn("value", F.round("value", 6))
    return mt.acceptance_gate(measured).select("policy", "metric", "op", "target", "value", "passed")


@registered("m7_acceptance_verdict", S.query(f"""
    SELECT policy, bool_and(passed) AS passed FROM (
      SELECT p.policy, coalesce(CASE WHEN l.op = '>=' THEN a.value >= l.target ELSE a.value <= l.target END, false) AS passed
      FROM (SELECT DISTINCT policy FROM run_rows) p CROSS JOIN (VALUES {_LIMITS}) l(metric, op, target) LEFT JOIN acceptance a ON a.policy = p.policy AND a.metric = l.metric) GROUP BY policy""", "acceptance"))
def m7_verdict(spark, d):
    return mt.acceptance_verdict(m7(spark, d))


def policy_runs(spark, d) -> DataFrame:
    """Two policies over the same parts: suppliers by price, and by quantity."""
    def one(by, policy, weight):
        tops = ranked_pairs(spark, d, by, 10).groupBy("query_id").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "tmtid"))), lambda x: x["tmtid"]).alias("ranked_tmtids"), F.round(F.max(by) / 7, 3).alias("latency_ms"))
        k = F.col("query_id").cast("bigint")
        return tops.select("query_id", F.lit(policy).alias("policy"), F.lit("lookup").alias("expected_operator"), "latency_ms", "ranked_tmtids",
                           F.struct(F.when(k % weight == 0, 0.5).otherwise(0.25).alias("vector_weight"), F.lit(0.25).alias("fulltext_weight"), F.lit(0.25).alias("graph_weight")).alias("route_plan"))
    return one("price", "uniform", 3).unionByName(one("quantity", "static", 4))


S.fragment("policy_pairs", """SELECT u.query_id, CAST(u.query_id AS BIGINT) AS k, u.tops AS ut, s.tops AS st, s.lat - u.lat AS delta FROM
    (SELECT query_id, list(tmtid ORDER BY rank) AS tops, round(max(price) / 7, 3) AS lat FROM ranked_pairs WHERE rank <= 10 GROUP BY query_id) u JOIN
    (SELECT query_id, list(tmtid ORDER BY rank) AS tops, round(max(quantity) / 7, 3) AS lat FROM ranked_quantity WHERE rank <= 10 GROUP BY query_id) s USING (query_id)""", "ranked_pairs", "ranked_quantity")


@registered("m8_policy_diff", S.query("""
    SELECT count(*) AS pairs, count(*) FILTER ((k % 3 = 0) <> (k % 4 = 0)) AS weight_diff_count, count(*) FILTER (ut <> st) AS rank_diff_count, round(avg(delta), 6) AS delta_mean, round(median(delta), 6) AS delta_median,
      round(list_sort(list(delta))[CAST(floor(0.9 * (count(*) - 1)) AS BIGINT) + 1], 6) AS delta_p90 FROM policy_pairs""", "policy_pairs"))
def m8(spark, d):
    summary, _ = mt.policy_diff(policy_runs(spark, d))
    return summary.select("pairs", "weight_diff_count", "rank_diff_count", *[F.round(c, 6).alias(c) for c in ("delta_mean", "delta_median", "delta_p90")])


@registered("m8_changed_rankings", S.query(
    "SELECT query_id, 'lookup' AS operator, array_to_string(ut[1:3], ', ') AS first_top3, array_to_string(st[1:3], ', ') AS second_top3 FROM policy_pairs WHERE ut <> st", "policy_pairs"))
def m8_rows(spark, d):
    return mt.policy_diff(policy_runs(spark, d))[1]


def with_latency(rows: DataFrame, factor: float) -> DataFrame:
    return rows.withColumn("latency_ms", F.col("query_id").cast("double") * factor).withColumn(
        "expected_operator", F.when(F.col("query_id").cast("bigint") % 3 == 0, "id_lookup").otherwise("lookup"))


_M9 = ", ".join(f'''{{'metric': '{m}', 'baseline': round(avg(a."{m}"), 6), 'fallback': round(avg(b."{m}"), 6)}}''' for m in mt.RANKING_METRICS)


@registered("m9_ablation_delta", S.query(f"""
    SELECT metric, baseline, fallback, round(fallback - baseline, 6) AS delta FROM (SELECT UNNEST([{_M9}, {{'metric': 'latency_ms', 'baseline': round(avg(CAST(query_id AS DOUBLE) * 0.5), 6), 'fallback': round(avg(CAST(query_id AS DOUBLE) * 0.75), 6)}}], recursive := true)
    FROM metrics_price a JOIN metrics_quantity b USING (query_id))""", "metrics_price", "metrics_quantity"))
def m9(spark, d):
    return mt.ablation_delta(with_latency(pair_metrics(spark, d, "price"), 0.5), with_latency(pair_metrics(spark, d, "quantity"), 0.75))


@registered("m10_win_loss", S.query("""
    SELECT scope, operator, metric, count(*) FILTER (s > 0) AS better, count(*) FILTER (s < 0) AS worse, count(*) FILTER (s = 0) AS same FROM (
      SELECT UNNEST([{'scope': 'overall', 'operator': '*', 'metric': 'mrr', 's': m}, {'scope': 'overall', 'operator': '*', 'metric': 'hit@10', 's': h},
        {'scope': 'operator', 'operator': op, 'metric': 'mrr', 's': m}, {'scope': 'operator', 'operator': op, 'metric': 'hit@10', 's': h},
        {'scope': CASE WHEN op = 'lookup' THEN 'semantic' END, 'operator': '*', 'metric': 'mrr', 's': m}, {'scope': CASE WHEN op = 'lookup' THEN 'semantic' END, 'operator': '*', 'metric': 'hit@10', 's': h}], recursive := true)
      FROM (SELECT CASE WHEN CAST(query_id AS BIGINT) % 3 = 0 THEN 'id_lookup' ELSE 'lookup' END AS op, sign(round(b.mrr - a.mrr, 9)) AS m, sign(round(b."hit@10" - a."hit@10", 9)) AS h FROM metrics_price a JOIN metrics_quantity b USING (query_id)))
    WHERE scope IS NOT NULL GROUP BY ALL""", "metrics_price", "metrics_quantity"))
def m10(spark, d):
    return mt.win_loss(with_latency(pair_metrics(spark, d, "price"), 0.5), with_latency(pair_metrics(spark, d, "quantity"), 0.75))


# ---------------------------------------------------------------- classifier experiments
S.fragment("vectors", "SELECT vec_id AS query_id, embedding, CAST(label AS BIGINT) AS fine, CAST(label // 2 AS BIGINT) AS topic, CAST(label % 2 AS BIGINT) AS action, vec_id % 5 = 0 AS is_test FROM embeddings")
for _level in ("fine", "topic", "action"):
    S.fragment(f"cent_{_level}", f"SELECT {_level} AS label, list(m ORDER BY pos) AS embedding FROM (SELECT {_level}, pos, avg(x::DOUBLE) AS m FROM (SELECT {_level}, UNNEST(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM vectors WHERE NOT is_test) GROUP BY ALL) GROUP BY {_level}", "vectors")
    S.fragment(f"near_{_level}", f"""SELECT v.query_id, c.label, round(list_cosine_similarity(v.embedding::DOUBLE[], c.embedding), 9) AS score, row_number() OVER (PARTITION BY v.query_id ORDER BY round(list_cosine_similarity(v.embedding::DOUBLE[], c.embedding), 9) DESC, c.label) AS rank
        FROM vectors v, cent_{_level} c WHERE v.is_test""", "vectors", f"cent_{_level}")


def vectors(spark, d) -> DataFrame:
    label = F.col("label").cast("bigint")
    return fx.table(spark, d, "embeddings").select(
        F.col("vec_id").alias("query_id"), "embedding", label.alias("fine"), F.floor(label / 2).alias("topic"), (label % 2).alias("action"), (F.col("vec_id") % 5 == 0).alias("is_test"))


def train_test(spark, d):
    v = vectors(spark, d)
    return v.where("not is_test"), v.where("is_test")


@registered("q6_fit_centroids", S.query(
    "SELECT 'fine' AS level, label, pos, round(embedding[pos], 6) AS x FROM (SELECT label, embedding, UNNEST(range(1, len(embedding) + 1)) AS pos FROM cent_fine) UNION ALL "
    "SELECT 'topic', label, pos, round(embedding[pos], 6) FROM (SELECT label, embedding, UNNEST(range(1, len(embedding) + 1)) AS pos FROM cent_topic)", "cent_fine", "cent_topic"))
def q6(spark, d):
    train, _ = train_test(spark, d)
    def flat(level):
        return nt.fit_centroids(train, level).select(F.lit(level).alias("level"), "label", F.posexplode("embedding").alias("p", "v")).select(
            "level", "label", (F.col("p") + 1).cast("bigint").alias("pos"), F.round("v", 6).alias("x"))
    return flat("fine").unionByName(flat("topic"))


@registered("q7_classify_centroid", S.query("""
    SELECT f.query_id, CAST(f.label AS VARCHAR) AS intent, round(f.score, 6) AS confidence, CASE WHEN amb THEN 'general' ELSE CAST(t1 AS VARCHAR) END AS target, round(s1, 6) AS target_confidence, round(s1 - s2, 6) AS target_margin, amb AS is_ambiguous, tops AS top_targets
    FROM near_fine f JOIN (SELECT *, s1 < 0.3 OR s1 - s2 < 0.03 AS amb FROM (SELECT query_id, max(score) FILTER (rank = 1) AS s1, coalesce(max(score) FILTER (rank = 2), -1) AS s2, max(label) FILTER (rank = 1) AS t1, string_agg(CAST(label AS VARCHAR), ',' ORDER BY rank) AS tops
      FROM near_topic WHERE rank <= 3 GROUP BY query_id)) USING (query_id) WHERE f.rank = 1""", "near_fine", "near_topic"))
def q7(spark, d):
    train, test = train_test(spark, d)
    def cent(level):
        return nt.fit_centroids(train, level).withColumn("label", F.col("label").cast("string"))
    rows = nt.classify_centroid(test, cent("fine"), cent("topic"), floor=0.3)
    return rows.select("query_id", "intent", F.round("confidence", 6).alias("confidence"), "target", F.round("target_confidence", 6).alias("target_confidence"),
                       F.round("target_margin", 6).alias("target_margin"), "is_ambiguous", F.concat_ws(",", F.transform("top_targets", lambda x: x["target"])).alias("top_targets"))


@registered("q8_intent_top_k", S.query("SELECT query_id, label, round(score, 6) AS score, rank FROM near_fine WHERE rank <= 3", "near_fine"))
def q8(spark, d):
    train, test = train_test(spark, d)
    return nt.intent_top_k(test, nt.fit_centroids(train, "fine"), 3).withColumn("score", F.round("score", 6))


def labelled_docs(spark, d) -> DataFrame:
    return fx.table(spark, d, "labels").join(fx.table(spark, d, "documents").select("doc_id", "lang"), "doc_id").select(
        "doc_id", F.concat_ws("_", F.concat(F.lit("q"), F.col("quality").cast("string")), "lang").alias("label"))


S.fragment("labelled_docs", "SELECT doc_id, 'q' || quality || '_' || lang AS label FROM labels JOIN documents USING (doc_id)")


@registered("k1_stratified_split", S.query(f"""
    SELECT doc_id, label, CASE WHEN rn <= greatest(1, round_even(n * 0.33, 0)) THEN 'test' ELSE 'train' END AS split, CASE WHEN rn <= ceil(n * 0.25) THEN 'test' ELSE 'train' END AS split_up FROM (
      SELECT *, row_number() OVER (PARTITION BY label ORDER BY {S.digest('7', 'doc_id')}, doc_id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM labelled_docs)""", "labelled_docs"))
def k1(spark, d):
    rows = labelled_docs(spark, d)
    up = nt.stratified_split(rows, "label", "doc_id", 7, 0.25, round_up=True).select("doc_id", F.col("split").alias("split_up"))
    return nt.stratified_split(rows, "label", "doc_id", 7, 0.33).join(up, "doc_id")


@registered("k2_holdout_split", "SELECT vec_id, label, CASE WHEN label IN (1, 4, 7) THEN 'test' ELSE 'train' END AS split FROM embeddings")
def k2(spark, d):
    return nt.holdout_split(fx.table(spark, d, "embeddings").select("vec_id", "label"), (1, 4, 7))


S.fragment("knn", """SELECT t.query_id, c.query_id AS vec_id, c.fine AS label, round(1 - round(list_cosine_similarity(t.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9), 9) AS dist,
    row_number() OVER (PARTITION BY t.query_id ORDER BY round(list_cosine_similarity(t.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) DESC, c.query_id) AS rank FROM vectors t, vectors c WHERE t.is_test AND NOT c.is_test QUALIFY rank <= 15""", "vectors")
S.fragment("knn_votes", """SELECT query_id, k, label FROM (SELECT *, max(same) OVER (PARTITION BY query_id, k) AS any_same FROM (SELECT query_id, k, label, count(*) FILTER (dist <= 0) AS same, round(coalesce(sum(1 / dist) FILTER (dist > 0), 0), 6) AS w
      FROM knn, (SELECT UNNEST(range(3, 16)) AS k) WHERE rank <= k GROUP BY query_id, k, label))
    QUALIFY row_number() OVER (PARTITION BY query_id, k ORDER BY CASE WHEN any_same > 0 THEN same ELSE w END DESC, label) = 1""", "knn")


@registered("k3_knn_sweep", S.query("""
    SELECT CAST(k AS INTEGER) AS k, round(accuracy, 6) AS accuracy, row_number() OVER (ORDER BY accuracy DESC, k) = 1 AS is_best FROM (SELECT k, avg(CAST(v.fine = n.label AS DOUBLE)) AS accuracy FROM knn_votes n JOIN vectors v USING (query_id) GROUP BY k)""", "knn_votes", "vectors"))
def k3(spark, d):
    train, test = train_test(spark, d)
    return nt.knn_sweep(train.select(F.col("query_id").alias("vec_id"), "embedding", F.col("fine").alias("label")), test.withColumn("label", F.col("fine"))).withColumn("accuracy", F.round("accuracy", 6))


@registered("k4_predict_nearest", S.query("SELECT query_id, label AS predicted FROM near_fine WHERE rank = 1", "near_fine"))
def k4(spark, d):
    train, test = train_test(spark, d)
    return nt.predict_nearest(test, nt.fit_centroids(train, "fine"))


def class_sql(source: str, keys: str = "") -> str:
    """Macro metrics of ``source`` (keys, label, predicted)."""
    k = f"{keys}, " if keys else ""
    return f"""SELECT {k}sum(tp) / sum(support)::DOUBLE AS accuracy, avg(p) AS precision, avg(r) AS recall, avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END) AS f1 FROM (
      SELECT *, CASE WHEN called > 0 THEN tp / called::DOUBLE ELSE 0 END AS p, CASE WHEN support > 0 THEN tp / support::DOUBLE ELSE 0 END AS r FROM (
        SELECT {k}c, count(*) FILTER (side = 't' AND label = predicted) AS tp, count(*) FILTER (side = 't') AS support, count(*) FILTER (side = 'p') AS called FROM (
          SELECT {k}label AS c, 't' AS side, label, predicted FROM {source} UNION ALL SELECT {k}predicted, 'p', label, predicted FROM {source}) GROUP BY {k}c)) {('GROUP BY ' + keys) if keys else ''}"""


S.fragment("predicted", "SELECT v.query_id, v.fine AS label, n.label AS predicted FROM vectors v JOIN near_fine n ON n.query_id = v.query_id AND n.rank = 1", "near_fine", "vectors")


@registered("k5_class_metrics", S.query(f"SELECT round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM ({class_sql('predicted')})", "predicted"))
def k5(spark, d):
    train, test = train_test(spark, d)
    rows = nt.predict_nearest(test, nt.fit_centroids(train, "fine")).join(test.select("query_id", F.col("fine").alias("label")), "query_id")
    return nt.class_metrics(rows).select(*[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@registered("k5_confusion", S.query("SELECT label, predicted, count(*) AS n FROM predicted GROUP BY ALL", "predicted"))
def k5_cells(spark, d):
    train, test = train_test(spark, d)
    return nt.confusion(nt.predict_nearest(test, nt.fit_centroids(train, "fine")).join(test.select("query_id", F.col("fine").alias("label")), "query_id"))


S.fragment("heads", """SELECT v.query_id, 'flat' AS variant, v.topic, v.action, n.label // 2 AS p_topic, n.label % 2 AS p_action FROM vectors v JOIN near_fine n ON n.query_id = v.query_id AND n.rank = 1
    UNION ALL SELECT v.query_id, 'split', v.topic, v.action, t.label, a.label FROM vectors v JOIN near_topic t ON t.query_id = v.query_id AND t.rank = 1 JOIN near_action a ON a.query_id = v.query_id AND a.rank = 1""", "vectors", "near_fine", "near_topic", "near_action")
S.fragment("head_topic", "SELECT variant, topic AS label, p_topic AS predicted FROM heads", "heads")
S.fragment("head_action", "SELECT variant, action AS label, p_action AS predicted FROM heads", "heads")


@registered("k6_flat_vs_split", S.query(f"""
    SELECT variant, round(a.accuracy, 6) AS action_acc, round(a.f1, 6) AS action_f1, round(t.accuracy, 6) AS topic_acc, round(t.f1, 6) AS topic_f1, round(j.joint, 6) AS joint_acc
    FROM ({class_sql('head_action', 'variant')}) a JOIN ({class_sql('head_topic', 'variant')}) t USING (variant)
    JOIN (SELECT variant, avg(CAST(topic = p_topic AND action = p_action AS DOUBLE)) AS joint FROM heads GROUP BY variant) j USING (variant)""", "head_action", "head_topic"))
def k6(spark, d):
    train, test = train_test(spark, d)
    return nt.flat_vs_split(train, test).select("variant", *[F.round(c, 6).alias(c) for c in ("action_acc", "action_f1", "topic_acc", "topic_f1", "joint_acc")])


@registered("k7_few_shot", S.query(f"SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY {S.digest('9', 'doc_id')}, doc_id) AS shot_no FROM labelled_docs QUALIFY shot_no <= 3", "labelled_docs"))
def k7(spark, d):
    return nt.few_shot(labelled_docs(spark, d), "label", "doc_id", 3, 9)


_INTENTS = [f"intent_{i}x" for i in range(10)]


def responses(spark, d) -> DataFrame:
    e = fx.table(spark, d, "embeddings")
    i = F.col("vec_id")
    label = F.format_string("intent_%dx", "label")
    said = F.format_string("intent_%dx", F.when(i % 3 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    text = (F.when(i % 4 == 0, F.concat(F.lit('{"intent": "'), said, F.lit('"}'))).when(i % 4 == 1, F.concat(F.lit('Sure: {"intent": "'), said, F.lit('"} as asked')))
            .when(i % 4 == 2, F.concat(F.lit("I think "), F.upper(said))).otherwise("no idea"))
    return e.select(F.when(i % 2 == 0, "m0").otherwise("m1").alias("model"), F.when(i % 8 < 4, "zero").otherwise("few").alias("mode"), label.alias("label"), text.alias("response"), (i % 17).cast("double").alias("latency_ms"))


S.fragment("scored_responses", """SELECT CASE WHEN vec_id % 2 = 0 THEN 'm0' ELSE 'm1' END AS model, CASE WHEN vec_id % 8 < 4 THEN 'zero' ELSE 'few' END AS mode, 'intent_' || label || 'x' AS label,
    CASE WHEN vec_id % 4 = 3 THEN 'unknown' ELSE 'intent_' || CASE WHEN vec_id % 3 = 0 THEN (label + 1) % 10 ELSE label END || 'x' END AS predicted, CAST(vec_id % 17 AS DOUBLE) AS latency_ms FROM embeddings""")


@registered("k8_score_responses", S.query(f"""
    SELECT model, mode, parse_errors, round(lat, 6) AS latency_ms, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1
    FROM (SELECT model, mode, count(*) FILTER (predicted = 'unknown') AS parse_errors, avg(latency_ms) AS lat FROM scored_responses GROUP BY ALL) JOIN ({class_sql('scored_responses', 'model, mode')}) USING (model, mode)""", "scored_responses"))
def k8(spark, d):
    return nt.score_responses(responses(spark, d), _INTENTS).select("model", "mode", "parse_errors", *[F.round(c, 6).alias(c) for c in ("latency_ms", "accuracy", "precision", "recall", "f1")])
