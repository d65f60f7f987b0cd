"""Registered queries over the catalogue: sources, filters, counts, lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import lexicon as lx
from ..functions.ranking import count_and_ends, top_k
from ..operators import counts as ct, filters as fl, routes as rt
from ..schema import LEVELS, PRODUCT_LEVELS
from ..session import stage_path
from ..sources import interactions as it, labelled, runs as rn
from ..sources.catalogue import fetch_nodes
from ..streaming.interactions import append_stream, follow_interactions
from . import fixtures as fx, sql as S

QUERIES = {}
ORACLES = {}


def registered(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


# ---------------------------------------------------------------- sources and sinks
@registered("s1_load_nodes", S.query(
    "SELECT node_id, tmtid, level, name, fsn, trade_name, generic_name, manufacturer, active_substance, strength, dosageform, "
    "nlem, nlem_category, vec IS NOT NULL AS has_vector FROM nodes", "nodes"))
def s1(spark: SparkSession, d: str) -> DataFrame:
    return fx.catalogue(spark, d).nodes.select(
        "node_id", "tmtid", "level", "name", "fsn", "trade_name", "generic_name", "manufacturer", "active_substance", "strength",
        "dosageform", "nlem", "nlem_category", F.col("embedding_vec").isNotNull().alias("has_vector"))


@registered("s2_load_edges", S.query("SELECT edge_id, src_id, dst_id, type FROM edges", "edges"))
def s2(spark, d):
    return fx.catalogue(spark, d).edges.select("edge_id", "src_id", "dst_id", "type")


@registered("s3_load_labelled_texts", """
    SELECT label, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, max(text_no) AS last_no FROM (
      SELECT label, text, row_number() OVER (PARTITION BY doc_id) - 1 AS text_no FROM (
        SELECT doc_id, 'quality_' || quality AS label, UNNEST(string_split(text, chr(10))) AS text FROM labels JOIN documents USING (doc_id)))
    GROUP BY label""")
def s3(spark, d):
    """Each labelled document as a ``{label: [lines]}`` JSON file row, read back into texts."""
    docs = fx.table(spark, d, "labels").join(fx.table(spark, d, "documents"), "doc_id")
    label = F.concat(F.lit("quality_"), F.col("quality").cast("string"))
    path = stage_path(spark, "labelled")
    docs.select(F.to_json(F.create_map(label, F.split("text", "\n"))).alias("value")).write.text(path)
    rows = labelled.load_labelled_texts(spark, path, per_line=True)
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.max("text_no").alias("last_no"))


def event_runs(spark, d) -> DataFrame:
    """Run records read off the events: policy by user, operator by type, latency by value."""
    e = fx.table(spark, d, "events")
    hit = F.pmod(F.col("event_id"), F.lit(4))
    family = F.when(F.col("event_type") == "purchase", "count").when(F.col("event_type") == "signup", "verify").otherwise("retrieval")
    op = (F.when(F.col("event_type") == "click", "lookup").when(F.col("event_type") == "view", "list")
          .when(F.col("event_type") == "purchase", "analyze_count").when(F.col("event_type") == "signup", "verify").otherwise("analyze_compare"))
    def of(name, value):
        return F.when(family == name, value).cast("double")
    metric = {
        "hit@1": of("retrieval", F.when(hit < 1, 1.0).otherwise(0.0)), "hit@3": of("retrieval", F.when(hit < 2, 1.0).otherwise(0.0)),
        "hit@5": of("retrieval", F.when(hit < 3, 1.0).otherwise(0.0)), "hit@10": of("retrieval", F.when(hit < 3, 1.0).otherwise(0.0)),
        "p@5": of("retrieval", hit / 5.0), "r@5": of("retrieval", hit / 4.0), "mrr": of("retrieval", F.lit(1.0) / (hit + 1)),
        "ndcg@10": of("retrieval", F.lit(1.0) / (hit + 2)), "pred_count": of("count", hit + 1), "gold_count": of("count", F.lit(2)),
        "exact_match": of("count", F.when(hit == 1, 1.0).otherwise(0.0)), "abs_error": of("count", F.abs(hit - 1)),
        "ape": F.when((family == "count") & (hit > 0), F.abs(hit - 1) / 2.0).cast("double"),
        "accuracy": of("verify", F.when(hit < 3, 1.0).otherwise(0.0))}
    gold = F.when(family == "verify", F.pmod("user_id", F.lit(2)) == 0)
    pred = F.when(family == "verify", F.when(hit < 3, F.pmod("user_id", F.lit(2)) == 0).otherwise(F.pmod("user_id", F.lit(2)) == 1))
    policy = F.when(F.pmod("user_id", F.lit(2)) == 0, "uniform").otherwise("static")
    return e.select(
        F.col("event_id").cast("string").alias("query_id"), F.col("props").alias("query"), policy.alias("policy"),
        op.alias("expected_operator"), family.alias("metric_family"),
        F.when(F.pmod("event_id", F.lit(50)) == 7, "error").otherwise("ok").alias("status"),
        F.when(F.pmod("event_id", F.lit(3)) == 0, "id_lookup").otherwise(op).alias("strategy"), F.col("value").alias("latency_ms"),
        F.struct(*[v.alias(k) for k, v in metric.items()], gold.alias("gold_label"), pred.alias("pred_label")).alias("metrics"))


S.fragment("run_rows", """
    SELECT CAST(event_id AS VARCHAR) AS query_id, props AS query, CASE WHEN user_id % 2 = 0 THEN 'uniform' ELSE 'static' END AS policy, op AS expected_operator,
      fam AS metric_family, CASE WHEN event_id % 50 = 7 THEN 'error' ELSE 'ok' END AS status,
      CASE WHEN event_id % 3 = 0 THEN 'id_lookup' ELSE op END AS strategy, value AS latency_ms,
      CASE WHEN fam = 'retrieval' THEN CAST(h < 1 AS DOUBLE) END AS hit1, CASE WHEN fam = 'retrieval' THEN CAST(h < 2 AS DOUBLE) END AS hit3,
      CASE WHEN fam = 'retrieval' THEN CAST(h < 3 AS DOUBLE) END AS hit5, CASE WHEN fam = 'retrieval' THEN CAST(h < 3 AS DOUBLE) END AS hit10,
      CASE WHEN fam = 'retrieval' THEN h / 5.0 END AS p5, CASE WHEN fam = 'retrieval' THEN h / 4.0 END AS r5,
      CASE WHEN fam = 'retrieval' THEN 1.0 / (h + 1) END AS mrr, CASE WHEN fam = 'retrieval' THEN 1.0 / (h + 2) END AS ndcg10,
      CASE WHEN fam = 'count' THEN CAST(h = 1 AS DOUBLE) END AS exact_match, CASE WHEN fam = 'count' THEN CAST(abs(h - 1) AS DOUBLE) END AS abs_error,
      CASE WHEN fam = 'count' AND h > 0 THEN abs(h - 1) / 2.0 END AS ape, CASE WHEN fam = 'verify' THEN CAST(h < 3 AS DOUBLE) END AS accuracy,
      CASE WHEN fam = 'verify' THEN user_id % 2 = 0 END AS gold_label,
      CASE WHEN fam = 'verify' THEN CASE WHEN h < 3 THEN user_id % 2 = 0 ELSE user_id % 2 = 1 END END AS pred_label, event_id, user_id, h
    FROM (SELECT *, event_id % 4 AS h, CASE event_type WHEN 'click' THEN 'lookup' WHEN 'view' THEN 'list' WHEN 'purchase' THEN 'analyze_count'
          WHEN 'signup' THEN 'verify' ELSE 'analyze_compare' END AS op,
          CASE event_type WHEN 'purchase' THEN 'count' WHEN 'signup' THEN 'verify' ELSE 'retrieval' END AS fam FROM events)""")


@registered("s4_load_runs", S.query(
    "SELECT query_id, policy, expected_operator, metric_family, status, round(latency_ms, 6) AS latency_ms, round(mrr, 6) AS mrr, gold_label FROM run_rows", "run_rows"))
def s4(spark, d):
    path = stage_path(spark, "runs")
    event_runs(spark, d).write.json(path)
    return rn.load_runs(spark, path).select("query_id", "policy", "expected_operator", "metric_family", "status",
                                            F.round("latency_ms", 6).alias("latency_ms"), F.round("metrics.mrr", 6).alias("mrr"),
                                            F.col("metrics.gold_label").alias("gold_label"))


@registered("s5_append_interactions", S.query(r"""
    SELECT 'a' || c.conv_id || '|' || c.turn AS id, c.text AS question, a.text AS answer,
      CASE WHEN g.tmtid IS NULL THEN '' ELSE concat_ws(' | ', g.fsn, 'generic_name: ' || g.generic_name, 'nlem: ' || g.nlem) END AS contexts
    FROM conversations c JOIN conversations a ON a.conv_id = c.conv_id AND a.turn = c.turn + 1 AND a.role = 'assistant'
    LEFT JOIN nodes g ON g.level = 'GP' AND g.tmtid = CAST(1000000 + c.conv_id AS VARCHAR) WHERE c.role = 'user'""", "nodes"))
def s5(spark, d):
    """User turns with the next answer, logged in two batches, one of them run again, and followed by a stream that is stopped in between."""
    c = fx.table(spark, d, "conversations")
    answers = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    turns = c.where("role = 'user'").join(answers, ["conv_id", "turn"]).select(
        F.concat(F.lit("a"), F.col("conv_id").cast("string"), F.lit("|"), F.col("turn").cast("string")).alias("query_id"),
        F.col("text").alias("question"), "answer", F.lit(None).cast("string").alias("ground_truth"), "conv_id", "turn")
    found = turns.select("query_id", (F.col("conv_id") + 1000000).cast("string").alias("node_id"), F.lit(1).alias("place"))
    rows = it.interaction_rows(turns, found, fx.catalogue(spark, d).nodes.where("level = 'GP'"))
    source, sink, mark = (stage_path(spark, n) for n in ("log_in", "log_out", "log_mark"))
    for half, batches in ((0, ("0", "0")), (1, ("1",))):
        for batch in batches:
            it.append_interactions(rows.where(f"length(id) % 2 = {half}"), source, batch)
        append_stream(follow_interactions(spark, source), sink, mark, once=True).awaitTermination()
    return it.load_interactions(spark, sink).select("id", "question", "answer", F.concat_ws(" || ", "contexts").alias("contexts"))


@registered("s6_write_run", S.query(
    """SELECT policy, count(*) AS records, count(*) FILTER (status = 'ok') AS ok, count(*) AS read_records, count(*) FILTER (status = 'ok') AS read_ok, round(avg(mrr), 6) AS read_mrr,
      count(DISTINCT query_id) AS read_queries, round(sum(latency_ms), 3) AS read_latency FROM run_rows GROUP BY policy""", "run_rows"))
def s6(spark, d):
    """The summary and the records of a run, both as they come back from the files."""
    runs = event_runs(spark, d)
    summary = runs.groupBy("policy").agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("status") == "ok").alias("ok"))
    path = stage_path(spark, "run_out")
    rn.write_run(runs, summary, path)
    back = rn.load_runs(spark, f"{path}/runs").groupBy("policy").agg(
        F.count(F.lit(1)).alias("read_records"), F.count_if(F.col("status") == "ok").alias("read_ok"), F.round(F.avg("metrics.mrr"), 6).alias("read_mrr"),
        F.count_distinct("query_id").alias("read_queries"), F.round(F.sum("latency_ms"), 3).alias("read_latency"))
    return spark.read.schema("policy string, records bigint, ok bigint").json(f"{path}/summary").join(back, "policy")


@registered("s7_fetch_nodes", S.query(
    "SELECT node_id, level, fsn FROM nodes WHERE node_id IN (SELECT CAST(l_partkey + 1000000 AS VARCHAR) FROM lineitem WHERE l_linenumber = 1)", "nodes"))
def s7(spark, d):
    ids = fx.table(spark, d, "lineitem").select(
        F.when(F.col("l_linenumber") == 1, (F.col("l_partkey") + 1000000).cast("string")).otherwise("").alias("node_id"))
    return fetch_nodes(ids, fx.catalogue(spark, d).nodes).select("node_id", "level", "fsn")


# ---------------------------------------------------------------- filters
@registered("p1_filter_nodes", S.query(
    f"SELECT q.query_id, n.level, count(*) AS n, min(n.tmtid) AS first_id, max(n.tmtid) AS last_id FROM requests q JOIN nodes n ON {S.PASSES} GROUP BY ALL",
    "requests", "nodes"))
def p1(spark, d):
    kept = fl.filter_nodes(fx.search_requests(spark, d), fx.catalogue(spark, d).nodes)
    return count_and_ends(kept, ["query_id", "level"], "tmtid").withColumnsRenamed({"least": "first_id", "most": "last_id"})


_PROFILE_VALUES = ", ".join(
    f"({S.quote(t)}, {S.quote(','.join(sorted(lv)))}, {S.quote(','.join(fields))}, {cap})" for t, lv, fields, cap in lx.SEARCH_PROFILES)


@registered("p2_search_profile", f"""
    SELECT v.vec_id, v.target_type, p.levels AS allowed_levels, p.fields AS required_fields, p.cap AS max_entities
    FROM (SELECT vec_id, (['manufacturer','substance','nlem','hierarchy','formula','general','other'])[vec_id % 7 + 1] AS target_type FROM embeddings) v
    JOIN (VALUES {_PROFILE_VALUES}) p(t, levels, fields, cap) ON p.t = CASE WHEN v.target_type = 'other' THEN 'general' ELSE v.target_type END""")
def p2(spark, d):
    kinds = F.array(*[F.lit(t) for t in ("manufacturer", "substance", "nlem", "hierarchy", "formula", "general", "other")])
    rows = fx.table(spark, d, "embeddings").select("vec_id", F.element_at(kinds, (F.col("vec_id") % 7 + 1).cast("int")).alias("target_type"))
    return fl.search_profile(rows).select("vec_id", "target_type", F.concat_ws(",", F.array_sort("allowed_levels")).alias("allowed_levels"),
                                          F.concat_ws(",", "required_fields").alias("required_fields"), "max_entities")


S.fragment("probe_terms", "SELECT DISTINCT lower(name) AS term FROM nodes WHERE level = 'SUBS' UNION SELECT DISTINCT lower(p_name) FROM part "
                          "UNION SELECT DISTINCT lower(n_name) FROM nation UNION SELECT DISTINCT dose FROM gp", "nodes", "gp")


def probe_terms(spark, d):
    cat = fx.catalogue(spark, d)
    return (cat.nodes.where("level = 'SUBS'").select(F.lower("name").alias("term"))
            .unionByName(fx.table(spark, d, "part").select(F.lower("p_name").alias("term")))
            .unionByName(fx.table(spark, d, "nation").select(F.lower("n_name").alias("term")))
            .unionByName(fx.table(spark, d, "part").select(F.concat(F.col("p_size").cast("string"), F.lit(" mg")).alias("term"))).distinct())


@registered("p3_contains_any", S.query(
    f"SELECT t.term, n.level, count(*) AS n FROM probe_terms t JOIN nodes n ON {S.contains_any('t.term')} GROUP BY ALL", "probe_terms", "nodes"))
def p3(spark, d):
    return fl.contains_any(fx.catalogue(spark, d).nodes, probe_terms(spark, d)).groupBy("term", "level").agg(F.count(F.lit(1)).alias("n"))


@registered("p4_split_unsupported", S.query(
    f"SELECT query_id, {S.found('trim(question)', lx.UNSUPPORTED_PATTERNS)} AS refused FROM asked WHERE trim(coalesce(question, '')) <> ''", "asked"))
def p4(spark, d):
    answered, refused = fl.split_unsupported(fx.asked(spark, d))
    return answered.select("query_id", F.lit(False).alias("refused")).unionByName(refused.select("query_id", F.lit(True).alias("refused")))


@registered("p5_keep_strength", S.query(
    f"SELECT n.tmtid, x.s AS strength, {S.keep_strength('x.s', 'n.fsn')} AS kept FROM nodes n, "
    "(SELECT UNNEST([n.strength, replace(n.strength, ' ', ''), '', '5mg', '1 mg']) AS s) x WHERE n.level = 'TP'", "nodes"))
def p5(spark, d):
    tp = fx.catalogue(spark, d).nodes.where("level = 'TP'")
    rows = tp.select("tmtid", "fsn", F.explode(F.array("strength", F.replace("strength", F.lit(" "), F.lit("")), F.lit(""), F.lit("5mg"), F.lit("1 mg"))).alias("strength"))
    return rows.select("tmtid", "strength", fl.keep_strength(F.col("strength"), F.col("fsn")).alias("kept"))


S.fragment("pairs", "SELECT CAST(l_partkey AS VARCHAR) AS query_id, CAST(l_partkey * 1000000000 + l_suppkey AS VARCHAR) AS tmtid, l_suppkey, "
                    "max(l_extendedprice) AS price, max(l_quantity) AS quantity, bool_or(l_returnflag = 'R') AS relevant, max(l_tax) AS tax FROM lineitem GROUP BY l_partkey, l_suppkey")
S.fragment("ranked_pairs", "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY price DESC, l_suppkey) AS rank FROM pairs", "pairs")


def pairs(spark, d) -> DataFrame:
    li = fx.table(spark, d, "lineitem")
    return li.groupBy("l_partkey", "l_suppkey").agg(
        F.max("l_extendedprice").alias("price"), F.max("l_quantity").alias("quantity"),
        F.bool_or(F.col("l_returnflag") == "R").alias("relevant"), F.max("l_tax").alias("tax")).select(
        F.col("l_partkey").cast("string").alias("query_id"), (F.col("l_partkey") * 1000000000 + F.col("l_suppkey")).cast("string").alias("tmtid"),
        "l_suppkey", "price", "quantity", "relevant", "tax")


def ranked_pairs(spark, d, by: str = "price", cap: int | None = None) -> DataFrame:
    """The suppliers of every part in order, all of them or the first ``cap``."""
    order = [F.desc(by), F.col("l_suppkey")]
    if cap is not None:
        return top_k(pairs(spark, d), ["query_id"], order, cap)
    return pairs(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


@registered("p6_final_cap", S.query(
    "SELECT query_id, count(*) AS n, max(rank) AS last_rank FROM (SELECT *, CAST(query_id AS BIGINT) % 4 AS m FROM ranked_pairs) "
    "WHERE rank <= 25 OR m IN (0, 1) GROUP BY query_id", "ranked_pairs"))
def p6(spark, d):
    seeds = ranked_pairs(spark, d)
    m = F.col("query_id").cast("bigint") % 4
    routes = fx.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("query_id")).select(
        "query_id", F.when(m == 0, "id_lookup").when(m == 1, "list").when(m == 2, "list").otherwise("lookup").alias("operator"), (m == 2).alias("fallback_used"))
    return fl.final_cap(seeds, routes).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("last_rank"))


# ---------------------------------------------------------------- counts
_TREE = ", ".join(f"count(DISTINCT node_id) FILTER (level = '{lv}') AS {lv.lower()}_count" for lv in LEVELS)


@registered("c1_count_substance_tree", S.query(
    f"SELECT a.query_id, {_TREE}, count(DISTINCT node_id) FILTER (level = 'GP') AS total FROM substances a LEFT JOIN members USING (query_id) GROUP BY a.query_id",
    "substances", "members"))
def c1(spark, d):
    cat = fx.catalogue(spark, d)
    return ct.count_substance_tree(fx.substances(cat), cat.nodes, cat.edges)


@registered("c2_count_contains", S.query(
    f"SELECT t.term AS query_id, count(n.tmtid) AS total FROM probe_terms t LEFT JOIN nodes n ON n.level IN ({S.listing(PRODUCT_LEVELS)}) AND {S.contains_any('t.term')} GROUP BY t.term",
    "probe_terms", "nodes"))
def c2(spark, d):
    terms = probe_terms(spark, d).select(F.col("term").alias("query_id"), "term")
    return ct.count_contains(terms, fx.catalogue(spark, d).nodes)


S.fragment("loose_terms", "SELECT DISTINCT t AS term FROM (SELECT UNNEST([word, p_name, upper(word), substr(word, 1, 3), word || 'x', 'x' || p_size]) AS t FROM gp)", "gp")


def loose_terms(spark, d):
    p = fx.table(spark, d, "part").withColumn("word", F.split("p_name", " ")[1])
    return p.select(F.explode(F.array("word", "p_name", F.upper("word"), F.substring("word", 1, 3), F.concat("word", F.lit("x")),
                                      F.concat(F.lit("x"), F.col("p_size").cast("string")))).alias("term")).distinct()


@registered("c3_resolve_substance", S.query("""
    SELECT t.term AS query_id, t.term, coalesce(
      (SELECT min(s.word) FROM words s WHERE lower(s.word) = lower(t.term)),
      (SELECT s.word FROM words s WHERE contains(lower(s.word), lower(t.term)) OR contains(lower(t.term), lower(s.word))
       ORDER BY CASE WHEN starts_with(lower(s.word), lower(t.term)) THEN 0 WHEN starts_with(lower(t.term), lower(s.word)) THEN 1 ELSE 2 END,
         abs(length(s.word) - length(t.term)), s.word LIMIT 1), t.term) AS substance FROM loose_terms t""", "loose_terms", "words"))
def c3(spark, d):
    return ct.resolve_substance(loose_terms(spark, d).select(F.col("term").alias("query_id"), "term"), fx.catalogue(spark, d).nodes)


@registered("c4_count_levels", S.query("SELECT level, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM nodes GROUP BY level", "nodes"))
def c4(spark, d):
    return ct.count_levels(fx.catalogue(spark, d).nodes)


@registered("c5_count_products", S.query(f"SELECT count(*) AS total FROM nodes WHERE level IN ({S.listing(PRODUCT_LEVELS)})", "nodes"))
def c5(spark, d):
    return ct.count_products(fx.catalogue(spark, d).nodes)


S.fragment("maker_terms", "SELECT manufacturer FROM makers UNION SELECT n_name FROM nation", "makers")


def maker_terms(spark, d):
    cat = fx.catalogue(spark, d)
    return fx.manufacturers(cat).unionByName(fx.table(spark, d, "nation").select(F.col("n_name").alias("manufacturer"))).distinct()


@registered("c6_count_manufacturer", S.query(
    "SELECT t.manufacturer AS query_id, count(n.tmtid) AS total FROM maker_terms t LEFT JOIN nodes n ON n.level = 'TP' AND contains(lower(n.manufacturer), lower(t.manufacturer)) GROUP BY t.manufacturer",
    "maker_terms", "nodes"))
def c6(spark, d):
    return ct.count_manufacturer(maker_terms(spark, d).select(F.col("manufacturer").alias("query_id"), "manufacturer"), fx.catalogue(spark, d).nodes)


@registered("c7_count_nlem", S.query(
    "SELECT q.query_id, count(n.tmtid) AS total FROM (SELECT DISTINCT cat AS query_id, cat FROM gp UNION ALL SELECT 'all', NULL UNION ALL SELECT 'none', 'z') q "
    "LEFT JOIN nodes n ON n.level = 'GP' AND n.nlem AND (q.cat IS NULL OR q.cat = n.nlem_category) GROUP BY q.query_id", "gp", "nodes"))
def c7(spark, d):
    cats = fx.catalogue(spark, d).nodes.where("level = 'GP'").select(F.col("nlem_category").alias("query_id"), "nlem_category").distinct()
    extra = cats.sparkSession.createDataFrame([("all", None), ("none", "z")], "query_id string, nlem_category string")
    return ct.count_nlem(cats.unionByName(extra), fx.catalogue(spark, d).nodes)


def count_questions(spark, d) -> DataFrame:
    """Count questions in every mode, one per part."""
    p = fx.table(spark, d, "part").withColumn("word", F.split("p_name", " ")[1])
    m = F.col("p_partkey") % 8
    empty, none = F.array().cast("array<string>"), F.lit(None).cast("string")
    question = (F.when(m == 0, F.concat(F.lit("how many drugs containing "), "word")).when(m == 1, "how many all nodes in TMT")
                .when(m == 2, "how many products in TMT").when(m == 3, F.concat(F.lit("number of items from NATION_"), (F.col("p_partkey") % 25).cast("string")))
                .when(m == 4, "count the reimbursed ones").when(m == 5, F.concat(F.lit("count "), "p_name")).when(m == 6, F.concat(F.lit("count "), "word")).otherwise("count levels"))
    return p.select(
        F.col("p_partkey").cast("string").alias("query_id"), question.alias("question"),
        F.when(m == 5, F.col("p_name")).when(m == 6, F.concat("word", F.lit("zz"))).otherwise("").alias("query"),
        F.when(m == 7, "hierarchy").when(m == 4, "nlem").otherwise("general").alias("target_type"),
        F.when(m == 6, F.array("word")).otherwise(empty).alias("drugs"), empty.alias("brands"),
        F.when(m == 3, F.concat(F.lit("NATION_"), (F.col("p_partkey") % 25).cast("string"))).otherwise(none).alias("manufacturer"),
        F.when(m == 4, F.lit(True)).alias("nlem_filter"),
        F.when((m == 4) & (F.col("p_partkey") % 3 == 0), "ก").alias("nlem_category"))


@registered("c8_count_route", S.query("""
    SELECT CAST(p.p_partkey AS VARCHAR) AS query_id,
      CASE m WHEN 0 THEN 'substance_graph_gp' WHEN 1 THEN 'hierarchy_breakdown' WHEN 2 THEN 'produced_product_levels' WHEN 3 THEN 'manufacturer_products'
        WHEN 4 THEN 'nlem_gp' WHEN 5 THEN 'substance_graph_gp_fallback' WHEN 6 THEN 'substance_graph_gp' ELSE 'hierarchy_breakdown' END AS count_mode,
      CASE m WHEN 0 THEN g.n WHEN 1 THEN t.all_n WHEN 2 THEN t.product_n WHEN 3 THEN coalesce(k.n, 0)
        WHEN 4 THEN CASE WHEN p.p_partkey % 3 = 0 THEN l.first_n ELSE l.n END WHEN 5 THEN g.n WHEN 6 THEN g.n ELSE t.all_n END AS result
    FROM (SELECT *, p_partkey % 8 AS m FROM gp) p
    JOIN (SELECT word, count(*) AS n FROM gp GROUP BY word) g ON g.word = p.word
    CROSS JOIN (SELECT count(*) AS all_n, count(*) FILTER (level IN ('GP', 'GPU', 'TP', 'TPU')) AS product_n FROM nodes) t
    CROSS JOIN (SELECT count(*) AS n, count(*) FILTER (nlem_category = 'ก') AS first_n FROM nodes WHERE level = 'GP' AND nlem) l
    LEFT JOIN (SELECT x.p_partkey, count(*) AS n FROM gp x JOIN nodes n ON n.level = 'TP' AND contains(lower(n.manufacturer), 'nation_' || (x.p_partkey % 25))
               WHERE x.p_partkey % 8 = 3 GROUP BY ALL) k ON k.p_partkey = p.p_partkey""", "gp", "nodes"))
def c8(spark, d):
    cat = fx.catalogue(spark, d)
    return ct.count_route(count_questions(spark, d), cat.nodes, cat.edges).select("query_id", "count_mode", "result")


@registered("c9_reconcile_counts", S.query(f"""
    SELECT question, manual, router, manual - router AS delta, CASE WHEN router IS NULL THEN 'missing' WHEN manual > router THEN 'broader'
      WHEN manual < router THEN 'more_constrained' ELSE 'same' END AS verdict FROM (
    SELECT a.substance AS question, (SELECT count(DISTINCT node_id) FROM members m WHERE m.query_id = a.query_id AND m.level IN ('GP', 'GPU', 'TP', 'TPU')) AS manual,
      CASE WHEN CAST(a.query_id AS BIGINT) % 4 = 0 THEN NULL WHEN CAST(a.query_id AS BIGINT) % 4 = 1 THEN
        (SELECT count(*) FROM nodes n WHERE n.level IN ('GP', 'GPU', 'TP', 'TPU') AND {S.contains_any('a.substance')})
        ELSE (SELECT count(DISTINCT node_id) FROM members m WHERE m.query_id = a.query_id AND m.level = 'GP') END AS router FROM substances a)""",
    "substances", "members", "nodes"))
def c9(spark, d):
    cat = fx.catalogue(spark, d)
    subs = fx.substances(cat)
    tree = ct.count_substance_tree(subs, cat.nodes, cat.edges).join(subs, "query_id")
    manual = tree.select(F.col("substance").alias("question"), (F.col("gp_count") + F.col("gpu_count") + F.col("tp_count") + F.col("tpu_count")).alias("total"))
    m = F.col("query_id").cast("bigint") % 4
    text = ct.count_contains(subs.select("query_id", F.col("substance").alias("term")), cat.nodes).join(subs, "query_id").where(m == 1)
    router = tree.where(m > 1).select(F.col("substance").alias("question"), "total").unionByName(text.select(F.col("substance").alias("question"), "total"))
    return ct.reconcile_counts(manual, router)


@registered("c9_reconcile_summary", S.query(f"""
    SELECT verdict, count(*) AS n FROM (SELECT question, manual, router, manual - router AS delta, CASE WHEN router IS NULL THEN 'missing' WHEN manual > router THEN 'broader'
      WHEN manual < router THEN 'more_constrained' ELSE 'same' END AS verdict FROM (
    SELECT a.substance AS question, (SELECT count(DISTINCT node_id) FROM members m WHERE m.query_id = a.query_id AND m.level IN ('GP', 'GPU', 'TP', 'TPU')) AS manual,
      CASE WHEN CAST(a.query_id AS BIGINT) % 4 = 0 THEN NULL WHEN CAST(a.query_id AS BIGINT) % 4 = 1 THEN
        (SELECT count(*) FROM nodes n WHERE n.level IN ('GP', 'GPU', 'TP', 'TPU') AND {S.contains_any('a.substance')})
        ELSE (SELECT count(DISTINCT node_id) FROM members m WHERE m.query_id = a.query_id AND m.level = 'GP') END AS router FROM substances a)) GROUP BY verdict""",
    "substances", "members", "nodes"))
def c9_summary(spark, d):
    return ct.reconcile_summary(c9(spark, d))


# ---------------------------------------------------------------- deterministic lists
S.fragment("list_asked", "SELECT 's|' || tmtid AS query_id, lower(name) AS substance, '' AS strength FROM nodes WHERE level = 'SUBS' "
                         "UNION ALL SELECT 'd|' || tmtid, lower(name), '28mg' FROM nodes WHERE level = 'SUBS' "
                         "UNION ALL SELECT 'v|' || tmtid, lower(name), '' FROM nodes WHERE level = 'VTM' UNION ALL SELECT 'x|' || tmtid, name || 'zz', '' FROM nodes WHERE level = 'SUBS'", "nodes")


def list_asked(spark, d):
    n = fx.catalogue(spark, d).nodes
    def of(level, tag, name, dose):
        return n.where(F.col("level") == level).select(F.concat(F.lit(tag), "tmtid").alias("query_id"), name.alias("substance"), F.lit(dose).alias("strength"))
    return (of("SUBS", "s|", F.lower("name"), "").unionByName(of("SUBS", "d|", F.lower("name"), "28mg"))
            .unionByName(of("VTM", "v|", F.lower("name"), "")).unionByName(of("SUBS", "x|", F.concat("name", F.lit("zz")), "")))


_TP_MATCH = f"n.level = 'TP' AND {S.contains_any('lower(a.substance)', ('trade_name', 'generic_name', 'fsn', 'active_substance'))} AND {S.keep_strength('a.strength', 'n.fsn')}"
K_LIST = 50


@registered("l1_id_lookup", S.query(
    "SELECT 'i|' || p.gp AS query_id, n.tmtid AS node_id, 1 AS rank FROM gp p JOIN nodes n ON n.tmtid = CASE WHEN p.p_partkey % 2 = 0 THEN p.gp ELSE '9' || p.gp END", "gp", "nodes"))
def l1(spark, d):
    cat = fx.catalogue(spark, d)
    gp = cat.nodes.where("level = 'GP'").select("tmtid")
    rows = gp.select(F.concat(F.lit("i|"), "tmtid").alias("query_id"),
                     F.when(F.col("tmtid").cast("bigint") % 2 == 0, F.col("tmtid")).otherwise(F.concat(F.lit("9"), "tmtid")).alias("id_lookup"))
    return rt.id_matches(rows, cat).select("query_id", "node_id", "rank")


@registered("l2_list_manufacturers", S.query(f"""
    SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY manufacturer, node_id) AS rank FROM (
      SELECT a.query_id, min(n.tmtid) AS node_id, min_by(n.manufacturer, n.tmtid) AS manufacturer FROM list_asked a JOIN nodes n ON {_TP_MATCH}
      GROUP BY a.query_id, lower(n.manufacturer)) QUALIFY rank <= {K_LIST}""", "list_asked", "nodes"))
def l2(spark, d):
    return rt.list_manufacturers(list_asked(spark, d), fx.catalogue(spark, d), K_LIST).select("query_id", "node_id", "rank")


@registered("l3_list_trade_names", S.query(f"""
    SELECT a.query_id, n.tmtid AS node_id, row_number() OVER (PARTITION BY a.query_id ORDER BY coalesce(n.trade_name, n.fsn, n.name), n.tmtid) AS rank
    FROM list_asked a JOIN nodes n ON {_TP_MATCH} QUALIFY rank <= {K_LIST}""", "list_asked", "nodes"))
def l3(spark, d):
    return rt.list_trade_names(list_asked(spark, d), fx.catalogue(spark, d), K_LIST).select("query_id", "node_id", "rank")


@registered("l4_list_substance_gp", S.query(f"""
    SELECT query_id, node_id, rank FROM (
    SELECT a.query_id, n.tmtid AS node_id, row_number() OVER (PARTITION BY a.query_id ORDER BY coalesce(n.fsn, n.name), n.tmtid) AS rank
    FROM list_asked a JOIN nodes n ON n.level = 'GP' AND CASE WHEN a.substance IN (SELECT word FROM words)
      THEN n.tmtid IN (SELECT c.gp FROM chain c JOIN substances s USING (query_id) WHERE s.substance = a.substance)
      ELSE {S.contains_any('lower(a.substance)', ('name', 'fsn', 'active_substance'))} END) WHERE rank <= {K_LIST}""", "list_asked", "nodes", "words", "chain", "substances"))
def l4(spark, d):
    return rt.list_substance_gp(list_asked(spark, d), fx.catalogue(spark, d), K_LIST).select("query_id", "node_id", "rank")


@registered("l5_list_by_manufacturer", S.query(f"""
    SELECT a.manufacturer AS query_id, n.tmtid AS node_id, row_number() OVER (PARTITION BY a.manufacturer ORDER BY coalesce(n.trade_name, n.fsn, n.name), n.tmtid) AS rank
    FROM maker_terms a JOIN nodes n ON n.level = 'TP' AND CASE WHEN a.manufacturer IN (SELECT manufacturer FROM makers) THEN lower(n.manufacturer) = lower(a.manufacturer)
      ELSE contains(lower(n.manufacturer), lower(a.manufacturer)) END QUALIFY rank <= {K_LIST}""", "maker_terms", "makers", "nodes"))
def l5(spark, d):
    asked = maker_terms(spark, d).select(F.col("manufacturer").alias("query_id"), "manufacturer")
    return rt.list_by_manufacturer(asked, fx.catalogue(spark, d), K_LIST).select("query_id", "node_id", "rank")


S.fragment("anchor_asked", """SELECT query_id, substance AS hint_substance, strength AS hint_dose, CASE WHEN CAST(substr(query_id, 3) AS BIGINT) % 2 = 0 THEN '' ELSE 'NATION_1' END AS hint_maker,
    CAST(substr(query_id, 3) AS BIGINT) % 3 = 0 AS wants_trade_name, CAST(substr(query_id, 3) AS BIGINT) % 3 = 1 AS wants_maker FROM list_asked
    UNION ALL SELECT 'm|' || n_nationkey, '', '', n_name, false, true FROM nation""", "list_asked")
_ANCHOR = "coalesce(n.trade_name, n.fsn, n.name), n.tmtid"


@registered("l7_lookup_anchor", S.query(f"""
    , tp AS (SELECT a.query_id, 0 AS stage, n.tmtid AS node_id, row_number() OVER (PARTITION BY a.query_id ORDER BY {_ANCHOR}) AS rank,
        CASE WHEN a.wants_maker THEN 'lookup_anchor_tp_manufacturer' WHEN a.wants_trade_name THEN 'lookup_anchor_tp_trade_name' ELSE 'lookup_anchor_tp_substance' END AS mode
      FROM (SELECT *, hint_substance AS substance, hint_dose AS strength FROM anchor_asked) a JOIN nodes n ON a.substance <> '' AND {_TP_MATCH}
        AND (a.hint_maker = '' OR contains(lower(n.manufacturer), lower(a.hint_maker))) QUALIFY rank <= {K_LIST}),
    g AS (SELECT a.query_id, 1 AS stage, n.tmtid AS node_id, row_number() OVER (PARTITION BY a.query_id ORDER BY coalesce(n.fsn, n.name), n.tmtid) AS rank, 'lookup_anchor_gp_substance' AS mode
      FROM anchor_asked a JOIN nodes n ON a.hint_substance <> '' AND n.level = 'GP' AND {S.contains_any('lower(a.hint_substance)', ('name', 'fsn', 'active_substance'))}
        AND {S.keep_strength('a.hint_dose', 'n.fsn')} QUALIFY rank <= {K_LIST}),
    m AS (SELECT a.query_id, 2 AS stage, n.tmtid AS node_id, row_number() OVER (PARTITION BY a.query_id ORDER BY {_ANCHOR}) AS rank, 'lookup_anchor_tp_manufacturer_only' AS mode
      FROM anchor_asked a JOIN nodes n ON a.hint_maker <> '' AND n.level = 'TP' AND contains(lower(n.manufacturer), lower(a.hint_maker)) QUALIFY rank <= {K_LIST})
    SELECT query_id, node_id, rank, mode FROM (SELECT * FROM tp UNION ALL SELECT * FROM g UNION ALL SELECT * FROM m)
    QUALIFY stage = min(stage) OVER (PARTITION BY query_id)""", "anchor_asked", "nodes"))
def l7(spark, d):
    num = F.substring("query_id", 3, 20).cast("bigint")
    hints = list_asked(spark, d).select(
        "query_id", F.col("substance").alias("hint_substance"), F.col("strength").alias("hint_dose"), F.when(num % 2 == 0, "").otherwise("NATION_1").alias("hint_maker"),
        (num % 3 == 0).alias("wants_trade_name"), (num % 3 == 1).alias("wants_maker"))
    nations = fx.table(spark, d, "nation").select(
        F.concat(F.lit("m|"), F.col("n_nationkey").cast("string")).alias("query_id"), F.lit("").alias("hint_substance"), F.lit("").alias("hint_dose"),
        F.col("n_name").alias("hint_maker"), F.lit(False).alias("wants_trade_name"), F.lit(True).alias("wants_maker"))
    return rt.lookup_anchor(hints.unionByName(nations), fx.catalogue(spark, d), K_LIST).select("query_id", "node_id", "rank", "mode")
