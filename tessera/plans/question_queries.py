"""Registered queries that read questions, and the context built for their answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import lexicon as lx
from ..operators import context as cx, metrics as mt, understanding as un
from . import fixtures as fx, question_sql as QS, search_sql as X, sql as S
from .retrieval_queries import context as request_context, found_seeds
from .tagging_queries import once

QUERIES = {}
ORACLES = {}


def registered(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


QS.questions("asked", "a", None, "asked")


def read(spark, d) -> DataFrame:
    """The structured form of every asked question, without a model's help."""
    return once(spark, d, "asked_read", lambda: un.assemble_intent(fx.asked(spark, d), fx.manufacturer_dim(spark, d)))


@registered("q1_tag_strategy", S.query("SELECT query_id, strategy FROM a_basic", "a_basic"))
def q1(spark, d):
    return un.tag_strategy(fx.asked(spark, d)).select("query_id", "strategy")


@registered("q2_tag_action", S.query(
    "SELECT query_id, CASE WHEN comparing THEN 'compare' WHEN strategy IN ('count', 'list', 'verify') THEN strategy WHEN greeting AND length(query_id) % 2 = 0 THEN 'unknown' ELSE 'lookup' END AS action FROM a_basic", "a_basic"))
def q2(spark, d):
    rows = un.tag_strategy(fx.asked(spark, d)).withColumn("is_ambiguous", F.length("query_id") % 2 == 0)
    return un.tag_action(rows).select("query_id", "action")


@registered("q3_extract_filters", S.query("SELECT query_id, id_lookup, nlem_filter, nlem_category FROM a_basic", "a_basic"))
def q3(spark, d):
    return un.extract_filters(fx.asked(spark, d)).select("query_id", "id_lookup", "nlem_filter", "nlem_category")


_CLEANED = S.squash(r"regexp_replace(regexp_replace(manufacturer, ',\s*[A-Z.]+$', ''), '\s*\([^)]*\)\s*', ' ', 'g')")
_ODD = "(SELECT manufacturer || CASE WHEN length(manufacturer) % 2 = 0 THEN ', U.S.A.' ELSE ' (Thailand)' END AS manufacturer FROM makers UNION ALL SELECT n_name FROM nation UNION ALL SELECT 'โรงพยาบาล ' || n_name FROM nation UNION ALL SELECT ' ' FROM nation)"


@registered("q4_build_manufacturer_dim", S.query(rf"""
    SELECT DISTINCT manufacturer, lower(manufacturer) AS folded FROM (SELECT manufacturer FROM {_ODD} UNION ALL SELECT {_CLEANED} FROM {_ODD})
    WHERE trim(manufacturer) <> '' AND NOT contains(manufacturer, {S.quote(lx.HOSPITAL)})""", "makers"))
def q4(spark, d):
    makers = fx.manufacturers(fx.catalogue(spark, d))
    nations = fx.table(spark, d, "nation").select(F.col("n_name").alias("manufacturer"))
    odd = makers.select(F.concat("manufacturer", F.when(F.length("manufacturer") % 2 == 0, ", U.S.A.").otherwise(" (Thailand)")).alias("manufacturer"))
    hospitals = nations.select(F.concat(F.lit(lx.HOSPITAL + " "), "manufacturer").alias("manufacturer"))
    return un.build_manufacturer_dim(odd.unionByName(nations).unionByName(hospitals).unionByName(nations.select(F.lit(" ").alias("manufacturer"))))


@registered("q5_match_manufacturer", S.query("SELECT query_id, manufacturer FROM a_maker", "a_maker"))
def q5(spark, d):
    return un.match_manufacturer(fx.asked(spark, d), fx.manufacturer_dim(spark, d))


@registered("q14_build_search_term", S.query("SELECT query_id, query FROM a_term", "a_term"))
def q14(spark, d):
    return read(spark, d).select("query_id", "query")


@registered("q15_entity_profile", S.query("SELECT query_id, token_count, entity_token_count, round(ratio, 6) AS entity_ratio, is_abstract FROM a_prof", "a_prof"))
def q15(spark, d):
    return read(spark, d).select("query_id", "token_count", "entity_token_count", F.round("entity_ratio", 6).alias("entity_ratio"), "is_abstract")


@registered("q16_retrieval_profile", S.query("SELECT query_id, retrieval_mode, vector_weight, fulltext_weight FROM a_read", "a_read"))
def q16(spark, d):
    return read(spark, d).select("query_id", "retrieval_mode", "vector_weight", "fulltext_weight")


@registered("q17_assemble_intent", S.query(r"""
    SELECT query_id, target_type, action, array_to_string(list_distinct_in_order, ',') AS topics, slots, query_slot_mode FROM (
    SELECT query_id, target_type, action, list_filter([target_type, CASE WHEN id_lookup IS NOT NULL THEN 'id_lookup' END, CASE WHEN manufacturer_filter IS NOT NULL AND target_type <> 'manufacturer' THEN 'manufacturer' END], lambda x: x IS NOT NULL) AS list_distinct_in_order,
      concat_ws(';', 'tmtid=' || id_lookup || '@1.0', 'manufacturer=' || manufacturer_filter || '@0.95', CASE WHEN nlem_filter THEN 'nlem=true@0.95' END, 'nlem_category=' || nlem_category || '@0.95', 'query=' || regexp_replace(query, '\s+', ' ', 'g') || '@0.7') AS slots, 'fallback_rule' AS query_slot_mode FROM a_read)""", "a_read"))
def q17(spark, d):
    shown = F.transform("slots", lambda s: F.concat(s["name"], F.lit("="), s["value"], F.lit("@"), s["confidence"].cast("string")))
    return read(spark, d).select("query_id", "target_type", "action", F.concat_ws(",", "topics").alias("topics"), F.concat_ws(";", shown).alias("slots"), "query_slot_mode")


S.fragment("a_terms", X.term_lists("asked", "question"), "asked")


@registered("q18_fulltext_terms", S.query("SELECT query_id, array_to_string(terms, '|') AS terms FROM a_terms", "a_terms"))
def q18(spark, d):
    return un.fulltext_terms(fx.asked(spark, d)).select("query_id", F.concat_ws("|", "terms").alias("terms"))


_SPREAD = S.squash(f"regexp_replace(joined, {S.quote('(' + lx.NUMBER + ')(' + lx.DOSE_UNIT_ALT + ')' + chr(92) + 'b')}, {S.quote(chr(92) + '1 ' + chr(92) + '2')}, 'gi')")


@registered("q19_query_variants", S.query(f"""
    SELECT query_id, UNNEST(v) AS text, generate_subscripts(v, 1) - 1 AS variant_no FROM (SELECT query_id, {S.distinct_in_order('l')} AS v FROM (
      SELECT query_id, [raw, joined, {_SPREAD}] AS l FROM (SELECT query_id, {S.squash('question')} AS raw, {S.join_doses('question')} AS joined FROM asked)))""", "asked"))
def q19(spark, d):
    return un.query_variants(fx.asked(spark, d))


S.fragment("a_routed", "SELECT *, CASE WHEN id_lookup IS NOT NULL THEN 'id_lookup' WHEN action = 'verify' THEN 'verify' WHEN action = 'count' THEN 'analyze_count' WHEN action = 'compare' THEN 'analyze_compare' WHEN action = 'list' THEN 'list' ELSE 'lookup' END AS operator FROM a_read", "a_read")


@registered("q20_route_operator", S.query("SELECT query_id, operator FROM a_routed", "a_routed"))
def q20(spark, d):
    return un.route_operator(read(spark, d)).select("query_id", "operator")


_PARTS = S.distinct_in_order(f"list_filter(list_transform(regexp_split_to_array({S.join_doses('source')}, {S.quote('(?i)' + lx.COMPARE_SPLIT)}), lambda x: {S.join_doses('x')}), lambda x: length(x) >= 2)")


@registered("q21_compare_terms", S.query(f"""
    SELECT query_id, UNNEST(t) AS term, generate_subscripts(t, 1) - 1 AS term_no FROM (SELECT query_id, (CASE WHEN len(p) > 0 THEN p ELSE [coalesce(nullif(source, ''), 'drug')] END)[1:2] AS t FROM (
      SELECT query_id, source, {_PARTS} AS p FROM (SELECT query_id, question AS source FROM templated)))""", "templated"))
def q21(spark, d):
    rows = fx.templated(spark, d).withColumn("query", F.col("question")).withColumn("slots", F.array().cast("array<struct<name:string,value:string,confidence:double,source:string>>"))
    return un.compare_terms(rows)


QS.questions("templated", "h", None, "templated")


@registered("q22_anchor_hints", S.query("SELECT query_id, hint_substance, hint_maker, hint_dose, wants_trade_name, wants_maker, has_anchor FROM h_hints", "h_hints"))
def q22(spark, d):
    rows = un.anchor_hints(un.assemble_intent(fx.templated(spark, d), fx.manufacturer_dim(spark, d)))
    return rows.select("query_id", "hint_substance", "hint_maker", "hint_dose", "wants_trade_name", "wants_maker", "has_anchor")


@registered("m12_intent_consistency", S.query("""
    SELECT query_id, CASE WHEN strategy IN ('count', 'list', 'verify') THEN strategy ELSE 'lookup' END = action AS action_equal, true AS topics_contain_target, abs(vector_weight - 0.5) < 1e-9 AND abs(fulltext_weight - 0.5) < 1e-9 AS weights_equal,
      CASE WHEN CASE WHEN strategy IN ('count', 'list', 'verify') THEN strategy ELSE 'lookup' END = action AND abs(vector_weight - 0.5) < 1e-9 AND abs(fulltext_weight - 0.5) < 1e-9 THEN 'PASS' ELSE 'REVIEW' END AS status FROM a_read""", "a_read"))
def m12(spark, d):
    rows = read(spark, d)
    old = rows.select("query_id", "strategy", "target_type", F.lit(0.5).alias("vector_weight"), F.lit(0.5).alias("fulltext_weight"))
    return mt.intent_consistency(old, rows)


# ---------------------------------------------------------------- context
_KINDS = "(['manufacturer','substance','nlem','hierarchy','formula','general'])"
S.fragment("typed", f"SELECT query_id, {_KINDS}[CAST(substr(query_id, 3) AS BIGINT) % 6 + 1] AS target_type, (['list','compare','verify','lookup'])[CAST(substr(query_id, 3) AS BIGINT) % 4 + 1] AS action, 'top ' || (CAST(substr(query_id, 3) AS BIGINT) % 30) || ' names' AS question FROM requests", "requests")
S.fragment("profile", "SELECT * FROM (VALUES " + ", ".join(f"({S.quote(t)}, [{S.listing(lv)}], [{S.listing(fields)}], {cap})" for t, lv, fields, cap in lx.SEARCH_PROFILES) + ") p(target_type, lv, fields, cap)")


def _field(name: str) -> str:
    return f"CASE WHEN list_contains(p.fields, '{name}') AND CAST(n.{name} AS VARCHAR) <> '' THEN n.{name} END"


_BR = r"regexp_extract_all(coalesce(fsn0, ''), '\(([^)]+)\)', 1)"
S.fragment("ent", f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN target_type = 'manufacturer' AND level <> 'TP' THEN 1 ELSE 0 END,
      coalesce(CASE WHEN target_type = 'manufacturer' THEN coalesce(trade_name, trade_name_fallback, fsn) ELSE fsn END, ''), tmtid) AS rank FROM (
    SELECT query_id, target_type, level, tmtid, cap, trade_name, manufacturer, fsn, CASE WHEN level IN ('TP', 'TPU') AND contains(fsn0, '(') AND trade_name IS NULL THEN nullif(trim(split_part(fsn0, '(', 1)), '') END AS trade_name_fallback,
      CASE WHEN level IN ('TP', 'TPU') AND contains(fsn0, '(') AND manufacturer IS NULL THEN nullif(trim({_BR}[1]), '') END AS manufacturer_fallback,
      CASE WHEN target_type IN ('formula', 'substance') THEN nullif(trim({_BR}[2]), '') END AS substances_fallback FROM (
      SELECT x.query_id, q.target_type, n.level, n.tmtid, p.cap, n.fsn AS fsn0, {_field('trade_name')} AS trade_name, {_field('manufacturer')} AS manufacturer, {_field('fsn')} AS fsn
      FROM (SELECT DISTINCT query_id, node_id FROM (SELECT query_id, node_id FROM context_seeds UNION ALL SELECT query_id, node_id FROM x_ctx WHERE NOT is_seed UNION ALL SELECT query_id, start_id FROM x_rels UNION ALL SELECT query_id, end_id FROM x_rels)) x
      JOIN typed q USING (query_id) JOIN profile p ON p.target_type = q.target_type JOIN nodes n ON n.node_id = x.node_id AND list_contains(p.lv, n.level)))
    QUALIFY rank <= cap""", "context_seeds", "x_ctx", "x_rels", "typed", "profile", "nodes")
S.fragment("proof", f"""SELECT r.query_id, row_number() OVER (PARTITION BY r.query_id ORDER BY r.found_at, r.start_id, r.type, r.end_id) AS rank, r.type AS rel, r.start_id, r.end_id,
    a.level || ':' || coalesce(a.name, a.fsn, a.trade_name, 'Unknown') AS "start", b.level || ':' || coalesce(b.name, b.fsn, b.trade_name, 'Unknown') AS "end"
    FROM x_rels r JOIN nodes a ON a.node_id = r.start_id JOIN nodes b ON b.node_id = r.end_id QUALIFY rank <= 20""", "x_rels", "nodes")


def typed(spark, d) -> DataFrame:
    k = F.substring("query_id", 3, 20).cast("bigint")
    kinds = F.array(*[F.lit(t) for t in ("manufacturer", "substance", "nlem", "hierarchy", "formula", "general")])
    acts = F.array(*[F.lit(t) for t in ("list", "compare", "verify", "lookup")])
    return fx.search_requests(spark, d).select(
        "query_id", F.element_at(kinds, (k % 6 + 1).cast("int")).alias("target_type"), F.element_at(acts, (k % 4 + 1).cast("int")).alias("action"),
        F.concat(F.lit("top "), (k % 30).cast("string"), F.lit(" names")).alias("question"))


def surroundings(spark, d):
    seeds = once(spark, d, "context_found", lambda: found_seeds(spark, d).where("rank <= 10"))
    if (spark.sparkContext.applicationId, d) not in _AROUND:
        _AROUND[(spark.sparkContext.applicationId, d)] = request_context(spark, d)
    return seeds, _AROUND[(spark.sparkContext.applicationId, d)]


_AROUND: dict = {}


def entities(spark, d) -> DataFrame:
    seeds, around = surroundings(spark, d)
    return cx.extract_entities(seeds, around.nodes.where("not is_seed"), around.relationships, fx.catalogue(spark, d).nodes, typed(spark, d))


@registered("x1_extract_entities", S.query("SELECT query_id, rank, level, tmtid, trade_name, manufacturer, fsn, trade_name_fallback, manufacturer_fallback, substances_fallback FROM ent", "ent"))
def x1(spark, d):
    return entities(spark, d).select("query_id", "rank", "level", "tmtid", "trade_name", "manufacturer", "fsn", "trade_name_fallback", "manufacturer_fallback", "substances_fallback")


@registered("x2_evidence", S.query('SELECT query_id, rank, rel, start_id, end_id, "start", "end" FROM proof', "proof"))
def x2(spark, d):
    return cx.evidence(surroundings(spark, d)[1].relationships)


@registered("x3_pack_context", S.query("""
    SELECT q.query_id, q.action AS action_intent, lim AS requested_limit, (SELECT count(*) FROM ent e WHERE e.query_id = q.query_id) AS total_entities,
      coalesce((SELECT string_agg(e.tmtid || '/' || e.level || '/' || coalesce(e.trade_name, e.trade_name_fallback, '-') || '/' || coalesce(e.manufacturer, e.manufacturer_fallback, '-'), ';' ORDER BY e.rank) FROM ent e WHERE e.query_id = q.query_id AND e.rank <= ecap), '') AS entities,
      coalesce((SELECT string_agg(p."start" || '>' || p.rel || '>' || p."end", ';' ORDER BY p.rank) FROM proof p WHERE p.query_id = q.query_id AND p.rank <= 8), '') AS evidence
    FROM (SELECT *, CASE action WHEN 'compare' THEN 12 WHEN 'verify' THEN 10 WHEN 'list' THEN least(20, greatest(8, lim * 3)) ELSE 12 END AS ecap FROM (
      SELECT *, CASE WHEN action = 'list' THEN greatest(1, least(20, CAST(substr(query_id, 3) AS BIGINT) % 30)) ELSE 5 END AS lim FROM typed)) q""", "typed", "ent", "proof"))
def x3(spark, d):
    """The packed documents, read back to compare their content."""
    packed = cx.pack_context(typed(spark, d), entities(spark, d), cx.evidence(surroundings(spark, d)[1].relationships))
    shape = ("struct<action_intent:string,requested_limit:int,total_entities:bigint,entities:array<struct<tmtid:string,level:string,trade_name:string,fsn:string,manufacturer:string>>,"
             "evidence:array<struct<start_id:string,end_id:string,rel:string,start:string,end:string>>>")
    c = packed.select("query_id", F.from_json("context", shape).alias("c"))
    def dash(x):
        return F.coalesce(x, F.lit("-"))
    return c.select(
        "query_id", "c.action_intent", "c.requested_limit", "c.total_entities",
        F.concat_ws(";", F.transform("c.entities", lambda e: F.concat_ws("/", e["tmtid"], e["level"], dash(e["trade_name"]), dash(e["manufacturer"])))).alias("entities"),
        F.concat_ws(";", F.transform("c.evidence", lambda e: F.concat_ws(">", e["start"], e["rel"], e["end"]))).alias("evidence"))


@registered("x4_render_counts", f"""
    SELECT CAST(l_partkey AS VARCHAR) AS query_id, CASE WHEN l_partkey % 7 = 0 THEN {S.quote(lx.COUNT_MISSING)} WHEN l_partkey % 2 = 0 THEN replace({S.quote(lx.COUNT_ANSWER)}, '%d', CAST(count(*) AS VARCHAR))
      ELSE replace({S.quote(lx.COUNT_ANSWER_PLAIN)}, '%d', CAST(count(*) AS VARCHAR)) END AS answer FROM lineitem GROUP BY l_partkey""")
def x4(spark, d):
    counts = fx.table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    k = F.col("l_partkey")
    rows = counts.select(k.cast("string").alias("query_id"), F.when(k % 7 == 0, "many").otherwise(F.col("n").cast("string")).alias("result"), F.when(k % 2 == 0, "substance_graph_gp").otherwise("").alias("count_mode"))
    return cx.render_counts(rows).select("query_id", "answer")
