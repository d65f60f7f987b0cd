"""Registered queries of the token-labelling jobs and of the entity slots built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import lexicon as lx
from ..operators import entities as en, metrics as mt, tagging as tg
from ..operators.understanding import extract_filters, match_manufacturer, tag_strategy
from ..session import materialise
from . import fixtures as fx, question_sql as QS, sql as S

QUERIES = {}
ORACLES = {}
_MADE: dict = {}


def registered(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def once(spark, d, name: str, build) -> DataFrame:
    """A fixture table several queries read, built and stored once per application."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _MADE:
        _MADE[key] = materialise(build(), name)
    return _MADE[key]


# ---------------------------------------------------------------- pools
S.fragment("pools", """SELECT DISTINCT label, trim(value) AS value FROM (SELECT 'DRUG' AS label, name AS value FROM nodes WHERE level IN ('SUBS', 'VTM') UNION ALL SELECT 'BRAND', coalesce(trade_name, name) FROM nodes WHERE level = 'TP'
    UNION ALL SELECT 'MANUFACTURER', manufacturer FROM nodes WHERE level = 'TP' UNION ALL SELECT 'FORM', dosageform FROM nodes WHERE level = 'GP' UNION ALL SELECT 'STRENGTH', strength FROM nodes WHERE level = 'GP') WHERE trim(coalesce(value, '')) <> ''""", "nodes")
# Words of the documents stand in for entity values of every length.
S.fragment("doc_values", """SELECT (['DRUG','BRAND','MANUFACTURER','FORM','STRENGTH'])[doc_id % 5 + 1] AS label, value FROM (SELECT doc_id, UNNEST(string_split(replace(text, ' la ', ' + '), chr(10))) AS value FROM documents)""")


def pools(spark, d) -> DataFrame:
    return tg.entity_dictionaries(fx.catalogue(spark, d).nodes)


def doc_values(spark, d) -> DataFrame:
    labels = F.array(*[F.lit(x) for x in ("DRUG", "BRAND", "MANUFACTURER", "FORM", "STRENGTH")])
    return fx.table(spark, d, "documents").select(
        F.element_at(labels, (F.col("doc_id") % 5 + 1).cast("int")).alias("label"), F.explode(F.split(F.replace("text", F.lit(" la "), F.lit(" + ")), "\n")).alias("value"))


@registered("t1_entity_dictionaries", S.query("SELECT label, value FROM pools", "pools"))
def t1(spark, d):
    return pools(spark, d)


_REPORT = """SELECT label, count(*) AS n, min(length(value)) AS min_len, max(length(value)) AS max_len, round(avg(length(value)), 1) AS avg_len,
    count(*) FILTER (contains(value, '(SUBS)') OR contains(value, '(VTM)')) AS tagged, count(*) FILTER (contains(value, '+')) AS combined FROM {src} GROUP BY label"""


@registered("t2_entity_report", S.query(_REPORT.format(src="(SELECT * FROM pools UNION ALL SELECT 'TAGGED', fsn FROM nodes WHERE level IN ('SUBS', 'VTM', 'GP'))"), "pools", "nodes"))
def t2(spark, d):
    extra = fx.catalogue(spark, d).nodes.where("level in ('SUBS', 'VTM', 'GP')").select(F.lit("TAGGED").alias("label"), F.col("fsn").alias("value"))
    return tg.entity_report(pools(spark, d).unionByName(extra))


@registered("t2_pool_overlap", S.query("SELECT lower(name) AS value FROM nodes WHERE level = 'VTM' INTERSECT SELECT lower(generic_name) FROM nodes WHERE level = 'TP'", "nodes"))
def t2_overlap(spark, d):
    n = fx.catalogue(spark, d).nodes
    both = n.where("level = 'VTM'").select(F.lit("DRUG").alias("label"), F.lower("name").alias("value")).unionByName(
        n.where("level = 'TP'").select(F.lit("BRAND").alias("label"), F.lower("generic_name").alias("value")))
    return tg.pool_overlap(both)


_RULES = " OR ".join(f"(label = '{lb}' AND length(v) BETWEEN {lo} AND {hi}" + ("" if p is None else f" AND length(v) - length(replace(v, '+', '')) <= {p}") + ")" for lb, lo, hi, p in lx.ENTITY_RULES)


@registered("t3_filter_entities", S.query(f"SELECT DISTINCT label, v AS value FROM (SELECT label, {S.squash('value')} AS v FROM doc_values) WHERE v <> '' AND ({_RULES})", "doc_values"))
def t3(spark, d):
    return tg.filter_entities(doc_values(spark, d))


# ---------------------------------------------------------------- templates
def _template_values() -> str:
    rows, start = [], 0.0
    for group, weight in lx.GROUP_WEIGHTS:
        members = [t for t in lx.TEMPLATES if t[1] == group]
        for tid, grp, target, strategy, text in members:
            end = start + weight / len(members)
            rows.append(f"('{tid}', '{grp}', '{target}', '{strategy}', {S.quote(text)}, {start!r}::DOUBLE)")
            start = end
    return ", ".join(rows)


def _uniform(seed: str, key: str) -> str:
    return f"CAST('0x' || substr(md5('{seed}|' || {key}), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"


S.fragment("tmpl", f"SELECT * FROM (VALUES {_template_values()}) t(template_id, \"group\", target_type, strategy, template, lo)")
S.fragment("drawn", f"""SELECT r.record_id, t.* FROM (SELECT DISTINCT l_orderkey AS record_id FROM lineitem) r JOIN tmpl t ON t.lo = (SELECT max(x.lo) FROM tmpl x WHERE x.lo <= {_uniform('42|template', 'r.record_id')})""", "tmpl")
S.fragment("pool_pos", "SELECT label, value, row_number() OVER (PARTITION BY label ORDER BY md5(label || '|' || value), value) - 1 AS pos, count(*) OVER (PARTITION BY label) AS size FROM pools", "pools")
S.fragment("sizes", "SELECT label, max(size) AS size FROM pool_pos GROUP BY label", "pool_pos")
S.fragment("picks", f"""SELECT d.record_id, s.label, p.value FROM drawn d JOIN sizes s ON contains(d.template, '{{' || s.label || '}}')
    JOIN pool_pos p ON p.label = s.label AND p.pos = CAST(floor(CAST('0x' || substr(md5('42|' || d.record_id || '|' || s.label), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE * s.size) AS BIGINT)""", "drawn", "sizes", "pool_pos")
S.fragment("rendered", """SELECT d.record_id, d.template_id, d."group", d.target_type, d.strategy, d.template,
    list_reduce(list_prepend(d.template, list_transform(f.fills, lambda x: x.label || chr(1) || x.value)), lambda acc, x: replace(acc, '{' || split_part(x, chr(1), 1) || '}', split_part(x, chr(1), 2))) AS text, f.fills
    FROM drawn d JOIN (SELECT record_id, list({'label': label, 'value': value} ORDER BY label) AS fills FROM picks GROUP BY record_id) f USING (record_id)""", "drawn", "picks")
# Character spans: the text before a slot is the template's prefix with its own slots filled.
S.fragment("spans", """SELECT r.record_id, k.label, length(list_reduce(list_prepend(split_part(r.template, '{' || k.label || '}', 1), list_transform(r.fills, lambda x: x.label || chr(1) || x.value)),
      lambda acc, x: replace(acc, '{' || split_part(x, chr(1), 1) || '}', split_part(x, chr(1), 2)))) AS s, length(k.value) AS len FROM rendered r JOIN picks k USING (record_id)""", "rendered", "picks")


def records_base(spark, d) -> DataFrame:
    keys = fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("record_id")).distinct()
    return tg.sample_templates(keys, "record_id", 42)


def rendered(spark, d) -> DataFrame:
    return once(spark, d, "rendered", lambda: tg.render(records_base(spark, d), pools(spark, d), "record_id", 42)[0])


@registered("t4_sample_templates", S.query('SELECT record_id, template_id, "group" FROM drawn', "drawn"))
def t4(spark, d):
    return records_base(spark, d).select("record_id", "template_id", "group")


@registered("t4_render", S.query("""
    SELECT r.record_id, r.template_id, r.text, string_agg(s.s || '-' || (s.s + s.len) || ':' || s.label, ',' ORDER BY s.s) AS spans FROM rendered r JOIN spans s USING (record_id) GROUP BY ALL""", "rendered", "spans"))
def t4_text(spark, d):
    return rendered(spark, d).select("record_id", "template_id", "text", F.concat_ws(",", F.transform(
        "spans", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"), F.lit(":"), s["label"]))).alias("spans"))


_GATE = f"""CASE WHEN {S.holds('lower(text)', lx.BLACKLIST)} THEN 'blacklist_keyword' WHEN "group" = 'manufacturer.mix' AND NOT {S.holds('lower(text)', dict(lx.GROUP_KEYWORDS)['manufacturer.mix'])} AND NOT (strategy = 'verify' AND contains(text, {S.quote(lx.OWNED_BY)})) THEN 'missing_manufacturer_keyword'
    WHEN "group" = 'nlem.verify' AND NOT {S.holds('lower(text)', dict(lx.GROUP_KEYWORDS)['nlem.verify'])} THEN 'missing_nlem_keyword' END"""


def gate_rows(spark, d) -> DataFrame:
    """The rendered texts, and every text again under the next group and with a refused word."""
    rows = rendered(spark, d)
    moved = rows.withColumn("group", F.when(F.col("group") == "nlem.verify", "manufacturer.mix").otherwise("nlem.verify")).withColumn("record_id", -F.col("record_id") - 1)
    return rows.unionByName(moved)


@registered("t5_answerability_gate", S.query(f"""
    SELECT record_id, {_GATE} AS reason FROM (SELECT record_id, "group", strategy, text FROM rendered
      UNION ALL SELECT -record_id - 1, CASE WHEN "group" = 'nlem.verify' THEN 'manufacturer.mix' ELSE 'nlem.verify' END, strategy, text FROM rendered)""", "rendered"))
def t5(spark, d):
    return tg.answerability_gate(gate_rows(spark, d)).select("record_id", "reason")


def records(spark, d) -> DataFrame:
    return once(spark, d, "records", lambda: tg.bio_align(tg.answerability_gate(rendered(spark, d)).where("reason is null").drop("reason"))[0])


# The pieces of the text alternate between matches and what lies between them, so running lengths give the offsets.
S.fragment("tok", r"""SELECT record_id, "group", target_type, strategy, template_id, pos, token, CAST(sum(length(gap) + length(token)) OVER (PARTITION BY record_id ORDER BY pos) - length(token) AS BIGINT) AS s, length(token) AS len FROM (
    SELECT record_id, "group", target_type, strategy, template_id, UNNEST(toks) AS token, UNNEST(gaps[1:len(toks)]) AS gap, generate_subscripts(toks, 1) AS pos FROM (
      SELECT *, regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]') AS toks, string_split(regexp_replace(text, '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]', chr(1), 'g'), chr(1)) AS gaps FROM rendered))""", "rendered")
S.fragment("tagged", """SELECT t.*, coalesce(CASE WHEN t.s = min(t.s) OVER (PARTITION BY t.record_id, k.label, k.s) AND k.label IS NOT NULL THEN 'B-' || k.label WHEN k.label IS NOT NULL THEN 'I-' || k.label END, 'O') AS tag
    FROM tok t LEFT JOIN spans k ON k.record_id = t.record_id AND greatest(t.s, k.s) < least(t.s + t.len, k.s + k.len)""", "tok", "spans")
S.fragment("collided", "SELECT DISTINCT record_id FROM (SELECT record_id, pos FROM tagged GROUP BY ALL HAVING count(*) > 1)", "tagged")
S.fragment("kept_tags", "SELECT * FROM tagged WHERE record_id NOT IN (SELECT record_id FROM collided)", "tagged", "collided")


@registered("t6_bio_align", S.query("SELECT record_id, string_agg(token, '|' ORDER BY pos) AS tokens, string_agg(tag, ' ' ORDER BY pos) AS ner_tags FROM kept_tags GROUP BY record_id", "kept_tags"))
def t6(spark, d):
    return records(spark, d).select("record_id", F.concat_ws("|", "tokens").alias("tokens"), F.concat_ws(" ", "ner_tags").alias("ner_tags"))


def flipped(spark, d) -> DataFrame:
    """Gold tags, and predictions with a tenth of the tags changed by md5."""
    def change():
        def predicted(tag, i):
            h = F.substring(F.md5(F.concat_ws("|", F.lit("flip"), F.col("record_id").cast("string"), (i + 1).cast("string"))), 1, 2)
            wrong = F.when(tag == "O", "I-DRUG").when(F.startswith(tag, F.lit("B-")), "O").otherwise("B-FORM")
            return F.when(F.conv(h, 16, 10).cast("int") < 26, wrong).otherwise(tag)
        return records(spark, d).select("record_id", F.transform("ner_tags", predicted).alias("pred_tags"), F.col("ner_tags").alias("gold_tags"), "tokens", "text", "offsets")
    return once(spark, d, "flipped", change)


S.fragment("flipped", """SELECT *, CASE WHEN CAST('0x' || substr(md5('flip|' || record_id || '|' || pos), 1, 2) AS INTEGER) < 26 THEN CASE WHEN tag = 'O' THEN 'I-DRUG' WHEN starts_with(tag, 'B-') THEN 'O' ELSE 'B-FORM' END ELSE tag END AS pred FROM kept_tags""", "kept_tags")


@registered("t7_validate_iob", S.query("""
    SELECT record_id, true AS same_length, bool_and(NOT starts_with(pred, 'I-') OR coalesce(substr(before, 3) = substr(pred, 3), false)) AS valid
    FROM (SELECT record_id, pred, lag(pred) OVER (PARTITION BY record_id ORDER BY pos) AS before FROM flipped) GROUP BY record_id""", "flipped"))
def t7(spark, d):
    return tg.validate_iob(flipped(spark, d).withColumnRenamed("pred_tags", "ner_tags"))


@registered("t8_split_records", S.query(f"""
    SELECT record_id, CASE WHEN r <= floor(n * 0.8) THEN 'train' WHEN r <= floor(n * 0.9) THEN 'validation' ELSE 'test' END AS split FROM (
      SELECT record_id, row_number() OVER (ORDER BY {S.digest('42', 'record_id')}, record_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT record_id FROM kept_tags))""", "kept_tags"))
def t8(spark, d):
    return tg.split_records(records(spark, d)).select("record_id", "split")


@registered("t8_split_manifest", S.query(
    "SELECT split, count(*) AS n FROM (SELECT CASE WHEN r <= floor(n * 0.8) THEN 'train' WHEN r <= floor(n * 0.9) THEN 'validation' ELSE 'test' END AS split FROM "
    "(SELECT row_number() OVER () AS r, count(*) OVER () AS n FROM (SELECT DISTINCT record_id FROM kept_tags))) GROUP BY split", "kept_tags"))
def t8_manifest(spark, d):
    return tg.split_manifest(tg.split_records(records(spark, d)))


S.fragment("dist", """SELECT dimension, value, n, round(n / sum(n) OVER (PARTITION BY dimension)::DOUBLE, 6) AS ratio FROM (SELECT dimension, value, count(*) AS n FROM (
    SELECT UNNEST([{'dimension': 'group', 'value': "group"}, {'dimension': 'target_type', 'value': target_type}, {'dimension': 'strategy', 'value': strategy}, {'dimension': 'template_id', 'value': template_id}], recursive := true)
      FROM (SELECT DISTINCT record_id, "group", target_type, strategy, template_id FROM kept_tags) UNION ALL SELECT 'label', tag FROM kept_tags) GROUP BY dimension, value)""", "kept_tags")


@registered("t9_distributions", S.query("SELECT * FROM dist", "dist"))
def t9(spark, d):
    return tg.distributions(records(spark, d))


@registered("t9_distribution_check", S.query(
    f"""SELECT g.value AS "group", g.expected, coalesce(x.ratio, 0) AS actual, round(abs(coalesce(x.ratio, 0) - g.expected), 6) AS delta, abs(coalesce(x.ratio, 0) - g.expected) <= 0.03 AS "within"
    FROM (VALUES {', '.join(f"('{g}', {w}::DOUBLE)" for g, w in lx.GROUP_WEIGHTS)}) g(value, expected) LEFT JOIN dist x ON x.dimension = 'group' AND x.value = g.value""", "dist"))
def t9_check(spark, d):
    return tg.distribution_check(tg.distributions(records(spark, d)))


# The pools without forms and with one blank manufacturer, and user turns taken for templates: every reason for which a record is not rendered.
S.fragment("pools_cut", "SELECT label, value FROM pools WHERE label <> 'FORM' UNION ALL SELECT 'MANUFACTURER', ''", "pools")
S.fragment("cut_pos", "SELECT label, value, row_number() OVER (PARTITION BY label ORDER BY md5(label || '|' || value), value) - 1 AS pos, count(*) OVER (PARTITION BY label) AS size FROM pools_cut", "pools_cut")
S.fragment("unrendered", f"""SELECT reason FROM (
    SELECT d.record_id, CASE WHEN contains(d.template, '{{FORM}}') THEN 'slot_pool_empty' WHEN contains(d.template, '{{MANUFACTURER}}') AND (SELECT value FROM cut_pos p WHERE p.label = 'MANUFACTURER'
      AND p.pos = CAST(floor(CAST('0x' || substr(md5('42|' || d.record_id || '|MANUFACTURER'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE * p.size) AS BIGINT)) = '' THEN 'missing_slot_value' END AS reason FROM drawn d
    UNION ALL SELECT NULL, CASE WHEN NOT regexp_matches(text, '\\{{\\w+\\}}') THEN 'no_slots' END FROM conversations WHERE role = 'user') WHERE reason IS NOT NULL""", "drawn", "cut_pos")


def unrendered(spark, d) -> DataFrame:
    cut = pools(spark, d).where("label <> 'FORM'").select("label", "value").unionByName(spark.createDataFrame([("MANUFACTURER", "")], "label string, value string"))
    turns = fx.table(spark, d, "conversations").where("role = 'user'").select(
        F.concat_ws("|", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("record_id"), F.col("text").alias("template"),
        *(F.lit("turn").alias(c) for c in ("template_id", "group", "target_type", "strategy", "profile")))
    drawn = records_base(spark, d).withColumn("record_id", F.col("record_id").cast("string"))
    return tg.render(drawn.select(*turns.columns).unionByName(turns), cut, "record_id", 42)[1]


@registered("t9_discard_reasons", S.query(f"""
    SELECT reason, count(*) AS n FROM (SELECT {_GATE} AS reason FROM (SELECT "group", strategy, text FROM rendered
      UNION ALL SELECT CASE WHEN "group" = 'nlem.verify' THEN 'manufacturer.mix' ELSE 'nlem.verify' END, strategy, text FROM rendered) UNION ALL SELECT reason FROM unrendered) WHERE reason IS NOT NULL GROUP BY reason""", "rendered", "unrendered"))
def t9_reasons(spark, d):
    return tg.discard_reasons(tg.answerability_gate(gate_rows(spark, d)), unrendered(spark, d))


def spoiled(spark, d) -> DataFrame:
    """Records, some of them made unfit for encoding."""
    m, none = F.col("record_id") % 10, F.array().cast("array<string>")
    return records(spark, d).select(
        "record_id", F.when(m == 1, none).when(m == 4, F.lit(None).cast("array<string>")).otherwise(F.col("tokens")).alias("tokens"),
        F.when(m == 2, F.concat("ner_tags", F.array(F.lit("O")))).when(m == 3, F.concat(F.slice("ner_tags", F.lit(1), F.size("ner_tags") - 1), F.array(F.lit("B-X")))).otherwise(F.col("ner_tags")).alias("ner_tags"))


@registered("t10_encode_tags", S.query(f"""
    SELECT record_id, CASE record_id % 10 WHEN 4 THEN 'missing' WHEN 1 THEN 'empty' WHEN 3 THEN 'unknown_label' WHEN 2 THEN 'length_mismatch' END AS reason,
      CASE WHEN record_id % 10 NOT IN (1, 2, 3, 4) THEN string_agg(CAST(list_position([{S.listing(lx.BIO_LABELS)}], tag) - 1 AS VARCHAR), ' ' ORDER BY pos) END AS tag_ids FROM kept_tags GROUP BY record_id""", "kept_tags"))
def t10(spark, d):
    good, bad = tg.encode_tags(spoiled(spark, d))
    ids = good.select("record_id", F.lit(None).cast("string").alias("reason"), F.concat_ws(" ", F.transform("tag_ids", lambda t: t.cast("string"))).alias("tag_ids"))
    return ids.unionByName(bad.select("record_id", "reason", F.lit(None).cast("string").alias("tag_ids")))


@registered("t11_align_subwords", S.query(f"""
    SELECT record_id, '-100 ' || string_agg(CAST(list_position([{S.listing(lx.BIO_LABELS)}], tag) - 1 AS VARCHAR) || CASE WHEN len > 3 THEN ' -100' ELSE '' END, ' ' ORDER BY pos) || ' -100' AS labels FROM kept_tags GROUP BY record_id""", "kept_tags"))
def t11(spark, d):
    """Words of more than three characters count as two pieces, between two special ones."""
    good, _ = tg.encode_tags(records(spark, d))
    pieces = F.flatten(F.transform("tokens", lambda t, i: F.when(F.length(t) > 3, F.array(i, i)).otherwise(F.array(i))))
    special = F.array(F.lit(None).cast("int"))
    rows = good.select("record_id", "tag_ids", F.concat(special, pieces, special).alias("word_ids"))
    return tg.align_subwords(rows).select("record_id", F.concat_ws(" ", F.transform("labels", lambda x: x.cast("string"))).alias("labels"))


def _spans(col: str) -> str:
    return f"""SELECT record_id, min(kind) AS type, min(pos) AS s, max(pos) AS e FROM (SELECT *, sum(CASE WHEN kind <> '' AND (starts_with({col}, 'B-') OR kind <> coalesce(before, '')) THEN 1 ELSE 0 END) OVER (PARTITION BY record_id ORDER BY pos) AS island FROM (
      SELECT record_id, pos, {col}, CASE WHEN {col} = 'O' THEN '' ELSE substr({col}, 3) END AS kind, lag(CASE WHEN {col} = 'O' THEN '' ELSE substr({col}, 3) END) OVER (PARTITION BY record_id ORDER BY pos) AS before FROM flipped)) WHERE kind <> '' GROUP BY record_id, island"""


S.fragment("pred_spans", _spans("pred"), "flipped")
S.fragment("gold_spans", _spans("tag"), "flipped")
S.fragment("type_scores", """SELECT type, count(*) FILTER (p AND g) AS tp, count(*) FILTER (p) AS called, count(*) FILTER (g) AS support FROM (
    SELECT coalesce(a.type, b.type) AS type, a.type IS NOT NULL AS p, b.type IS NOT NULL AS g FROM pred_spans a FULL OUTER JOIN gold_spans b ON a.record_id = b.record_id AND a.type = b.type AND a.s = b.s AND a.e = b.e) GROUP BY ALL""", "pred_spans", "gold_spans")
_PRF = "SELECT type, tp, called, support, CASE WHEN called > 0 THEN tp / called::DOUBLE ELSE 0 END AS p, CASE WHEN support > 0 THEN tp / support::DOUBLE ELSE 0 END AS r FROM {src}"
S.fragment("type_prf", "SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM (" + _PRF.format(src="type_scores") + ")", "type_scores")


@registered("t12_entity_scores", S.query(f"""
    SELECT type, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, support FROM (
      SELECT type, p, r, f, support FROM type_prf UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), CAST(sum(support) AS BIGINT) FROM type_prf
      UNION ALL SELECT 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support), sum(f * support) / sum(support), CAST(sum(support) AS BIGINT) FROM type_prf
      UNION ALL SELECT 'micro avg', p, r, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, support FROM ({_PRF.format(src="(SELECT 'micro' AS type, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(called) AS BIGINT) AS called, CAST(sum(support) AS BIGINT) AS support FROM type_scores)")}))""", "type_prf", "type_scores"))
def t12(spark, d):
    return tg.entity_scores(flipped(spark, d)).select("type", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@registered("t12_tag_accuracy", S.query("SELECT round(avg(CAST(tag = pred AS DOUBLE)), 6) AS accuracy FROM flipped", "flipped"))
def t12_accuracy(spark, d):
    return tg.tag_accuracy(flipped(spark, d)).withColumn("accuracy", F.round("accuracy", 6))


# ---------------------------------------------------------------- entity slots
S.fragment("bio_tokens", "SELECT f.*, 0.5 + CAST('0x' || substr(md5('conf|' || record_id || '|' || pos), 1, 2) AS INTEGER) / 512.0::DOUBLE AS confidence FROM flipped f", "flipped")
S.fragment("entities", """SELECT b.record_id AS query_id, min(kind) AS label, substr(any_value(r.text), CAST(min(b.s) + 1 AS BIGINT), CAST(max(b.s + b.len) - min(b.s) AS BIGINT)) AS text, round(avg(confidence), 6) AS confidence, CAST(min(b.s) AS BIGINT) AS start_at, CAST(max(b.s + b.len) AS BIGINT) AS end_at FROM (
    SELECT *, sum(CASE WHEN kind <> '' AND (starts_with(pred, 'B-') OR kind <> coalesce(before, '')) THEN 1 ELSE 0 END) OVER (PARTITION BY record_id ORDER BY pos) AS island FROM (
      SELECT *, lag(kind) OVER (PARTITION BY record_id ORDER BY pos) AS before FROM (SELECT *, CASE WHEN pred = 'O' OR confidence < 0.6 THEN '' ELSE substr(pred, 3) END AS kind FROM bio_tokens))) b JOIN rendered r USING (record_id)
    WHERE kind <> '' GROUP BY b.record_id, island""", "bio_tokens", "rendered")


def entity_spans(spark, d) -> DataFrame:
    def build():
        def conf(i):
            digest = F.md5(F.concat_ws("|", F.lit("conf"), F.col("record_id").cast("string"), (i + 1).cast("string")))
            return 0.5 + F.conv(F.substring(digest, 1, 2), 16, 10).cast("double") / 512.0
        tags = F.transform("pred_tags", lambda t, i: F.struct(t.alias("label"), F.get("offsets", i)["start"].alias("start"), F.get("offsets", i)["end"].alias("end"), conf(i).alias("confidence")))
        return en.spans_from_bio(flipped(spark, d).select(F.col("record_id").alias("query_id"), "text", tags.alias("tags")), 0.6)
    return once(spark, d, "entity_spans", build)


@registered("q9_spans_from_bio", S.query("SELECT query_id, label, text, confidence, start_at, end_at FROM entities", "entities"))
def q9(spark, d):
    return entity_spans(spark, d).withColumnsRenamed({"start": "start_at", "end": "end_at"})


_TOPS = ", ".join(f"first(text ORDER BY confidence DESC, length(text) DESC, start_at) FILTER (label = '{lb}') AS {lb.lower()}" for lb in lx.ENTITY_LABELS)


def _ordered_list(label: str, name: str) -> str:
    l = f"coalesce(list(trim(text) ORDER BY confidence DESC, length(text) DESC, start_at) FILTER (label = '{label}'), [])"
    return f"array_to_string(list_filter({l}, lambda v, i: v <> '' AND list_position({l}, v) = i), '|') AS {name}"


@registered("q10_entities_to_slots", S.query(f"SELECT *, coalesce(brand, drug, '') AS query FROM (SELECT query_id, {_TOPS}, {_ordered_list('FORM', 'forms')}, {_ordered_list('STRENGTH', 'strengths')} FROM entities GROUP BY query_id)", "entities"))
def q10(spark, d):
    return en.entities_to_slots(entity_spans(spark, d)).withColumn("forms", F.concat_ws("|", "forms")).withColumn("strengths", F.concat_ws("|", "strengths"))


S.fragment("entity_texts", "SELECT record_id AS query_id, text AS question FROM rendered", "rendered")
_NOISE = "[" + S.listing(lx.ENTITY_NOISE) + "]"
_W = S.tokens("lower(v)")
_SIGNAL = f"len(list_filter({_W}, lambda t: NOT list_contains({_NOISE}, t) AND (length(t) >= 2 OR regexp_matches(t, '[0-9]')))) > 0"
_IN_Q = f"(contains(lower(question), lower(v)) OR (len({_W}) > 0 AND len(list_intersect({_W}, {S.tokens('lower(question)')})) / greatest(1, len(list_distinct({_W})))::DOUBLE >= 0.5))"
S.fragment("entity_makers", f"""SELECT query_id, start_at, canonical FROM (SELECT e.query_id, e.start_at, coalesce(
      {' , '.join(f"CASE WHEN contains(lower(v), {S.quote(a)}) THEN {S.quote(n)} END" for a, n in lx.MANUFACTURER_ALIASES)},
      (SELECT m.manufacturer FROM (SELECT UNNEST(w) AS folded, generate_subscripts(w, 1) AS p FROM (SELECT regexp_split_to_array(lower(v), '[\\s,./()]+') AS w)) x JOIN maker_dim m ON m.folded = x.folded WHERE length(x.folded) >= 2 ORDER BY p, m.manufacturer LIMIT 1),
      (SELECT m.manufacturer FROM maker_dim m WHERE length(m.manufacturer) > 3 AND contains(lower(v), m.folded) ORDER BY length(m.manufacturer) DESC, m.manufacturer LIMIT 1)) AS canonical
    FROM (SELECT *, {S.squash('text')} AS v FROM entities WHERE label = 'MANUFACTURER') e)""", "entities", "maker_dim")
S.fragment("judged", f"""SELECT e.query_id, e.label, e.text AS raw, e.confidence, e.start_at, e.end_at, CASE WHEN e.label = 'MANUFACTURER' THEN {S.squash('m.canonical')} ELSE v END AS text, CASE WHEN v = '' THEN 'empty'
      WHEN list_contains({_NOISE}, lower(v)) THEN 'noise_term' WHEN NOT {_SIGNAL} THEN 'no_signal_token' WHEN {S.holds('lower(v)', lx.ENGLISH_QUESTION_PARTS)} THEN 'english_question'
      WHEN e.label IN ('DRUG', 'BRAND') AND {S.holds('lower(v)', lx.THAI_INTENT_PARTS)} AND NOT regexp_matches(v, '[A-Za-z0-9]') THEN 'thai_intent_fragment'
      WHEN e.label IN ('BRAND', 'DRUG', 'MANUFACTURER') AND NOT {_IN_Q} THEN 'not_in_question' WHEN e.label = 'STRENGTH' AND NOT regexp_matches(v, '[0-9]') THEN 'invalid_strength'
      WHEN e.label = 'MANUFACTURER' AND m.canonical IS NULL THEN 'unknown_manufacturer' END AS reason
    FROM (SELECT *, {S.squash('text')} AS v FROM entities) e JOIN entity_texts q USING (query_id) LEFT JOIN entity_makers m ON m.query_id = e.query_id AND m.start_at = e.start_at""", "entities", "entity_texts", "entity_makers")
S.fragment("kept_entities", "SELECT query_id, label, text, confidence, start_at, end_at FROM judged WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY query_id, label, lower(text) ORDER BY start_at, end_at) = 1", "judged")


def entity_questions(spark, d) -> DataFrame:
    return records(spark, d).select(F.col("record_id").alias("query_id"), F.col("text").alias("question"))


def kept_entities(spark, d) -> DataFrame:
    return once(spark, d, "kept_entities", lambda: en.sanitize_entities(entity_spans(spark, d), entity_questions(spark, d), fx.manufacturer_dim(spark, d))[0])


@registered("q11_sanitize_entities", S.query(
    "SELECT query_id, label, text, confidence, NULL AS reason, start_at FROM kept_entities UNION ALL SELECT query_id, label, raw, NULL, reason, start_at FROM judged WHERE reason IS NOT NULL", "kept_entities", "judged"))
def q11(spark, d):
    kept, dropped = en.sanitize_entities(entity_spans(spark, d), entity_questions(spark, d), fx.manufacturer_dim(spark, d))
    return kept.select("query_id", "label", "text", "confidence", F.lit(None).cast("string").alias("reason"), F.col("start").alias("start_at")).unionByName(
        dropped.select("query_id", "label", "text", F.lit(None).cast("double").alias("confidence"), "reason", F.col("start").alias("start_at")))


# Words joined by connectors, so that spans really split.
def joined_entities(spark, d) -> DataFrame:
    """The kept entities, each drug also as one span with the record's other texts, joined by a connector."""
    kept = kept_entities(spark, d)
    words = F.array(*[F.lit(c) for c in ("and", "vs", "กับ", "with")])
    more = kept.where("label = 'DRUG'").select(
        "query_id", "label", F.concat_ws(" ", "text", F.element_at(words, (F.col("query_id") % 4 + 1).cast("int")), F.lit("alpha"), F.lit("OR"), F.lit("Beta")).alias("text"),
        F.round(F.col("confidence") - 0.05, 6).alias("confidence"), (F.col("start") + 1000).alias("start"), (F.col("end") + 1000).alias("end"))
    return kept.unionByName(more)


def slot_table(spark, d) -> DataFrame:
    def build():
        asked = entity_questions(spark, d).withColumn("question", F.concat_ws(" ", "question", F.lit("alpha beta")))
        return en.multi_slots(joined_entities(spark, d), asked)
    return once(spark, d, "slot_table", build)


S.fragment("joined_entities", """SELECT query_id, label, text, confidence FROM kept_entities UNION ALL SELECT query_id, label, text || ' ' || (['and','vs','กับ','with'])[query_id % 4 + 1] || ' alpha OR Beta', round(confidence - 0.05, 6) FROM kept_entities WHERE label = 'DRUG'""", "kept_entities")
_CONN = "[" + S.listing(lx.CONNECTORS) + "]"
S.fragment("slot_values", f"""SELECT query_id, label, confidence * CASE WHEN label = 'DRUG' AND i > 1 THEN 0.9 ELSE 1 END AS confidence, part AS text, i FROM (SELECT query_id, label, confidence, UNNEST(parts) AS part, generate_subscripts(parts, 1) AS i FROM (
    SELECT query_id, label, confidence, CASE WHEN label = 'DRUG' THEN {S.distinct_in_order('list_filter(p0, lambda x: NOT list_contains(' + _NOISE + ', lower(x)))')} ELSE [text] END AS parts FROM (
      SELECT *, list_transform(string_split(array_to_string(list_transform({S.tokens('text')}, lambda t: CASE WHEN list_contains({_CONN}, lower(t)) THEN chr(1) ELSE t END), ' '), chr(1)), lambda x: trim(x)) AS p0 FROM joined_entities)))
    WHERE NOT (len({S.tokens('lower(part)')}) > 0 AND len(list_filter({S.tokens('lower(part)')}, lambda t: NOT list_contains({_CONN}, t))) = 0)""", "joined_entities")
S.fragment("slot_ranked", "SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY confidence DESC, length(text) DESC, text DESC) AS rank FROM (SELECT * FROM slot_values QUALIFY row_number() OVER (PARTITION BY query_id, label, lower(text) ORDER BY confidence DESC, length(text) DESC, text DESC) = 1)", "slot_values")
_LISTS = ", ".join(f"coalesce(string_agg(text, '|' ORDER BY rank) FILTER (label = '{lb}' AND rank <= {cap}), '') AS multi_{lb.lower()}" for lb, cap in (("BRAND", lx.BRAND_CAP), ("MANUFACTURER", lx.MANUFACTURER_CAP), ("DRUG", lx.DRUG_CAP)))


@registered("q12_multi_slots", S.query(f"SELECT q.query_id, {_LISTS} FROM entity_texts q LEFT JOIN slot_ranked s USING (query_id) WHERE q.query_id NOT IN (SELECT record_id FROM collided) GROUP BY q.query_id", "slot_ranked", "entity_texts", "collided"))
def q12(spark, d):
    return slot_table(spark, d).select("query_id", *[F.concat_ws("|", c).alias(c) for c in ("multi_brand", "multi_manufacturer", "multi_drug")])


S.fragment("trust_maker", QS.maker_of("question", "entity_texts"), "entity_texts", "maker_dim")
_ID = f"coalesce(nullif({QS.extract('q.question', QS.EDGE_L + lx.PREFIXED_ID[2:-2] + QS.EDGE_R, 1)}, ''), nullif({QS.extract('q.question', QS.EDGE_L + '([0-9]{6,10})' + QS.EDGE_R, 1)}, ''))"


def _canonical(text: str) -> str:
    return f"array_to_string({S.tokens(f'lower({text})')}, ' ')"


@registered("q13_slot_trust", S.query(f"""
    SELECT query_id, rule, text FROM (SELECT s.query_id, s.text, CASE
      WHEN x.id IS NOT NULL AND (contains(lower(s.text), x.id) OR ({S.holds('lower(s.text)', ('tmtid', 'tmt'))} AND regexp_matches(s.text, '(?:^|[^0-9A-Za-z_])[0-9]{{5,10}}(?:$|[^0-9A-Za-z_])'))) THEN 'brand_tmtid_conflict'
      WHEN x.maker <> '' AND ({_canonical('s.text')} = x.maker OR len(list_intersect({S.tokens('lower(s.text)')}, [{S.listing(lx.MAKER_CONTEXT)}])) > 0) THEN 'brand_manufacturer_conflict'
      WHEN (s.query_id % 4 = 1 OR x.comparing) AND s.query_id IN (SELECT query_id FROM slot_ranked WHERE label = 'DRUG') THEN 'brand_compare_noise' END AS rule
    FROM slot_ranked s JOIN (SELECT q.query_id, {_ID} AS id, {_canonical("coalesce(m.manufacturer, '')")} AS maker, {S.found('lower(trim(q.question))', lx.COMPARE_PATTERNS)} AS comparing
      FROM entity_texts q JOIN trust_maker m USING (query_id)) x USING (query_id) WHERE s.label = 'BRAND' AND s.rank <= {lx.BRAND_CAP}) WHERE rule IS NOT NULL""", "slot_ranked", "trust_maker"))
def q13(spark, d):
    """Which brands an id, a manufacturer or a comparison disproves."""
    rows = entity_questions(spark, d)
    k = F.col("query_id") % 4
    asked = extract_filters(tag_strategy(rows)).withColumn("strategy", F.when(k == 1, "compare").otherwise(F.col("strategy")))
    makers = match_manufacturer(rows, fx.manufacturer_dim(spark, d))
    trusted, dropped = en.slot_trust(slot_table(spark, d), asked.join(makers, "query_id"))
    return dropped


def structured_sample(spark, d, *columns: str) -> DataFrame:
    """The given columns of the structured rows of the rendered questions, from rules and entity slots."""
    from ..operators.understanding import assemble_intent
    return once(spark, d, "structured_" + "_".join(columns), lambda: assemble_intent(
        entity_questions(spark, d), fx.manufacturer_dim(spark, d), slot_table(spark, d)).select("query_id", *columns))


@registered("m13_slot_expectations", S.query("""
    SELECT r.record_id AS query_id, concat_ws(';', CASE WHEN contains(r.template, '{DRUG}') AND coalesce(v.drugs, 0) = 0 THEN 'missing_required_slot:drug' END,
      CASE WHEN NOT contains(r.template, '{BRAND}') AND coalesce(v.brands, 0) > 0 THEN 'unexpected_slot:brand' END, CASE WHEN coalesce(v.drugs, 0) < 1 THEN 'drug_count_below_min:0<1' END) AS failures
    FROM rendered r LEFT JOIN (SELECT query_id, least(6, count(*) FILTER (label = 'DRUG')) AS drugs, least(2, count(*) FILTER (label = 'BRAND')) AS brands FROM slot_ranked GROUP BY query_id) v ON v.query_id = r.record_id
    WHERE r.record_id NOT IN (SELECT record_id FROM collided)""", "rendered", "slot_ranked", "collided"))
def m13(spark, d):
    """Templates say which slots a question must and must not have."""
    none = F.array().cast("array<string>")
    checks = records(spark, d).join(records_base(spark, d).select("record_id", "template"), "record_id").select(
        F.col("record_id").alias("query_id"), F.when(F.contains("template", F.lit("{DRUG}")), F.array(F.lit("drug"))).otherwise(none).alias("must_have"),
        F.when(~F.contains("template", F.lit("{BRAND}")), F.array(F.lit("brand"))).otherwise(none).alias("must_not_have"), F.lit(1).alias("min_drug_count"))
    return mt.slot_expectations(structured_sample(spark, d, "slots"), checks).withColumn("failures", F.concat_ws(";", "failures"))


@registered("m14_sanity_rates", S.query(f"""
    SELECT 'query_non_empty' AS "check", 1.0::DOUBLE AS rate, least(1000, count(*)) AS evaluated, true AS passed FROM entity_texts WHERE query_id NOT IN (SELECT record_id FROM collided)
    UNION ALL SELECT 'nlem_filter_true', round(avg(CAST(hit AS DOUBLE)), 6), count(*), avg(CAST(hit AS DOUBLE)) >= 0.85 FROM (
      SELECT {S.found('lower(text)', lx.NLEM_PATTERNS)} AS hit FROM rendered WHERE "group" = 'nlem.verify' AND record_id NOT IN (SELECT record_id FROM collided) ORDER BY {S.digest('42', 'record_id')}, record_id LIMIT 1000)""", "entity_texts", "rendered", "collided"))
def m14(spark, d):
    groups = records(spark, d).select(F.col("record_id").alias("query_id"), (F.col("group") == "nlem.verify").alias("expect_nlem"))
    return mt.sanity_rates(structured_sample(spark, d, "query", "nlem_filter").join(groups, "query_id"))
