"""Sources, sinks, the stream of the log, and side outputs of the jobs."""

import json

from pyspark.sql import functions as F

from tessera.operators import metrics as mt, tagging as tg
from tessera.operators.intents import parse_label, stratified_split
from tessera.plans import fixtures
from tessera.session import stage_path
from tessera.sources import interactions as it, labelled
from tessera.streaming.interactions import append_stream, follow_interactions


def test_labelled_texts_from_json_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"ingredient_find": ["x", "y"], "nlem_check": ["z"]}), encoding="utf-8")
    rows = labelled.load_labelled_texts(spark, str(tmp_path)).collect()
    assert sorted((r["label"], r["text_no"], r["text"]) for r in rows) == [("nlem_check", 0, "z"), ("substance_find", 0, "x"), ("substance_find", 1, "y")]


def test_interaction_stream_appends_each_row_once(spark):
    source, sink, mark = (stage_path(spark, n) for n in ("log_in", "log_out", "log_mark"))
    rows = spark.createDataFrame([(f"i{k}", "t", "q", ["c"], "a", None) for k in range(5)], it.INTERACTION_SCHEMA)
    it.append_interactions(rows.limit(3), source)
    append_stream(follow_interactions(spark, source), sink, mark, once=True).awaitTermination()
    it.append_interactions(rows.where("id in ('i3', 'i4')"), source)
    append_stream(follow_interactions(spark, source), sink, mark, once=True).awaitTermination()
    ids = sorted(r["id"] for r in it.load_interactions(spark, sink).collect())
    assert len(ids) == len(set(ids)) == it.load_interactions(spark, source).count()


def test_iob_validation(spark):
    rows = spark.createDataFrame([(1, ["B-A", "I-A", "O"]), (2, ["I-A"]), (3, ["B-A", "I-B"]), (4, ["O", "B-B", "I-B"])], "record_id int, t array<string>")
    got = {r["record_id"]: r["v"] for r in rows.select("record_id", tg.valid_iob(F.col("t")).alias("v")).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True}


def test_alignment_drops_collisions_and_misses(spark):
    span = "array<struct<start:int,end:int,label:string>>"
    rows = spark.createDataFrame([
        (1, "take Aspirin 5 mg", [(5, 12, "DRUG"), (13, 17, "STRENGTH")]), (2, "ab", [(0, 1, "DRUG"), (1, 2, "BRAND")]), (3, "ab  cd", [(2, 4, "DRUG")])],
        f"record_id int, text string, spans {span}")
    kept, dropped = tg.bio_align(rows)
    row = kept.first()
    assert row["record_id"] == 1 and row["ner_tags"] == ["O", "B-DRUG", "B-STRENGTH", "I-STRENGTH"]
    assert {r["record_id"]: r["reason"] for r in dropped.collect()} == {2: "tag_collision", 3: "span_token_miss"}


def test_rounding_of_small_splits(spark):
    rows = spark.createDataFrame([(i, "a" if i < 15 else "b") for i in range(16)], "k int, label string")
    counts = {r["label"]: r["n"] for r in stratified_split(rows, "label", "k", 1).where("split = 'test'").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {"a": 5, "b": 1}


def test_answers_of_a_model(spark):
    rows = spark.createDataFrame([('{"intent": "b"}',), ('x {"intent": "a"} y',), ("maybe B then A",), ("none",), ('{"other": 1}',)], "t string")
    assert [r["v"] for r in rows.select(parse_label(F.col("t"), ["a_x", "b", "a"]).alias("v")).collect()] == ["b", "a", "b", "unknown", "unknown"]


def test_hits_grow_with_k_and_empty_sets_score_zero(spark):
    ranked = spark.createDataFrame([("q", f"i{r}", r) for r in range(1, 13)], "query_id string, tmtid string, rank int")
    gold = spark.createDataFrame([("q", "i4"), ("q", "i11"), ("q", "zz")], "query_id string, tmtid string")
    asked = spark.createDataFrame([("q",), ("none",)], "query_id string")
    rows = {r["query_id"]: r for r in mt.ranking_metrics(ranked, gold, asked).collect()}
    q = rows["q"]
    assert [q["hit@1"], q["hit@3"], q["hit@5"], q["hit@10"]] == [0, 0, 1, 1] and q["mrr"] == 0.25 and q["p@5"] == 0.2 and abs(q["r@5"] - 1 / 3) < 1e-9
    assert all(v == 0 for v in list(rows["none"].asDict().values())[1:])


def test_gate_fails_on_a_missing_metric(spark):
    measured = spark.createDataFrame([("p", "error_rate", 0.0)], "policy string, metric string, value double")
    gate = mt.acceptance_gate(measured)
    assert gate.where("passed").count() == 1 and gate.count() == 10
    assert mt.acceptance_verdict(gate).first()["passed"] is False


def test_ignored_positions_are_left_out(spark):
    rows = spark.createDataFrame([([-100, 1, -100, 2], ["a", "b", "c", "d"])], "labels array<int>, t array<string>")
    assert tg.drop_ignored(rows, "labels", "t").first()["t"] == ["b", "d"]


def test_node_ids_stay_apart_at_any_scale(spark, tmp_path):
    """Part keys beyond a million and supplier keys beyond a thousand give no id twice."""
    keys, makers = [1, 2, 1_000_000, 1_000_001, 250_000_000], [1, 999, 1000, 1001, 2001]
    frames = {
        "part": spark.createDataFrame([(k, f"new word{k} x", "B#1", "STEEL", k % 50) for k in keys], "p_partkey long, p_name string, p_brand string, p_type string, p_size int"),
        "supplier": spark.createDataFrame([(m, f"S{m}", 1) for m in makers], "s_suppkey long, s_name string, s_nationkey long"),
        "nation": spark.createDataFrame([(1, "N")], "n_nationkey long, n_name string"),
        "lineitem": spark.createDataFrame([(k, m, f) for k in keys for m in makers for f in "ANR"], "l_partkey long, l_suppkey long, l_returnflag string"),
        "embeddings": spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")}
    for name, df in frames.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    nodes = fixtures.build_nodes(spark, str(tmp_path))
    assert nodes.count() == nodes.select("node_id").distinct().count() and nodes.where("level = 'TPU'").count() == 75
