"""Values that are named often are worked out once."""

from pyspark.sql import functions as F

from tessera.functions.text import let, ordered_distinct, with_once
from tessera.operators import entities as en, groundtruth as gt, retrieval as rv, tagging as tg, understanding as un
from tessera.sources.catalogue import Catalogue, links


def evaluations(df, name: str) -> int:
    """How often the optimized plan names a function."""
    return df._jdf.queryExecution().optimizedPlan().toString().count(name)


def test_let_and_ordered_distinct_name_their_value_once(spark):
    df = spark.createDataFrame([("b a B a",), (None,)], "t string")
    value = F.split(F.lower(F.reverse("t")), " ")
    out = df.select(ordered_distinct(value).alias("v"))
    assert evaluations(out, "reverse(") == 1
    assert [r[0] for r in out.collect()] == [["a", "b"], None]
    assert df.select(let(F.length("t"), lambda n: n + n).alias("v")).collect()[0][0] == 14


def test_a_filter_on_a_column_worked_out_once_copies_nothing(spark):
    df = spark.createDataFrame([("abc",), ("",)], "t string")
    out = with_once(df, F.struct(F.reverse("t").alias("r"), F.length("t").alias("n"))).where("r <> ''").where("n > 1")
    assert evaluations(out, "reverse(") == 1
    assert [tuple(r) for r in out.collect()] == [("abc", "cba", 3)]


def test_a_draw_is_made_once_and_not_per_template(spark):
    drawn = tg.sample_templates(spark.range(50).withColumnRenamed("id", "record_id"))
    plan = drawn.select("record_id", "template_id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1 and "transform(array(" in plan.split("md5(")[0], "the draw is bound outside the filter of bounds"
    bounds = sorted((r.lo, r.template_id) for r in tg.templates(spark).collect())
    draws = {r.record_id: r.u for r in spark.range(50).withColumnRenamed("id", "record_id").select("record_id", tg.uniform("42|template", "record_id").alias("u")).collect()}
    assert {r.record_id: r.template_id for r in drawn.collect()} == {k: max(b for b in bounds if b[0] <= u)[1] for k, u in draws.items()}


def test_alignment_splits_a_text_once(spark):
    rows = [(1, "give aspirin 5 mg now", [(5, 12, "DRUG"), (13, 17, "STRENGTH")]), (2, "", []), (3, "ab cd", [(2, 3, "FORM")]),
            (4, "a bc", [(2, 3, "DRUG"), (3, 4, "FORM")])]
    df = spark.createDataFrame(rows, "record_id long, text string, spans array<struct<start:int,end:int,label:string>>")
    kept, dropped = tg.bio_align(df)
    assert evaluations(kept, "regexp_extract_all(") == 1
    assert [(r.record_id, r.tokens, r.ner_tags) for r in kept.collect()] == [
        (1, ["give", "aspirin", "5", "mg", "now"], ["O", "B-DRUG", "B-STRENGTH", "I-STRENGTH", "O"])]
    assert sorted(tuple(r) for r in dropped.collect()) == [(2, "tokenization_empty"), (3, "span_token_miss"), (4, "tag_collision")]


def test_runs_read_each_label_once(spark):
    tags = [("B-DRUG", 0, 4, 0.9), ("I-DRUG", 5, 9, 0.7), ("I-FORM", 10, 12, 0.8), ("O", 13, 14, 0.9), ("I-FORM", 15, 17, 0.4), (None, 18, 19, 0.9), ("B-FORM", 20, 22, None)]
    df = spark.createDataFrame([(tags,)], "tags array<struct<label:string,start:int,end:int,confidence:double>>")
    out = df.select(en.label_runs(F.col("tags"), 0.5).alias("r"))
    assert "rlike" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert [(r.label, r.start, r.end, r.confidence) for r in out.collect()[0][0]] == [("DRUG", 0, 9, 0.8), ("FORM", 10, 12, 0.8), ("FORM", 20, 22, None)]


def test_a_search_term_tries_candidates_only_as_far_as_needed(spark):
    rows = [(1, "drug information about aspirin", None, None, ["Aspirin"], []), (2, "drug information about aspirin", None, None, [], []),
            (3, "zzz 12 mg qqq", None, None, [], []), (4, "what is tmtid 123456", "123456", None, ["x"], []), (5, "", None, None, [], [])]
    df = spark.createDataFrame(rows, "query_id long, question string, id_lookup string, manufacturer_filter string, brands array<string>, drugs array<string>")
    out = un.build_search_term(df)
    plan = out._jdf.queryExecution().optimizedPlan()
    assert plan.toString().count("Project") == 1, "candidates are not columns that every row works out"
    assert {r.query_id: r.query for r in out.collect()} == {1: "Aspirin", 2: "aspirin", 3: "zzz 12 mg", 4: "123456", 5: ""}


def test_sets_list_only_what_is_asked_of_the_picked(spark):
    nodes = spark.createDataFrame(
        [(f"s{i}", f"s{i}", "SUBS", f"Sub {i}") for i in range(3)] + [(f"v{i}", f"v{i}", "VTM", "v") for i in range(3)]
        + [(f"g{i}", f"g{i}", "GP", "g") for i in range(3)] + [(f"t{i}", f"t{i}", "TP", "t") for i in range(3)], "node_id string, tmtid string, level string, name string")
    edges = spark.createDataFrame([x for i in range(3) for x in ((f"s{i}", f"v{i}", "IS_ACTIVE_SUBSTANCE_OF"), (f"g{i}", f"v{i}", "HAS_VTM"),
                                   (f"g{i}", f"t{i}", "HAS_TRADE_PRODUCT"))], "src_id string, dst_id string, type string")
    whole = {r.anchor.subs_tmtid: r for r in gt.substance_sets(nodes, edges, 1, n=2).collect()}
    assert len(whole) == 2 and all(r.gold.tp == [f"t{k[1:]}"] and r.gold.tpu == [] and r.counts.tp == 1 for k, r in whole.items())
    sets = gt.substance_sets(nodes, edges, 1, n=2, listed=["GP"])
    assert {r.anchor.subs_tmtid: (r.counts.tp, r.set_no, r.gold.asDict()) for r in sets.collect()} == {
        k: (1, r.set_no, {"gp": [f"g{k[1:]}"]}) for k, r in whole.items()}
    assert "Window" not in gt.substance_sets(nodes, edges, 1, n=2)._jdf.queryExecution().optimizedPlan().toString(), "no row with a list is sorted"


def test_context_shuffles_only_links_and_edges_that_can_join(spark, monkeypatch):
    nodes = spark.createDataFrame([(f"n{i}", f"n{i}", "GP", f"name {i}") for i in range(4)], "node_id string, tmtid string, level string, name string").selectExpr(
        "*", "cast(null as string) as fsn", "cast(null as string) as trade_name")
    edges = spark.createDataFrame([(f"n{i}|E|n{i + 1}", f"n{i}", f"n{i + 1}", "E") for i in range(3)], "edge_id string, src_id string, dst_id string, type string")
    cat = Catalogue(nodes, edges, None, None, links(edges), None, 4, 1.0)
    plans, store = {}, rv.materialise
    monkeypatch.setattr(rv, "materialise", lambda df, name, **o: (plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString()), store(df, name, **o))[1])
    found = rv.expand_context(spark.createDataFrame([("q", "n0", 1)], "query_id string, node_id string, rank int"), cat, 2)
    assert {(r.node_id, r.is_seed) for r in found.nodes.collect()} == {("n0", True), ("n1", False), ("n2", False)}
    assert {(r.start_id, r.end_id, r.start_name) for r in found.relationships.collect()} == {("n0", "n1", "name 0"), ("n1", "n2", "name 1")}
    assert all("getbit" in plans[name] for name in ("walked_1", "paths", "used_edges"))
