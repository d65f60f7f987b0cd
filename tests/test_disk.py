"""Steps that once sorted or shuffled far more than they keep."""

import random

from pyspark.sql import functions as F

from tessera.functions.matching import FEW_TERMS, contains_join
from tessera.functions.members import keep_members, likely_members
from tessera.functions import ranking
from tessera.functions.ranking import count_and_ends, top_k, top_k_by_text
from tessera.functions.text import index_tokens
from tessera.operators.retrieval import nearest_ends
from tessera.plans import fixtures as fx
from tessera.schema import INDEX_COLUMNS, NODE_SCHEMA
from tessera.session import materialise, shuffles_dropped
from tessera.sources.catalogue import index_documents, store_catalogue


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_count_and_ends_sorts_groups_and_not_rows(spark):
    rows = [("a", "x", "10"), ("a", "x", "9"), ("a", None, None), ("a", "x", None), ("b", "é", "zé"), ("b", "é", "z")]
    found = count_and_ends(spark.createDataFrame(rows, "k string, l string, v string"), ["k", "l"], "v")
    above, below = plan_of(found).split("MapInArrow")
    assert "Sort [" in above and "Sort [" not in below
    assert {tuple(r) for r in found.collect()} == {("a", "x", 3, "10", "9"), ("a", None, 1, None, None), ("b", "é", 2, "z", "zé")}


def test_writes_by_partition_do_not_sort(spark):
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    with shuffles_dropped(spark):
        assert int(spark.conf.get(key)) >= 8
    assert spark.conf.get(key) == before


def test_few_and_many_terms_find_the_same(spark):
    rng = random.Random(6)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(1, 6))) for _ in range(3 * FEW_TERMS)})
    assert len(words) > FEW_TERMS
    texts = [(f"t{i}", " ".join(rng.sample(words, 4))) for i in range(150)] + [("empty", ""), ("none", None), (None, "abcd")]
    d = spark.createDataFrame(texts, "node_id string, hay string")
    for terms in (words, words[:3]):
        found = contains_join(spark.createDataFrame([(x,) for x in terms], "term string"), d).collect()
        want = sorted((i, x) for i, s in texts for x in terms if i and s and x in s)
        assert sorted((r["node_id"], r["term"]) for r in found) == want


def test_likely_members_leaves_out_most_others(spark):
    rows = spark.range(5000).withColumn("id", F.col("id").cast("string"))
    members = rows.where("id % 500 = 0")
    likely = {r[0] for r in likely_members(rows, "id", members).collect()}
    kept = {r[0] for r in keep_members(rows, "id", members).collect()}
    assert kept == {str(i) for i in range(0, 5000, 500)} and kept <= likely and len(likely) < 100


def test_members_are_looked_up_before_rows_are_shuffled(spark):
    rows = spark.range(5000).withColumn("id", F.col("id").cast("string"))
    members = rows.where("id % 500 = 0")
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        kept = keep_members(rows, "id", members.unionAll(members))
        plan = plan_of(kept)
        assert sorted(r[0] for r in kept.collect()) == sorted(str(i) for i in range(0, 5000, 500))
    finally:
        spark.conf.set(key, before)
    # The map's join stands below the exact one, so that only likely members are shuffled.
    assert 0 <= plan.find("SortMergeJoin") < plan.find("BroadcastHashJoin")


def test_documents_are_the_words_of_the_index(spark):
    texts = ["Brand#11 (NATION_3) 28 mg", "", None, "  ยา é-x ", "--"]
    nodes = spark.createDataFrame([(f"n{i}", t) for i, t in enumerate(texts)], "node_id string, fsn string")
    nodes = nodes.select(*[(F.col(f.name) if f.name in nodes.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in NODE_SCHEMA.fields])
    words = {r[0]: r[1] for r in nodes.select("node_id", index_tokens(F.concat_ws(" ", *INDEX_COLUMNS))).collect()}
    for r in index_documents(nodes).collect():
        assert (r["doc"], r["doc_len"]) == (" " + " ".join(words[r["node_id"]]) + " ", len(words[r["node_id"]]))


def test_a_walk_sends_on_only_links_of_the_nodes_it_stands_on(spark):
    nodes = spark.createDataFrame([(f"n{i}", f"n{i}", "TP") for i in range(40)], "node_id string, tmtid string, level string")
    nodes = nodes.select(*[(F.col(f.name) if f.name in nodes.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in NODE_SCHEMA.fields])
    edges = spark.createDataFrame([(f"e{i}", f"n{i}", f"n{i + 1}", "HAS_VTM") for i in range(39)], "edge_id string, src_id string, dst_id string, type string")
    asked = spark.createDataFrame([("q", 2, 10, None, None, None, None, None)], "query_id string, hops int, k int, levels array<string>, f_nlem boolean, f_nlem_category string, f_manufacturer string, f_tmtid string")
    starts = materialise(spark.createDataFrame([("q", "n5")], "query_id string, node_id string"), "starts")
    ends = nearest_ends(asked, starts, store_catalogue(nodes, edges), 2)
    assert {(r["node_id"], r["hop"]) for r in ends.collect()} == {("n5", 0), ("n4", 1), ("n6", 1), ("n3", 2), ("n7", 2)}


def test_rows_are_cut_to_length_where_they_are_read(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", "é", None]), rng.choice(["x", "X", "é", "zé", None, ""]) , f"n{i}") for i in range(4000)] + [(f"k{i}", "x", f"n{i}") for i in range(500)]
    d = spark.createDataFrame(rows, "query_id string, shown string, node_id string").repartition(3)
    want = sorted(map(repr, top_k(d, ["query_id"], [F.col("shown"), F.col("node_id")], 5).collect()))
    assert sorted(map(repr, top_k_by_text(d, "query_id", ["shown", "node_id"], 5).collect())) == want
    assert top_k_by_text(d.where("false"), "query_id", ["shown", "node_id"], 5).collect() == []
    above, below = plan_of(top_k_by_text(d, "query_id", ["shown", "node_id"], 5)).split("MapInArrow")
    assert "Sort [" in above and "Sort [" not in below
    monkeypatch.setattr(ranking, "TRIM_ROWS", 100)
    assert sorted(map(repr, top_k_by_text(d, "query_id", ["shown", "node_id"], 5).collect())) == want


def given_tables(spark, folder):
    tables = {
        "part": ([(1, "red iron", "B1", "TAB", 3), (2, "blue zinc", "B2", "CAP", 4), (2, "blue zinc", "B2", "CAP", 4)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int"),
        "supplier": ([(1, "S1", 0), (2, "S2", 1)], "s_suppkey long, s_name string, s_nationkey int"),
        "nation": ([(0, "NATION_0"), (1, "NATION_1")], "n_nationkey int, n_name string"),
        "embeddings": ([(1, [0.5, 0.5])], "vec_id long, embedding array<float>"),
        "lineitem": ([(1, 1, "A"), (1, 1, "A"), (1, 1, "N"), (1, 2, "R"), (1, 2, None), (2, 1, "N"), (2, 9, "N"), (7, 1, "A"), (None, 1, "A"), (None, 2, "A"), (1, None, "A"), (1, None, "N"), (None, None, None)],
                     "l_partkey long, l_suppkey long, l_returnflag string")}
    for name, (rows, kinds) in tables.items():
        spark.createDataFrame(rows, kinds).write.parquet(f"{folder}/{name}.parquet")


def test_products_and_units_come_from_one_join(spark, tmp_path):
    d = str(tmp_path)
    given_tables(spark, d)
    facts = [tuple(r) for r in fx.facts(spark, d).select("l_partkey", "l_suppkey").where("first").collect()]
    pairs = {(1, 1), (1, 2), (2, 1), (2, 9), (7, 1), (None, 1), (None, 2), (1, None), (None, None)}
    assert len(facts) == len(pairs) and set(facts) == pairs
    nodes = fx.build_nodes(spark, d)
    found = sorted((r["level"], r["tmtid"], r["fsn"]) for r in nodes.where("level in ('TP', 'TPU')").collect())
    name = {1: "B1 red iron (S{}, NATION_{}) (iron 3 mg)", 2: "B2 blue zinc (S{}, NATION_{}) (zinc 4 mg)"}
    want = []
    for p, s, flags in ((1, 1, "AN"), (1, 2, ("R", None)), (2, 1, "N"), (2, 1, "N")):  # part 2 comes twice
        pair, fsn = p * 10**9 + s, name[p].format(s, s - 1)
        want.append(("TP", str(pair + 3 * 10**18), fsn))
        want += [("TPU", str(pair * 4 + {"A": 0, "N": 1}.get(f, 2) + 4 * 10**18), f"{fsn} {f}" if f else fsn) for f in flags]
    assert found == sorted(want)
    edges = [(r["src_id"], r["dst_id"]) for r in fx.build_edges(spark, d).where("type = 'HAS_TRADE_PRODUCT'").collect()]
    gp, tp = lambda p: p and str(p + 10**6), lambda p, s: str(p * 10**9 + s + 3 * 10**18) if p and s else None
    made = {(gp(p), tp(p, s)) for p, s in pairs}
    assert len(edges) == len(made) and set(edges) == made


def test_a_node_id_is_stored_where_it_is_not_the_tmtid(spark):
    rows = [("n1", "n1", "TP"), (" n2", " n2", "TP"), (None, "n3", "GP"), ("n4", None, None), ("x", "n5", "TP")]
    nodes = spark.createDataFrame(rows, "node_id string, tmtid string, level string")
    nodes = nodes.select(*[(F.col(f.name) if f.name in nodes.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in NODE_SCHEMA.fields])
    kept = store_catalogue(nodes, spark.createDataFrame([], "edge_id string, src_id string, dst_id string, type string")).nodes
    assert {(r["node_id"], r["level"]) for r in kept.collect()} == {(r[0], r[2]) for r in rows} and kept.schema.names == NODE_SCHEMA.names
    stored = kept.sparkSession.read.parquet(kept.inputFiles()[0].rpartition("/level=")[0])
    assert "node_id" not in stored.columns and {r[0] for r in stored.where("own_id is not null").select("own_id.node_id").collect()} == {" n2", None, "n4", "x"}
