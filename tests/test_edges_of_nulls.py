"""Edges of line items without a part."""

from tessera.plans import fixtures


def test_units_of_no_part_are_one_edge(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(1, "blue ring", 3, "SMALL", "B#1")], "p_partkey bigint, p_name string, p_size int, p_type string, p_brand string").write.parquet(f"{d}/part.parquet")
    spark.createDataFrame([(None, 2, "A"), (None, 2, "N"), (1, None, "R"), (1, 2, "R"), (1, 2, "R")],
                          "l_partkey bigint, l_suppkey bigint, l_returnflag string").write.parquet(f"{d}/lineitem.parquet")
    rows = [(r.src_id, r.dst_id) for r in fixtures.build_edges(spark, d).where("type = 'HAS_GENERIC_UNIT'").collect()]
    assert sorted(rows, key=str) == [("1000001", "20000000000006"), (None, None)]
