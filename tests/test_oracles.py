"""Every registered query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return value if isinstance(value, bool) else str(value)
    return round(float(value), 5)


def rows_of(names, rows, cols):
    at = [names.index(c) for c in cols]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(registry.ORACLES) == set(registry.QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    cursor = duck.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    want = cursor.fetchall()
    assert sorted(names) == sorted(df.columns)
    cols = sorted(names)
    assert rows_of(df.columns, got, cols) == rows_of(names, want, cols)
    assert got, "a registered query must find something on the fixture"
