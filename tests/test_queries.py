"""Every query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    expected = duck.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    at = [expected.columns.index(c) for c in columns]
    got = sorted(tuple(repr(r[c]) for c in columns) for r in df.collect())
    assert got == sorted(tuple(repr(r[i]) for i in at) for r in expected.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["page_id", "url", "title", "visit_count", "ts_ms"] and df.count() > 0
