"""Queries through a container's logs against their SQL where pages share a URL."""

import shutil

import duckdb
import pytest

import __spark_entry__ as entry
from tests.test_queries import ORACLES, SF, TABLES

QUERIES = [
    "dml_compact",
    "dml_compact_cascade",
    "dml_increment",
    "dml_increment_after_delete",
    "dml_insert",
    "dml_insert_over",
    "dml_insert_ttl",
    "dml_merge_level0",
    "dml_stats",
    "dml_wipe_domain",
    "mode_roundtrip",
]


@pytest.fixture(scope="module")
def shared(tmp_path_factory):
    """The smallest tables with every page twice, under two ids."""
    folder = tmp_path_factory.mktemp("shared-urls")
    for t in TABLES:
        if t != "pages":
            shutil.copy(f"{SF}/{t}.parquet", folder)
    pages = f"'{SF}/pages.parquet'"
    duckdb.sql(f"COPY (SELECT * FROM {pages} UNION ALL SELECT page_id + (SELECT max(page_id) + 1 FROM {pages}), url, html FROM {pages}) TO '{folder}/pages.parquet'")
    return folder


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, shared, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{shared}/{t}.parquet'")
    df, expected = entry.queries()[name](spark, str(shared)), con.sql(ORACLES[name])
    columns = sorted(df.columns)
    at = [expected.columns.index(c) for c in columns]
    assert sorted(tuple(repr(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(repr(r[i]) for i in at) for r in expected.fetchall())
