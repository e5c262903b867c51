"""Every registered query against its SQL on the smallest driver tables."""

import os

import pytest

import __spark_entry__ as entry
import check_queries

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in check_queries.TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, DATA)
    if name not in entry.oracle_sql():
        assert df.count() > 0
        return
    found = db.sql(entry.oracle_sql()[name])
    assert check_queries.table(df.columns, df.collect()) == check_queries.table(found.columns, found.fetchall())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {"volume", "identity", "sum", "foreign_key"} <= {r["check"] for r in rows}
