import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from evenkeel import session  # noqa: E402


DATA = "/root/testdata"


def order_rows(spark, rows, scale="sf0.001"):
    """The first orders of a driver table under short names, with ids from 1 and a time of day."""
    orders = spark.read.parquet(f"{DATA}/{scale}/orders.parquet").where(f"o_orderkey < {rows}")
    return orders.selectExpr(
        "o_orderkey + 1 AS id", "concat('order ', lpad(o_orderkey, 4, '0')) AS name", "round(o_totalprice / 1000, 2) AS amount",
        "o_orderpriority AS category", "o_orderstatus AS status",
        "CAST(o_orderdate AS timestamp) + make_dt_interval(0, 0, 0, o_orderkey * 977 % 86400) AS created_at",
    )


@pytest.fixture(scope="session")
def spark():
    settings = {
        "spark.master": "local[4]",
        "spark.sql.shuffle.partitions": "4",
        "spark.driver.memory": "4g",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="evenkeel-tests-"),
        "spark.ui.showConsoleProgress": "false",
    }
    s = session("tests", **settings)
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def frame(spark):
    """``frame("id long, name string", [(1, "a")])``"""

    def make(schema, rows):
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture(scope="session")
def column(spark):
    """One column: ``column("double", [1.0, None])``; with a key column ``id`` if asked for."""

    def make(kind, values, name="c", key=False):
        if key:
            return spark.createDataFrame([(i + 1, v) for i, v in enumerate(values)], f"id long, {name} {kind}")
        return spark.createDataFrame([(v,) for v in values], f"{name} {kind}")

    return make


def by_check(results):
    return {(r["check"], r["column"]): r for r in results.collect()}


def statuses(results):
    return {r["check"]: r["status"] for r in results.collect()}


def only(results):
    found = results.collect()
    assert len(found) == 1, found
    return found[0]
