"""Target sides for the driver tables, derived by rules on keys that any SQL engine reproduces."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def orders_target(orders: DataFrame) -> DataFrame:
    """Lost rows, raised prices, a foreign status, cut and padded texts, nulls, orphans, shifted dates."""
    return orders.where("o_orderkey % 97 <> 0").selectExpr(
        "o_orderkey",
        "CASE WHEN o_orderkey % 37 = 0 THEN NULL WHEN o_orderkey % 43 = 0 THEN o_custkey + 10000000L ELSE o_custkey END AS o_custkey",
        "CASE WHEN o_orderkey % 41 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus",
        "CASE WHEN o_orderkey % 50 = 0 THEN o_totalprice + 100 ELSE o_totalprice END AS o_totalprice",
        "o_orderdate + INTERVAL '60' MINUTE AS o_orderdate",
        "CASE WHEN o_orderkey % 29 = 0 AND o_orderkey % 31 = 0 THEN left(concat('  ', o_orderpriority), 6)"
        " WHEN o_orderkey % 29 = 0 THEN left(o_orderpriority, 6)"
        " WHEN o_orderkey % 31 = 0 THEN concat('  ', o_orderpriority, '  ') ELSE o_orderpriority END AS o_orderpriority",
    )


def orders_repeated(orders: DataFrame) -> DataFrame:
    """The target with some rows twice, told apart by ``copy``, and dates as text with some bad ones."""
    df = orders_target(orders)
    df = df.withColumn("copy", F.lit(0)).unionByName(df.where("o_orderkey % 101 = 0").withColumn("copy", F.lit(1)))
    return df.selectExpr(
        "o_orderkey", "copy", "o_custkey", "o_orderstatus", "o_totalprice",
        "CASE WHEN o_orderkey % 53 = 0 THEN 'not-a-date' WHEN o_orderkey % 59 = 0 THEN ''"
        " ELSE date_format(o_orderdate, 'yyyy-MM-dd') END AS order_day",
    )


def lineitem_target(lineitem: DataFrame) -> DataFrame:
    """Discounts with one digit less, some quantities raised, a part of the orders without a parent."""
    return lineitem.selectExpr(
        "CASE WHEN l_orderkey % 43 = 0 THEN l_orderkey + 10000000 ELSE l_orderkey END AS l_orderkey",
        "l_linenumber",
        "CASE WHEN l_orderkey % 50 = 0 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity",
        "l_extendedprice", "round(l_discount, 1) AS l_discount", "l_returnflag", "l_shipdate",
    )


def documents_target(documents: DataFrame) -> DataFrame:
    """Damaged encoding, texts cut at 500 characters, outer blanks."""
    return documents.selectExpr(
        "doc_id",
        "CASE WHEN doc_id % 23 = 0 THEN concat('Ã©', text) WHEN doc_id % 19 = 0 THEN left(text, 500)"
        " WHEN doc_id % 17 = 0 THEN concat(text, '\\t') ELSE text END AS text",
        "lang", "source",
    )


def events_target(events: DataFrame) -> DataFrame:
    """Values as text with some that are no numbers, sentinels for missing users, event types renamed."""
    return events.selectExpr(
        "event_id",
        "CASE WHEN event_id % 29 = 0 THEN CAST(ts AS TIMESTAMP) + INTERVAL '7' MINUTE ELSE CAST(ts AS TIMESTAMP) END AS ts",
        "CASE WHEN event_id % 13 = 0 THEN -1 ELSE user_id END AS user_id",
        "CASE WHEN event_id % 7 = 0 THEN 'view' ELSE event_type END AS event_type",
        "CASE WHEN event_id % 47 = 0 THEN 'n/a' ELSE CAST(value AS STRING) END AS value",
    )


def labels_target(labels: DataFrame) -> DataFrame:
    """Flags as tokens; some flipped, some unknown."""
    return labels.selectExpr(
        "doc_id",
        "CASE WHEN doc_id % 11 = 0 THEN 'maybe' WHEN doc_id % 5 = 0 THEN ' no ' WHEN quality = 1 THEN 'Y' ELSE 'N' END AS quality",
        "CASE WHEN toxic = 1 THEN 'true' ELSE 'false' END AS toxic",
    )
