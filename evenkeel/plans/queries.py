"""The registered queries: every operator over the driver tables and their derived targets.

Each takes ``(spark, sf_dir)`` and returns flat rows, so that they can be compared with plain SQL
(:mod:`evenkeel.plans.oracle`) value by value.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel import results as R
from evenkeel.config import AuditConfig, TableConfig
from evenkeel.functions import masking
from evenkeel.functions.values import looks_like_key
from evenkeel.operators import aggregates, constraints, datetimes, faults, frequency, keys, mapping, quarantine
from evenkeel.operators import rollup, samples, sketch, strings, volume
from evenkeel.operators.suggest import suggest_config
from evenkeel.plans import targets as X
from evenkeel.plans.evidence import failing_values
from evenkeel.plans.job import run_audit
from evenkeel.plans.pair_audit import Settings, audit_pair
from evenkeel.sources.read import read_csv, rename
from evenkeel.sources.write import ci_report, content_hash, write_quarantine, write_report
from evenkeel.staging import staging_dir
from evenkeel.streaming.incremental import IncrementalAudit

Query = Callable[[SparkSession, str], DataFrame]

STATUSES = ("F", "O", "P")
STATUS_NAMES = {"F": "FINAL", "O": "OPEN", "P": "PART"}


def _orders(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    source = X.table(spark, sf, "orders")
    return source, X.orders_target(source)


def _pair(spark: SparkSession, sf: str, name: str) -> tuple[DataFrame, DataFrame]:
    source = X.table(spark, sf, name)
    return source, getattr(X, f"{name}_target")(source)


# --- volume, identity, schema ------------------------------------------------------------------


def volume_1to1(spark, sf):
    s, t = _orders(spark, sf)
    return R.flat(volume.check_volume(s, t, "orders", 0.1), ["src_rows", "tgt_rows", "difference"], ["loss_pct"])


def volume_ratio(spark, sf):
    s, t = X.table(spark, sf, "orders"), X.table(spark, sf, "lineitem")
    found = volume.check_volume(s, t, "orders_lineitem", 1.0, "1:N", 3.99)
    return R.flat(found, ["src_rows", "tgt_rows", "expected_rows", "difference"], ["loss_pct"])


def identity_overlap(spark, sf):
    s, t = _orders(spark, sf)
    counts = ["common_keys", "src_keys", "tgt_keys", "src_null_keys", "tgt_null_keys"]
    return R.flat(keys.check_identity(s, t, "o_orderkey", "orders"), counts, ["overlap_pct"])


def identity_null_keys(spark, sf):
    s, t = _orders(spark, sf)
    counts = ["common_keys", "src_keys", "tgt_keys", "src_null_keys", "tgt_null_keys"]
    return R.flat(keys.check_identity(s, t, "o_custkey", "orders"), counts, ["overlap_pct"])


def identity_wide_numbers(spark, sf):
    """BIGINT keys above 2^53 against DOUBLE keys: only those that a double holds exactly are found."""
    orders = X.table(spark, sf, "orders").selectExpr("9007199254740992L + o_orderkey AS k")
    counts = ["common_keys", "src_keys", "tgt_keys"]
    return R.flat(keys.check_identity(orders, orders.selectExpr("CAST(k AS DOUBLE) AS k"), "k", "orders"), counts)


def missing_keys(spark, sf):
    s, t = _orders(spark, sf)
    return keys.missing_keys(s, t, "o_custkey")


def approximate_identity(spark, sf):
    s, t = _orders(spark, sf)
    both = sketch.approximate_overlap(sketch.key_sketch(s, "o_custkey"), sketch.key_sketch(t, "o_custkey"))
    return both.selectExpr("src_keys", "tgt_keys", "common_keys", "round(overlap_pct, 4) AS overlap_pct")


def schema_diff(spark, sf):
    """A target that lacks a column and has one too many, audited in strict mode."""
    s = X.table(spark, sf, "orders")
    t = X.orders_target(s).drop("o_orderpriority").withColumn("o_year", F.year("o_orderdate"))
    table = TableConfig(primary_key="o_orderkey")
    return R.flat(audit_pair(s, t, table, "orders", Settings(strict_schema=True)))


# --- aggregates ----------------------------------------------------------------------------------


def _aggregate(kind: str, digits: int = 2) -> Query:
    def run(spark, sf):
        s, t = _orders(spark, sf)
        found = aggregates.check_aggregate(s, t, "o_totalprice", "orders", 1.0, (kind,))
        return found.selectExpr(
            "table_name", "check", "column", "status",
            f"round(metrics['src_value'], {digits}) AS src_value", f"round(metrics['tgt_value'], {digits}) AS tgt_value",
            "round(metrics['pct_difference'], 4) AS pct_difference",
        )

    return run


def agg_all(spark, sf):
    s, t = _pair(spark, sf, "lineitem")
    found = aggregates.check_aggregates(s, t, ["l_quantity", "l_extendedprice", "l_discount"], "lineitem", 1.0)
    return R.flat(found, numbers=["pct_difference"])


def agg_all_null(spark, sf):
    s, t = _orders(spark, sf)
    nothing = t.withColumn("o_totalprice", F.lit(None).cast("double"))
    return R.flat(aggregates.check_aggregate(s, nothing, "o_totalprice", "orders", 1.0))


def agg_column_mapping(spark, sf):
    s, t = _orders(spark, sf)
    t = rename(t, {"o_totalprice": "total_price"})
    table = TableConfig(
        primary_key="o_orderkey", aggregates=("total_price",),
        aggregate_column_mapping={"o_totalprice": "total_price"},
    )
    found = audit_pair(s, t, table, "orders").where("category = 'aggregates'")
    return R.flat(found, numbers=["pct_difference"])


def junk_numeric(spark, sf):
    _, t = _pair(spark, sf, "events")
    found = aggregates.check_junk(t, "value", "events")
    return R.flat(found, ["junk_rows"])


def numeric_precision(spark, sf):
    s, t = _pair(spark, sf, "lineitem")
    found = R.union(
        spark,
        [
            aggregates.check_numeric_precision(s, t, "l_discount", "lineitem"),
            aggregates.check_numeric_precision(s, t, "l_extendedprice", "lineitem", 8, 2),
        ],
    )
    return R.flat(found, ["src_max_scale", "tgt_max_scale", "src_max_precision", "tgt_max_precision"])


def tiny_digits(spark, sf):
    """Digits far behind the point: 15 x 10^-(key mod 25) against zeros."""
    orders = X.table(spark, sf, "orders")
    small = orders.selectExpr("CAST(concat('15E-', o_orderkey % 25) AS DOUBLE) AS x")
    found = aggregates.check_numeric_precision(small, orders.selectExpr("0D AS x"), "x", "orders")
    return R.flat(found, ["src_max_scale", "tgt_max_scale"])


def agg_presence(spark, sf):
    """Aggregates of columns that a side lacks, and of one that holds junk."""
    s, t = _orders(spark, sf)
    s = s.withColumnRenamed("o_custkey", "old_key")
    t = t.withColumn("o_totalprice", F.expr("IF(o_orderkey % 7 = 0, 'junk', CAST(o_totalprice AS STRING))")).drop("o_orderpriority")
    table = TableConfig(primary_key="o_orderkey", aggregates=("o_totalprice", "o_custkey", "o_orderpriority"))
    found = audit_pair(s, t, table, "orders")
    return R.flat(found.where("check IN ('column_presence', 'junk_values')"), ["junk_rows"])


def id_columns(spark, sf):
    """Which columns of all tables count as keys and so are left out of drift checks."""
    rows = [
        (name, f.name, looks_like_key(f.name)) for name in ("documents", "embeddings", "events", "orders", "customer")
        for f in X.table(spark, sf, name).schema
    ]
    return spark.createDataFrame(rows, "table_name string, column string, is_key boolean")


# --- values ----------------------------------------------------------------------------------------


def allowed_values(spark, sf):
    _, orders = _orders(spark, sf)
    _, events = _pair(spark, sf, "events")
    found = R.union(
        spark,
        [
            constraints.check_allowed_values(orders, ["o_orderstatus", "o_custkey"], [*STATUSES, "1", "2"], "orders"),
            constraints.check_allowed_values(events, ["event_type"], ["click", "error", "purchase", "signup", "view"], "events"),
        ],
    )
    return R.flat(found, ["invalid_rows"])


def invalid_values(spark, sf):
    _, t = _orders(spark, sf)
    return constraints.invalid_values(t, ["o_orderstatus", "o_orderpriority"], [*STATUSES, "1-URGENT", "2-HIGH"])


def fk_orphans(spark, sf):
    _, orders = _orders(spark, sf)
    _, lineitem = _pair(spark, sf, "lineitem")
    found = R.union(
        spark,
        [
            keys.check_links(orders, X.table(spark, sf, "customer"), "o_custkey", "c_custkey", "orders"),
            keys.check_links(lineitem, X.table(spark, sf, "orders"), "l_orderkey", "o_orderkey", "lineitem"),
        ],
    )
    return R.flat(found, ["orphaned_count", "orphaned_keys", "null_count", "child_rows"])


def orphan_keys(spark, sf):
    _, lineitem = _pair(spark, sf, "lineitem")
    return keys.orphan_keys(lineitem, X.table(spark, sf, "orders"), "l_orderkey", "o_orderkey")


def orphan_rows(spark, sf):
    _, orders = _orders(spark, sf)
    bad = mapping.orphan_rows(orders, X.table(spark, sf, "customer"), "o_custkey", "c_custkey")
    return bad.select("o_orderkey", "o_custkey")


def null_sentinel(spark, sf):
    s, t = _orders(spark, sf)
    es, et = _pair(spark, sf, "events")
    found = R.union(
        spark,
        [
            constraints.check_null_sentinel_equivalence(s, t, "o_custkey", "orders", [0, -1, "N/A"]),
            constraints.check_null_sentinel_equivalence(es, et, "user_id", "events", [-1, "", "N/A"]),
            constraints.check_null_sentinel_equivalence(s, t, "o_orderstatus", "orders", ["X", "?"]),
        ],
    )
    counts = ["src_sentinel_substitutions", "tgt_sentinel_substitutions"]
    rates = ["src_null_rate_before", "tgt_null_rate_before", "src_null_rate_after", "tgt_null_rate_after"]
    return R.flat(found, counts, rates)


def constraint_not_null(spark, sf):
    _, t = _orders(spark, sf)
    rules = {"o_custkey": ["not_null"], "o_totalprice": ["not_null"]}
    return R.flat(constraints.check_data_constraints(t, rules, "orders"), ["rows", "not_null_violations"])


def constraint_date(spark, sf):
    t = X.orders_repeated(X.table(spark, sf, "orders"))
    return R.flat(constraints.check_data_constraints(t, {"order_day": ["date"]}, "orders"), ["rows", "date_violations"])


def constraint_positive(spark, sf):
    _, t = _orders(spark, sf)
    t = faults.negate(t, "o_totalprice", "o_orderkey", 61)
    rules = {"o_totalprice": "positive", "o_custkey": ["positive"]}
    return R.flat(constraints.check_data_constraints(t, rules, "orders"), ["rows", "positive_violations"])


def constraint_between(spark, sf):
    _, t = _pair(spark, sf, "lineitem")
    rules = {"l_quantity": ["between_1_50"], "l_discount": ["between_0_0.05"]}
    found = constraints.check_data_constraints(t, rules, "lineitem")
    broken = "coalesce(metrics['between_1_50_violations'], metrics['between_0_0.05_violations'])"
    return found.selectExpr(
        "table_name", "check", "column", "status", "CAST(metrics['rows'] AS BIGINT) AS rows",
        f"CAST({broken} AS BIGINT) AS violations",
    )


def uniqueness(spark, sf):
    s = X.table(spark, sf, "orders")
    t = X.orders_repeated(s)
    found = R.union(spark, [keys.check_uniqueness(s, t, c, "orders") for c in ("o_orderkey", "o_custkey")])
    return R.flat(found, ["src_unique_count", "tgt_unique_count"], ["src_unique_ratio", "tgt_unique_ratio"])


# --- texts ---------------------------------------------------------------------------------------------


def string_truncation(spark, sf):
    s, t = _orders(spark, sf)
    ds, dt = _pair(spark, sf, "documents")
    found = R.union(
        spark,
        [
            frequency.check_string_truncation(s, t, "o_orderpriority", "orders", 10),
            frequency.check_string_truncation(s, t, "o_orderpriority", "orders"),
            frequency.check_string_truncation(ds, dt.withColumn("text", F.left("text", F.lit(2000))), "text", "documents"),
        ],
    )
    return R.flat(found, ["src_max_length", "tgt_max_length", "effective_limit", "rows_exceeding_limit", "src_values"])


def whitespace(spark, sf):
    s, t = _orders(spark, sf)
    ds, dt = _pair(spark, sf, "documents")
    found = R.union(
        spark,
        [
            strings.check_whitespace_corruption(s, t, "o_orderpriority", "orders"),
            strings.check_whitespace_corruption(ds, dt, "text", "documents"),
        ],
    )
    return R.flat(found, ["src_unstripped_count", "tgt_unstripped_count"], ["src_unstripped_pct", "tgt_unstripped_pct"])


def encoding(spark, sf):
    s, t = _pair(spark, sf, "documents")
    found = R.union(
        spark,
        [
            strings.check_encoding_corruption(s, t, "text", "documents"),
            strings.check_encoding_corruption(t, s, "text", "documents_reversed"),
        ],
    )
    return R.flat(found, ["src_corrupt_count", "tgt_corrupt_count"])


def enum_raw(spark, sf):
    s, t = _orders(spark, sf)
    ds, dt = _pair(spark, sf, "documents")
    found = R.union(
        spark,
        [
            frequency.check_enum_equivalence(s, t, "o_orderstatus", "orders"),
            frequency.check_enum_equivalence(ds, dt, "lang", "documents"),
        ],
    )
    counts = ["src_distinct", "tgt_distinct", "src_only_values", "src_only_rows", "tgt_only_values", "tgt_only_rows"]
    return R.flat(found, counts)


def enum_mapped(spark, sf):
    s, t = _orders(spark, sf)
    named = t.withColumn(
        "o_orderstatus", F.expr("CASE o_orderstatus WHEN 'F' THEN 'FINAL' WHEN 'O' THEN 'OPEN' ELSE 'OTHER' END")
    )
    found = frequency.check_enum_equivalence(s, named, "o_orderstatus", "orders", {"F": "FINAL", "O": "OPEN", "X": "LOST"})
    counts = ["src_only_values", "src_only_rows", "tgt_only_values", "tgt_only_rows", "expected_missing"]
    return R.flat(found, counts)


def distribution_shift(spark, sf):
    s, t = _pair(spark, sf, "events")
    os_, ot = _orders(spark, sf)
    found = R.union(
        spark,
        [
            frequency.check_categorical_distribution(s, t, "event_type", "events", 0.05),
            frequency.check_categorical_distribution(os_, ot, "o_orderstatus", "orders", 0.05),
        ],
    )
    return R.flat(found, numbers=["max_shift"], texts=["max_shift_value"])


def value_counts(spark, sf):
    s, t = _orders(spark, sf)
    return frequency.value_counts(s, t, "o_orderpriority").selectExpr(
        "value", "src_n", "tgt_n", "round(src_share, 6) AS src_share", "round(tgt_share, 6) AS tgt_share"
    )


def value_differences(spark, sf):
    s, t = _orders(spark, sf)
    return frequency.value_differences(s, t, "o_orderpriority")


def boolean_ratio(spark, sf):
    s, t = _pair(spark, sf, "labels")
    found = R.union(
        spark, [strings.check_boolean_normalization(s, t, c, "labels") for c in ("quality", "toxic")]
    )
    return R.flat(found, ["src_unmapped", "tgt_unmapped"], ["src_true_share", "tgt_true_share", "share_gap"])


# --- timestamps ----------------------------------------------------------------------------------------


def datetime_parse(spark, sf):
    s = X.table(spark, sf, "orders").selectExpr("o_orderkey", "date_format(o_orderdate, 'yyyy-MM-dd') AS order_day")
    t = X.orders_repeated(X.table(spark, sf, "orders"))
    found = datetimes.check_timezone_consistency(s, t, "order_day", "orders").where("check = 'datetime_parse'")
    return R.flat(found, ["src_parse_failures", "tgt_parse_failures"])


def tz_awareness(spark, sf):
    s, t = _orders(spark, sf)
    es, et = _pair(spark, sf, "events")
    text = "date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss')"
    s2 = s.selectExpr(f"concat({text}, '+00:00') AS stamp")
    t2 = t.selectExpr(f"concat({text}, CASE WHEN o_orderkey % 71 = 0 THEN '+02:00' ELSE 'Z' END) AS stamp")
    checks = [
        datetimes.check_timezone_consistency(s, t, "o_orderdate", "orders"),
        datetimes.check_timezone_consistency(s, t, "o_orderdate", "orders_utc", expected_tz="UTC"),
        datetimes.check_timezone_consistency(es, et, "ts", "events"),
        datetimes.check_timezone_consistency(s2, t2, "stamp", "orders_text"),
        datetimes.check_timezone_consistency(s2, s2, "stamp", "orders_text_utc", expected_tz="UTC"),
    ]
    found = R.union(spark, checks).where("check = 'tz_awareness'")
    return R.flat(found, ["src_naive", "tgt_naive"], texts=["src_tz", "tgt_tz"])


_OFFSET = ["median_delta_minutes", "median_delta_hours", "std_delta_minutes"]


def tz_offset(spark, sf):
    s, t = _orders(spark, sf)
    es, et = _pair(spark, sf, "events")
    found = R.union(
        spark,
        [
            datetimes.check_tz_offset(s, t, ["o_orderdate"], "o_orderkey", "orders"),
            datetimes.check_tz_offset(es, et, ["ts"], "event_id", "events"),
        ],
    )
    return R.flat(found, ["rows_analysed"], _OFFSET)


def tz_offset_repeated_keys(spark, sf):
    """The key repeats on both sides with several timestamps, so every source row meets every target row."""
    s, t = _orders(spark, sf)
    return R.flat(datetimes.check_tz_offset(s, t, ["o_orderdate"], "o_custkey", "orders"), ["rows_analysed"], _OFFSET)


def tz_offset_hot_keys(spark, sf):
    """Five keys with thousands of distinct timestamps on each side: their pairs are counted, not built."""
    s, t = _pair(spark, sf, "events")
    s = s.selectExpr("event_id % 5 AS k", "CAST(ts AS TIMESTAMP) AS ts")
    t = t.where("event_id % 3 = 0").selectExpr("event_id % 5 AS k", "ts")
    return R.flat(datetimes.check_tz_offset(s, t, ["ts"], "k", "events"), ["rows_analysed"], _OFFSET)


# --- rows ----------------------------------------------------------------------------------------------


def _row_rules() -> TableConfig:
    return TableConfig(
        primary_key="o_orderkey",
        data_constraints={"o_custkey": ["not_null"], "order_day": ["not_null", "date"]},
        mappings=({"columns": ["o_orderstatus"], "allowed_values": list(STATUSES)},),
        order_by=("copy",),
    )


def quarantine_rows(spark, sf):
    _, bad = quarantine.split(X.orders_repeated(X.table(spark, sf, "orders")), _row_rules(), is_source=False)
    return bad.select("o_orderkey", "copy", quarantine.ERRORS)


def quarantine_source_rows(spark, sf):
    _, bad = quarantine.split(X.orders_repeated(X.table(spark, sf, "orders")), _row_rules(), is_source=True)
    return bad.select("o_orderkey", "copy", quarantine.ERRORS)


def valid_rows(spark, sf):
    good, _ = quarantine.split(X.orders_repeated(X.table(spark, sf, "orders")), _row_rules(), is_source=False)
    return good.select("o_orderkey", "copy", "o_orderstatus", "order_day")


def _quarantined(spark, sf):
    df = X.orders_repeated(X.table(spark, sf, "orders"))
    _, target = quarantine.quarantine(df, _row_rules(), "orders", is_source=False)
    _, source = quarantine.quarantine(df, _row_rules(), "orders", is_source=True)
    return target.unionByName(source)


def quarantine_summary(spark, sf):
    return quarantine.quarantine_summary(_quarantined(spark, sf))


def rule_summary(spark, sf):
    return quarantine.rule_summary(_quarantined(spark, sf))


def duplicate_pk(spark, sf):
    marked = quarantine.mark_duplicates(X.orders_repeated(X.table(spark, sf, "orders")), "o_custkey", ["o_orderkey", "copy"])
    return marked.where("_duplicate").select("o_orderkey", "copy", "o_custkey")


def quarantine_positions(spark, sf):
    """Invalid rows of a table, by their place in its file: of customers with several orders all but the first, and a status."""
    table = TableConfig(primary_key="o_custkey", mappings=({"columns": ["o_orderstatus"], "allowed_values": ["F", "O"]},))
    _, bad = quarantine.quarantine(X.table(spark, sf, "orders"), table, "orders", is_source=False)
    return bad.select("o_orderkey", quarantine.ROW_INDEX, quarantine.ERRORS)


def filtered_audit(spark, sf):
    """The audit over valid rows only."""
    orders = X.table(spark, sf, "orders")
    source = orders.selectExpr("*", "0 AS copy", "date_format(o_orderdate, 'yyyy-MM-dd') AS order_day")
    table = TableConfig(
        primary_key="o_orderkey", source="orders_source", target="orders_target",
        data_constraints={"o_custkey": ["not_null"]},
        mappings=({"columns": ["o_orderstatus"], "allowed_values": list(STATUSES)},), order_by=("copy",),
        unique_columns=("o_orderkey",),
    )
    audit = run_audit(
        spark, AuditConfig({"orders": table}), ignore_invalid_rows=True,
        frames={"orders_source": source, "orders_target": X.orders_repeated(orders)},
    )
    return R.flat(audit.results.where("category <> 'schema'"))


# --- reassembly ----------------------------------------------------------------------------------------


def _shards(spark, sf):
    orders = X.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    a = orders.where("o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
    b = orders.where("o_orderkey % 3 = 0 OR o_orderkey % 5 = 0").withColumns(
        {"o_totalprice": F.col("o_totalprice") * 2, "o_orderstatus": F.lit("B")}
    )
    return [a, b]


def merge_n_to_1(spark, sf):
    a, b = _shards(spark, sf)
    b = b.withColumn("origin", F.lit("b"))
    return mapping.merge_sources([a, b], "N:1", "merge", "o_orderkey")


def sum_n_to_1(spark, sf):
    out = mapping.merge_sources(_shards(spark, sf), "N:1", "sum", "o_orderkey")
    return out.withColumn("o_totalprice", F.round("o_totalprice", 2))


def count_n_to_1(spark, sf):
    return mapping.merge_sources(_shards(spark, sf), "N:1", "count", "o_orderkey")


def first_n_to_1(spark, sf):
    return mapping.merge_sources(_shards(spark, sf), "N:1", "first", "o_orderkey")


def last_n_to_1(spark, sf):
    return mapping.merge_sources(_shards(spark, sf), "N:1", "last", "o_orderkey")


def _vertical(spark, sf):
    orders = X.table(spark, sf, "orders")
    left = orders.where("o_orderkey % 83 <> 0").select("o_orderkey", "o_custkey", "o_totalprice")
    right = orders.where("o_orderkey % 89 <> 0").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return [left, right.withColumn("o_custkey", F.lit(-5).cast("bigint"))]


def join_1_to_n(spark, sf):
    return mapping.merge_targets(_vertical(spark, sf), "1:N", "join", ["o_orderkey", "o_orderkey"])


def join_four_parts(spark, sf):
    """Four vertical parts, each without some keys; one repeats keys, so that all its combinations are there."""
    orders = X.table(spark, sf, "orders")
    a = orders.where("o_orderkey % 83 <> 0").select("o_orderkey", "o_custkey")
    b = orders.where("o_orderkey % 89 <> 0").select("o_orderkey", "o_totalprice")
    c = orders.where("o_orderkey % 7 <> 0").select("o_orderkey", "o_orderstatus")
    d = orders.where("o_orderkey % 5 <> 0").select("o_orderkey", "o_orderpriority")
    d = d.unionByName(d.where("o_orderkey % 11 = 0").withColumn("o_orderpriority", F.lit("again")))
    return mapping.merge_targets([a, b, c, d], "1:N", "join", ["o_orderkey"] * 4)


def union_1_to_n(spark, sf):
    """One source, three shards as target."""
    orders = X.table(spark, sf, "orders")
    shards = mapping.split_horizontally(X.orders_target(orders), "o_orderkey", 3)
    target = mapping.merge_targets(shards, "1:N", "distribute", ["o_orderkey"] * 3)
    table = TableConfig(primary_key="o_orderkey", aggregates=("o_totalprice",))
    return R.flat(audit_pair(orders, target, table, "orders"))


def reshard_n_to_m(spark, sf):
    """Three source shards against two target shards with another split."""
    orders = X.table(spark, sf, "orders")
    table = TableConfig(
        primary_key="o_orderkey", aggregates=("o_totalprice",),
        complex_mapping={
            "mapping_type": "N:M", "aggregation_strategy": "merge",
            "sources": [{"path": f"s{i}", "primary_key": "o_orderkey"} for i in range(3)],
            "targets": [{"path": f"t{i}", "primary_key": "o_orderkey"} for i in range(2)],
        },
    )
    frames = {f"s{i}": df for i, df in enumerate(mapping.split_horizontally(orders, "o_orderkey", 3))}
    frames |= {f"t{i}": df for i, df in enumerate(mapping.split_horizontally(orders, "o_orderkey", 2))}
    return R.flat(run_audit(spark, AuditConfig({"orders": table}), frames=frames).results)


def column_rename(spark, sf):
    s = rename(X.table(spark, sf, "customer"), {"c_custkey": "id", "c_acctbal": "balance", "absent": "x"})
    return s.selectExpr("id", "c_name", "balance")


# --- masking, faults, scan -----------------------------------------------------------------------------


def mask_columns(spark, sf):
    return masking.mask_columns(X.table(spark, sf, "customer"), ["c_name", "c_nationkey"], ["c_acctbal"])


def redact_text(spark, sf):
    docs = X.table(spark, sf, "documents").selectExpr(
        "doc_id", "CASE WHEN doc_id % 3 = 0 THEN concat('Password: hunter', doc_id, ' ', text) ELSE text END AS text"
    )
    return masking.redact_columns(docs, ["text"]).selectExpr("doc_id", "sha2(text, 256) AS text_hash", "length(text) AS chars")


def inject_faults(spark, sf):
    plan = [
        {"type": "delete_row", "every": 97},
        {"type": "negative", "column": "o_totalprice", "every": 5},
        {"type": "nullify_value", "column": "o_custkey", "every": 7},
        {"type": "zero", "column": "o_custkey", "every": 11},
        {"type": "modify_value", "column": "o_orderstatus", "every": 13, "value": "Z"},
        {"type": "whitespace", "column": "o_orderstatus", "every": 17},
        {"type": "truncate_string", "column": "o_orderpriority", "every": 19},
        {"type": "duplicate_ids", "every": 23},
        {"type": "drop_column", "column": "o_orderdate"},
    ]
    return faults.inject(X.table(spark, sf, "orders"), "o_orderkey", plan)


def offending_values(spark, sf):
    _, t = _orders(spark, sf)
    return samples.offending_values(t, "o_orderstatus = 'X'", "o_orderstatus", "o_orderkey", 5)


def csv_scan(spark, sf):
    """Write the target as delimited text, read it back with inferred types and summarize it."""
    path = os.path.join(staging_dir(spark), "evenkeel", f"csv-{uuid.uuid4().hex}")
    df = X.orders_repeated(X.table(spark, sf, "orders"))
    df.withColumn("o_orderstatus", F.expr("CASE WHEN o_orderstatus = 'X' THEN 'N/A' ELSE o_orderstatus END")).write.option(
        "header", "true"
    ).csv(path)
    back = read_csv(spark, path)
    kinds = dict(back.dtypes)
    return back.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("rows"),
        F.expr("sum(o_custkey)").alias("custkeys"),
        F.expr("round(sum(o_totalprice), 2)").alias("price"),
        F.expr("count(order_day)").alias("days"),
        F.lit(kinds["o_custkey"]).alias("custkey_type"),
        F.lit(kinds["order_day"]).alias("day_type"),
    )


def _written_csv(spark, df, line, name):
    """One text column per row as lines of files that each have a header, written by all tasks as they come."""
    path = os.path.join(staging_dir(spark), "evenkeel", f"{name}-{uuid.uuid4().hex}")
    lines = df.selectExpr(f"{line} AS `k,price,status`")
    # no character of the lines is a separator or a quote of this writer
    lines.write.options(header="true", sep="\u0001", quote="\u0002", escapeQuotes="false").csv(path)
    return path


def _damaged_csv(spark, sf, line, bad_lines="ERROR"):
    """An audit of a text file with damaged lines against one without."""
    orders = X.table(spark, sf, "orders")
    whole = "concat_ws(',', o_orderkey, o_totalprice, o_orderstatus)"
    source, target = (_written_csv(spark, orders, sql, name) for sql, name in ((line, "damaged"), (whole, "whole")))
    config = AuditConfig.from_dict({
        "bad_lines": bad_lines, "tolerances": {"volume_loss_pct": 100.0},
        "tables": {"orders": {"source": target, "target": source, "primary_key": "k"}},
    })
    return run_audit(spark, config).results


def csv_bad_lines(spark, sf):
    """Lines with a field too many are counted and keep the audit from GO."""
    line = "concat_ws(',', o_orderkey, o_totalprice, o_orderstatus, IF(o_orderkey % 20 = 0, 'more', NULL))"
    found = _damaged_csv(spark, sf, line)
    return R.flat(found.where("check IN ('csv_lines', 'volume')"), ["long_lines", "stray_quotes", "src_rows", "tgt_rows"])


def csv_stray_quote(spark, sf):
    """A stray quote costs no other row, and is reported."""
    line = "concat_ws(',', o_orderkey, o_totalprice, concat(IF(o_orderkey % 30 = 0, '\"', ''), o_orderstatus))"
    found = _damaged_csv(spark, sf, line, "WARN")
    return R.flat(found.where("check IN ('csv_lines', 'volume')"), ["long_lines", "stray_quotes", "src_rows", "tgt_rows"])


# --- whole audits ----------------------------------------------------------------------------------------


def orders_config() -> TableConfig:
    return TableConfig(
        primary_key="o_orderkey",
        source="orders_source",
        target="orders_target",
        aggregates=("o_totalprice",),
        mappings=({"columns": ["o_orderstatus"], "allowed_values": list(STATUSES)},),
        relationships=({"child": {"fk_column": "o_custkey"}, "parent": {"pk_column": "c_custkey", "target": "customer"}},),
        data_constraints={"o_totalprice": ["positive"], "o_custkey": ["not_null"]},
        string_columns=({"column": "o_orderpriority", "check_whitespace": True, "check_encoding": True},),
        enum_columns=({"column": "o_orderstatus", "check_distribution": True},),
        datetime_columns=({"column": "o_orderdate"},),
        null_sentinels=({"column": "o_custkey", "sentinels": [0, -1]},),
        numeric_precision_columns=({"column": "o_totalprice"},),
        unique_columns=("o_orderkey",),
    )


def _full(spark, sf):
    s, t = _orders(spark, sf)
    parents = {"customer": X.table(spark, sf, "customer")}
    return audit_pair(s, t, orders_config(), "orders", parents=parents)


def full_audit(spark, sf):
    return R.flat(_full(spark, sf))


def failing_rows(spark, sf):
    """The first rows behind every failed check of the audit."""
    s, t = _orders(spark, sf)
    return failing_values(s, t, orders_config(), _full(spark, sf), 5)


def isolated_checks(spark, sf):
    """One column cannot be read: its checks are errors, all others have the results they have otherwise."""
    s, t = _orders(spark, sf)
    t = t.withColumn("o_totalprice", F.expr("IF(o_orderkey = 50, raise_error('unreadable'), o_totalprice)"))
    frames = {"orders_source": s, "orders_target": t, "customer": X.table(spark, sf, "customer")}
    audit = run_audit(spark, AuditConfig({"orders": orders_config()}), frames=frames)
    of_column = "column <=> 'o_totalprice'"
    assert not audit.results.where(f"{of_column} AND status = 'ERROR'").isEmpty()
    return R.flat(audit.results.where(f"NOT {of_column}"))


def load_errors(spark, sf):
    """A table that is not there and one whose configuration lacks a side; the third is audited."""
    customer = X.table(spark, sf, "customer")
    pair = {"primary_key": "c_custkey", "source": "customer", "target": "customer"}
    tables = {"whole": pair, "absent": {**pair, "target": "/nowhere/customer.parquet"}, "unnamed": {**pair, "target": None}}
    audit = run_audit(spark, AuditConfig.from_dict({"tables": tables}), frames={"customer": customer})
    return R.flat(audit.results)


def chosen_tables(spark, sf):
    """Two of three configured tables; a name that is not configured is passed over."""
    frames = {n: X.table(spark, sf, n) for n in ("customer", "part", "supplier")}
    keys_of = {"customer": "c_custkey", "part": "p_partkey", "supplier": "s_suppkey"}
    config = AuditConfig.from_dict({"tables": {n: {"primary_key": k, "source": n, "target": n} for n, k in keys_of.items()}})
    assert run_audit(spark, config, dry_run=True, frames=frames).results.isEmpty()
    return R.flat(run_audit(spark, config, tables=["part", "supplier", "none"], frames=frames).results)


def input_guard(spark, sf):
    """A pair without a target gets one result, and no check runs."""
    return R.flat(audit_pair(X.table(spark, sf, "orders"), None, orders_config(), "orders"))


def quarantine_files(spark, sf):
    """Invalid rows written to the quarantine and read back: rows per side and file."""
    path = os.path.join(staging_dir(spark), "evenkeel", f"quarantine-{uuid.uuid4().hex}")
    write_quarantine(_quarantined(spark, sf), path)
    return spark.read.parquet(path).groupBy("table_name", "side").agg(F.count(F.lit(1)).alias("rows"))


def report_files(spark, sf):
    """The report of an audit, written and read back: results per section."""
    path = os.path.join(staging_dir(spark), "evenkeel", f"report-{uuid.uuid4().hex}")
    write_report(_full(spark, sf), path)
    found = spark.read.json(f"{path}/sections")
    return found.selectExpr("section", "section_verdict", "checks")


def suggested_configuration(spark, sf):
    """The configuration suggested for each table, by its schema."""
    rows = []
    for name in ("orders", "customer", "lineitem"):
        found = suggest_config(X.table(spark, sf, name).schema, "a", "b")
        rows.append((name, found["primary_key"], ",".join(found["aggregates"]), ",".join(c["column"] for c in found["datetime_columns"])))
    return spark.createDataFrame(rows, "table_name string, primary_key string, aggregates string, datetimes string")


def copied_targets(spark, sf):
    """Each full copy of a source is compared on its own."""
    orders = X.table(spark, sf, "orders")
    spec = lambda *names: [{"path": n, "primary_key": "o_orderkey"} for n in names]
    table = {"primary_key": "o_orderkey", "complex_mapping": {
        "mapping_type": "1:N", "split_strategy": "copy", "sources": spec("s"), "targets": spec("a", "b"),
    }}
    frames = {"s": orders, "a": orders, "b": orders.where("o_orderkey % 4 <> 0")}
    found = run_audit(spark, AuditConfig.from_dict({"tables": {"orders": table}}), frames=frames).results
    return R.flat(found.where("check = 'volume'"), ["src_rows", "tgt_rows"])


def custom_checks(spark, sf):
    """Checks by name from the registry, in one audit with the built-in ones."""
    s, t = _orders(spark, sf)
    table = TableConfig(
        primary_key="absent",
        custom_checks=(
            {"check": "constraint", "column": "o_totalprice", "rules": ["between_1000_400000"]},
            {"check": "whitespace", "column": "o_orderpriority"},
        ),
    )
    return R.flat(audit_pair(s, t, table, "orders"))


def sampled_rows(spark, sf):
    """A tenth of the orders, chosen by the hash of the key."""
    return samples.sample_rows(X.table(spark, sf, "orders"), "o_orderkey", 0.1).select("o_orderkey", "o_custkey")


def sampled_exactly(spark, sf):
    """A hundred orders by the hash of their key, merged from the samples of three parts."""
    orders = X.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    parts = [samples.smallest_rows(part, "o_orderkey", 100) for part in mapping.split_horizontally(orders, "o_orderkey", 3)]
    return samples.smallest_rows(mapping.concat(parts), "o_orderkey", 100)


def split_shards(spark, sf):
    """Rows and keys of the shards of a horizontal split."""
    shards = mapping.split_horizontally(X.table(spark, sf, "orders"), "o_orderkey", 4)
    rows = mapping.concat([df.withColumn("shard", F.lit(i)) for i, df in enumerate(shards)])
    return rows.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("o_orderkey").alias("keys"))


def verdict(spark, sf):
    return rollup.verdict(_full(spark, sf))


def section_verdicts(spark, sf):
    return rollup.section_verdicts(_full(spark, sf))


def table_summary(spark, sf):
    return rollup.table_summary(_full(spark, sf))


def ci_summary(spark, sf):
    return ci_report(_full(spark, sf), "2024-01-01T00:00:00+00:00").selectExpr(
        "verdict", "summary.pass AS n_pass", "summary.warn AS n_warn", "summary.fail AS n_fail",
        "summary.error AS n_error", "timestamp", "total_checks",
    )


def result_fingerprint(spark, sf):
    return content_hash(_full(spark, sf), ("table_name", "check", "column", "status"))


def incremental_audit(spark, sf):
    """The orders arrive in three files per side; the state after the streams gives the same statuses."""
    s, t = _orders(spark, sf)
    base = os.path.join(staging_dir(spark), "evenkeel", f"incremental-{uuid.uuid4().hex}")
    parents = {"customer": X.table(spark, sf, "customer")}
    audit = IncrementalAudit(spark, "orders", orders_config(), s.schema, t.schema, f"{base}/state", parents=parents)
    for side, df in (("source", s), ("target", t)):
        df.repartition(3, F.expr("o_orderkey % 3")).write.parquet(f"{base}/{side}")
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/{side}")
        audit.process(side, stream, f"{base}/checkpoint-{side}").awaitTermination()
    return R.flat(audit.finalize())


def replayed_batches(spark, sf):
    """Batches that are delivered twice, before and after the folders were merged, and a stream that numbers anew."""
    s, t = _orders(spark, sf)
    base = os.path.join(staging_dir(spark), "evenkeel", f"replayed-{uuid.uuid4().hex}")
    table = TableConfig(primary_key="absent", aggregates=("o_totalprice",))
    audit = IncrementalAudit(spark, "orders", table, s.schema, t.schema, base, compact_every=3)
    part = lambda df, i: df.where(f"o_orderkey % 5 = {i}")
    for i in (0, 1, 1, 2, 3):  # the third folder makes the side merge
        audit.add_batch("source", part(s, i), i, "first")
    audit.add_batch("source", part(s, 1), 1, "first")  # as if the folder had been left behind by a failure
    audit.add_batch("source", part(s, 4), 0, "second")  # a new checkpoint
    audit.add_batch("target", t, 0, "first")
    found = audit.finalize().where("check IN ('volume', 'sum')")
    return found.selectExpr(
        "table_name", "check", "status", "CAST(metrics['src_rows'] AS BIGINT) AS src_rows", "CAST(metrics['tgt_rows'] AS BIGINT) AS tgt_rows",
        "round(metrics['src_value'], 2) AS src_value", "round(metrics['tgt_value'], 2) AS tgt_value",
    )


def incremental_overlap_estimate(spark, sf):
    """Key overlap from sketches of six batches, against the exact one: whether it lies within its stated error."""
    s, t = _orders(spark, sf)
    base = os.path.join(staging_dir(spark), "evenkeel", f"sketched-{uuid.uuid4().hex}")
    table = TableConfig(primary_key="o_orderkey")
    audit = IncrementalAudit(spark, "orders", table, s.schema, t.schema, base, sketched=("o_orderkey",))
    for side, df in (("source", s), ("target", t)):
        for i in range(3):
            audit.add_batch(side, df.where(f"o_orderkey % 3 = {i}"), i)
    exact = keys.check_identity(s, t, "o_orderkey", "orders").selectExpr("metrics['overlap_pct'] AS exact")
    found = audit.finalize().where("check = 'identity'").crossJoin(exact)  # one row each
    return found.selectExpr(
        "check", "status", "round(exact, 4) AS exact_overlap_pct",
        "abs(metrics['overlap_pct'] - exact) <= metrics['error_pct'] AS within_error",
    )


ALL: dict[str, Query] = {
    **{
        f.__name__: f
        for f in (
            volume_1to1, volume_ratio, identity_overlap, identity_null_keys, missing_keys, approximate_identity,
            schema_diff, agg_all, agg_all_null, agg_column_mapping, junk_numeric, numeric_precision,
            allowed_values, invalid_values, fk_orphans, orphan_keys, orphan_rows, null_sentinel,
            constraint_not_null, constraint_date, constraint_positive, constraint_between, uniqueness,
            string_truncation, whitespace, encoding, enum_raw, enum_mapped, distribution_shift, value_counts,
            value_differences, boolean_ratio, datetime_parse, tz_awareness, tz_offset, tz_offset_repeated_keys,
            quarantine_rows, quarantine_source_rows, valid_rows, quarantine_summary, rule_summary, duplicate_pk,
            filtered_audit, merge_n_to_1, sum_n_to_1, count_n_to_1, first_n_to_1, last_n_to_1, join_1_to_n,
            union_1_to_n, reshard_n_to_m, column_rename, mask_columns, redact_text, inject_faults,
            offending_values, csv_scan, full_audit, verdict, section_verdicts, table_summary, ci_summary,
            result_fingerprint, incremental_audit, failing_rows, custom_checks, sampled_rows, split_shards,
            csv_bad_lines, csv_stray_quote, identity_wide_numbers, tiny_digits, agg_presence, id_columns,
            isolated_checks, load_errors, chosen_tables, input_guard, quarantine_files, report_files,
            suggested_configuration, copied_targets, tz_offset_hot_keys, quarantine_positions, join_four_parts,
            sampled_exactly, replayed_batches, incremental_overlap_estimate,
        )
    },
    "agg_sum": _aggregate("sum"),
    "agg_avg": _aggregate("avg", 4),
    "agg_max": _aggregate("max"),
    "agg_min": _aggregate("min"),
    "agg_variance": _aggregate("variance", -3),
}


def in_utc(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return query(spark, sf_dir)

    run.__name__ = getattr(query, "__name__", "query")
    run.__doc__ = query.__doc__
    return run
