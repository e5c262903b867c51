"""Offending values for the checks that failed.

Statuses come first; only failed checks then look for values, each with a scan of the key and one column
in which every task keeps a handful of rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.config import TableConfig
from evenkeel.functions import values as V
from evenkeel.functions.values import ident, quote
from evenkeel.operators.constraints import constraint_violation
from evenkeel.operators.facts import Side
from evenkeel.results import FAIL


def _wanted(source: Side, target: Side, table: TableConfig, failed: dict) -> list[tuple]:
    """(check, column, side, predicate) for every failed check that points at single rows."""
    out = []
    for c in table.string_columns:
        limit = failed.get(("truncation", c.column))
        if limit is not None:
            out.append(("truncation", c.column, "source", f"length({source.text(c.column)}) > {int(limit['effective_limit'])}"))
        if ("whitespace", c.column) in failed:
            out.append(("whitespace", c.column, "target", V.is_unstripped(target.text(c.column))))
        if ("encoding", c.column) in failed:
            out.append(("encoding", c.column, "target", V.is_mojibake(target.text(c.column))))
    for column in table.aggregates:
        other = table.aggregate_pair(column)[1]
        if ("junk_values", other) in failed:
            out.append(("junk_values", other, "target", f"{target.col(other)} IS NOT NULL AND {target.number(other)} IS NULL"))
    for rule in table.mappings:
        if ("allowed_values", ",".join(rule.columns)) in failed:
            allowed = [str(a) for a in rule.allowed_values]
            out += [
                ("allowed_values", c, "target", f"NOT {V.is_any(target.text(c), allowed)}") for c in rule.columns if c in target
            ]
    for column, rules in table.data_constraints.items():
        if ("constraint", column) in failed:
            rules = [rules] if isinstance(rules, str) else rules
            tests = " OR ".join(f"({constraint_violation(target, column, r)})" for r in rules)
            out.append(("constraint", column, "target", tests))
    for c in table.datetime_columns:
        if ("datetime_parse", c.column) in failed:
            for name, side in (("source", source), ("target", target)):
                value = side.col(c.column)
                broken = f"{value} IS NOT NULL AND {V.to_timestamp(value, side.dtype(c.column))} IS NULL"
                out.append(("datetime_parse", c.column, name, broken))
    return out


def failing_values(
    source: DataFrame, target: DataFrame, table: TableConfig, results: DataFrame, n: int = 5
) -> DataFrame | None:
    """``(check, column, side, key, value)``: the first ``n`` rows by key for every failed check.

    ``None`` if no failed check points at single rows.
    """
    rows = results.where(F.col("status") == FAIL).select("check", "column", "metrics").collect()  # one per check
    failed = {(r["check"], r["column"]): r["metrics"] for r in rows}
    s, t = Side.of(source), Side.of(target)
    parts = []
    for check, column, side_name, predicate in _wanted(s, t, table, failed):
        side, df = (s, source) if side_name == "source" else (t, target)
        key = side.text(table.primary_key) if table.primary_key in side else "CAST(NULL AS STRING)"
        order = ident(table.primary_key) if table.primary_key in side else ident(column)
        found = df.where(predicate).orderBy(order, ident(column)).limit(n)
        parts.append(
            found.selectExpr(
                f"{quote(check)} AS check", f"{quote(column)} AS column", f"{quote(side_name)} AS side",
                f"{key} AS key", f"{side.text(column)} AS value",
            )
        )
    return reduce(DataFrame.unionByName, parts) if parts else None
