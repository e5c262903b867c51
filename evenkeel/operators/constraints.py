"""Checks on values of the target alone (constraints, allowed values) and null equivalence."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame

from evenkeel.functions import values as V
from evenkeel.functions.values import quote
from evenkeel.operators.aggregates import missing
from evenkeel.operators.facts import ScalarCheck, Side
from evenkeel.operators.run import scalar_rows
from evenkeel.results import ERROR, FAIL, PASS, WARN, Finding, case, literal, text

_BETWEEN = re.compile(r"^between_(-?\d+(?:\.\d+)?)_(-?\d+(?:\.\d+)?)$")


def constraint_violation(side: Side, column: str, rule: str) -> str:
    """True where the value breaks the rule. ``date`` counts NULL as broken, the range rules do not."""
    value = side.col(column)
    if rule == "not_null":
        return f"{value} IS NULL"
    if rule == "date":
        return f"{V.to_timestamp(value, side.dtype(column))} IS NULL"
    number = side.shared_number(column)
    not_a_number = "false" if V.is_number_type(side.dtype(column)) else f"({value} IS NOT NULL AND {number} IS NULL)"
    if rule == "positive":
        return f"({not_a_number} OR coalesce({number} <= 0, false))"
    bounds = _BETWEEN.match(rule)
    if bounds:
        lo, hi = (quote(float(b)) for b in bounds.groups())
        return f"({not_a_number} OR coalesce({number} NOT BETWEEN {lo} AND {hi}, false))"
    raise ValueError(f"unknown constraint '{rule}'")


def plan_constraints(target: Side, column: str, rules: Sequence[str] | str) -> ScalarCheck:
    rules = [rules] if isinstance(rules, str) else list(rules)
    if column not in target:
        # the rule cannot be evaluated at all, which is an error rather than a failed check
        return missing("data_constraints", "constraint", column, ERROR, "the target")
    rows = target.rows()
    broken = {
        rule: target.count_where("broken", column, constraint_violation(target, column, rule), rule) for rule in rules
    }

    def decide(s, t):
        n = t(rows)
        any_broken = " OR ".join([f"{t(m)} > 0" for m in broken.values()] or ["false"])
        notes = [text(f"{rule}: %d of %d rows break it", t(m), n) for rule, m in broken.items()]
        message = f"CASE WHEN {n} = 0 THEN 'the target is empty' ELSE concat_ws('; ', {', '.join(notes or [quote('no rule')])}) END"
        metrics = {"rows": n, **{f"{rule}_violations": t(m) for rule, m in broken.items()}}
        status = case((f"{n} = 0", WARN), (any_broken, FAIL), otherwise=PASS)
        return [Finding("data_constraints", "constraint", column, status, message, metrics)]

    return ScalarCheck([], [rows, *broken.values()], decide)


def plan_allowed_values(target: Side, columns: Sequence[str], allowed: Sequence[Any]) -> ScalarCheck:
    """One result for all columns of one list. NULL is not an allowed value. Compared as text."""
    allowed = [str(a) for a in allowed]
    rows = target.rows()
    absent = [c for c in columns if c not in target]
    invalid = {
        c: target.count_where("disallowed", c, f"NOT {V.is_any(target.text(c), allowed)}", *allowed)
        for c in columns
        if c in target
    }

    def decide(s, t):
        n = t(rows)
        total = t.let(" + ".join([t(m) for m in invalid.values()] or ["0L"]))
        status = case((f"{n} = 0", WARN), (f"{quote(bool(absent))} OR {total} > 0", FAIL), otherwise=PASS)
        notes = [quote(f"column '{c}' is missing") for c in absent]
        notes += [text(f"column '{literal(c)}': %d rows with a value not allowed", t(m)) for c, m in invalid.items()]
        message = f"CASE WHEN {n} = 0 THEN 'the target is empty' ELSE concat_ws('; ', {', '.join(notes)}) END"
        metrics = {"invalid_rows": total, **{f"invalid_rows_{c}": t(m) for c, m in invalid.items()}}
        details = {"missing_columns": quote(",".join(absent))}
        return [Finding("mappings", "allowed_values", ",".join(columns), status, message, metrics, details)]

    return ScalarCheck([], [rows, *invalid.values()], decide)


def plan_null_sentinel(source: Side, target: Side, column: str, sentinels: Sequence[Any]) -> ScalarCheck:
    for side, where in ((source, "the source"), (target, "the target")):
        if column not in side:
            return missing("null_sentinel", "null_sentinel", column, FAIL, where)

    def metrics(side: Side):
        c = side.col(column)
        typed = V.typed_literals(sentinels, side.dtype(column))
        blank = f"({c} IS NULL OR {V.is_any(c, typed)})"
        return (
            side.rows(),
            side.count_where("nulls", column, f"{c} IS NULL"),
            side.count_where("blank", column, blank, *map(repr, sentinels)),
        )

    ms, mt = metrics(source), metrics(target)

    def decide(s, t):
        src, tgt = s(ms[0]), t(mt[0])
        before_s, before_t = (s.let(f"try_divide({g(m[1])}, {g(m[0])})") for g, m in ((s, ms), (t, mt)))
        after_s, after_t = (s.let(f"try_divide({g(m[2])}, {g(m[0])})") for g, m in ((s, ms), (t, mt)))
        empty = f"{src} = 0 OR {tgt} = 0"
        before = s.let(f"abs({before_s} - {before_t}) < 0.001")
        after = s.let(f"abs({after_s} - {after_t}) < 0.001")
        status = case((empty, WARN), (f"{before} AND {after}", PASS), (f"{before} OR {after}", WARN), otherwise=FAIL)
        message = (
            f"CASE WHEN {empty} THEN 'a side is empty' WHEN {before} AND {after} THEN 'null rates agree'"
            f" WHEN {after} THEN 'null representation changed; equal once sentinels are nulls'"
            f" WHEN {before} THEN 'sentinels differ between the sides although null rates agree'"
            " ELSE 'null rates differ even with sentinels as nulls' END"
        )
        return [
            Finding(
                "null_sentinel", "null_sentinel", column, status, message,
                {
                    "src_rows": src, "tgt_rows": tgt,
                    "src_null_rate_before": f"{before_s} * 100", "tgt_null_rate_before": f"{before_t} * 100",
                    "src_null_rate_after": f"{after_s} * 100", "tgt_null_rate_after": f"{after_t} * 100",
                    "src_sentinel_substitutions": f"{s(ms[2])} - {s(ms[1])}",
                    "tgt_sentinel_substitutions": f"{t(mt[2])} - {t(mt[1])}",
                },
                {"sentinels": quote(",".join(map(str, sentinels)))},
            )
        ]

    return ScalarCheck(list(ms), list(mt), decide)


def check_data_constraints(target: DataFrame, constraints: Mapping[str, Sequence[str] | str], table: str) -> DataFrame:
    """One row per column with its rules ``not_null``, ``date``, ``positive``, ``between_<lo>_<hi>``."""
    side = Side.of(target)
    plans = [plan_constraints(side, c, rules) for c, rules in constraints.items()]
    return scalar_rows(target, target, plans, table)


def check_allowed_values(target: DataFrame, columns: Sequence[str], allowed: Sequence[Any], table: str) -> DataFrame:
    return scalar_rows(target, target, [plan_allowed_values(Side.of(target), columns, allowed)], table)


def invalid_values(target: DataFrame, columns: Sequence[str], allowed: Sequence[Any]) -> DataFrame:
    """Every value that is not allowed, with its number of rows: ``(column, value, rows)``."""
    side = Side.of(target)
    pairs = ", ".join(f"struct({quote(c)} AS column, {side.text(c)} AS value)" for c in columns)
    bad = target.selectExpr(f"inline(array({pairs}))").where(f"NOT {V.is_any('value', [str(a) for a in allowed])}")
    return bad.groupBy("column", "value").count().withColumnRenamed("count", "rows")


def check_null_sentinel_equivalence(
    source: DataFrame, target: DataFrame, column: str, table: str, sentinels: Sequence[Any]
) -> DataFrame:
    plan = plan_null_sentinel(Side.of(source), Side.of(target), column, sentinels)
    return scalar_rows(source, target, [plan], table)
