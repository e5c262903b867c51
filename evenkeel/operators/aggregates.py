"""Drift of sum, average, maximum, minimum and variance, junk values, and numeric precision."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from evenkeel.functions import values as V
from evenkeel.functions.values import quote
from evenkeel.operators.facts import Facts, ScalarCheck, Side
from evenkeel.operators.run import scalar_rows
from evenkeel.results import FAIL, PASS, WARN, Finding, case, fixed_finding, text

AGGREGATES = ("sum", "avg", "max", "min", "variance")

# Relative gap, in percent, below which two floating-point results count as one: it covers the error
# that the order of addition brings, and is used for sums only together with order-free integer sums.
NOISE_PCT = "1e-7D"

_NEEDS = {
    "sum": ("n", "sum", "whole", "micro"), "avg": ("n", "sum", "whole", "micro"),
    "max": ("n", "max"), "min": ("n", "min"), "variance": ("n", "sum", "m2"),
}


def missing(category: str, check: str, column: str, status: str, where: str) -> ScalarCheck:
    found = fixed_finding(category, check, column, status, f"column '{column}' is missing from {where}")
    return ScalarCheck([], [], lambda s, t: [found])


def _statistic(kind: str, get: Facts, m: dict) -> str:
    """The statistic of one side; 0 where there are no values."""
    n = get(m["n"])
    if kind in ("sum", "avg"):
        # the integer sums hold every value to six decimals: where they agree with the sum of doubles,
        # they are the sum without the error of the order of addition
        free = get.let(f"CAST({get(m['whole'])} AS DOUBLE) + CAST({get(m['micro'])} AS DOUBLE) / 1e6D")
        plain = f"coalesce({get(m['sum'])}, 0D)"
        total = get.let(f"CASE WHEN abs({free} - {plain}) <= 1e-9D * abs({plain}) THEN {free} ELSE {plain} END")
        return total if kind == "sum" else get.let(f"coalesce(try_divide({total}, {n}), 0D)")
    if kind in ("max", "min"):
        return get.let(f"coalesce({get(m[kind])}, 0D)")
    return get.let(f"CASE WHEN {n} = 0 THEN 0D ELSE try_divide({get(m['m2'])}, {n} - 1) END")


def plan_aggregate(
    source: Side,
    target: Side,
    column: str,
    tolerance: float,
    target_column: str | None = None,
    kinds: Sequence[str] = AGGREGATES,
    is_key: Callable[[str], bool] = V.looks_like_key,
) -> list[ScalarCheck]:
    """Checks for one column; empty where a side is not numeric or the column looks like a key."""
    other = target_column or column
    if column not in source or other not in target:
        return []
    if not V.is_number_type(source.dtype(column)) or not V.is_number_type(target.dtype(other)) or is_key(other):
        return []
    ms, mt = source.numbers(column), target.numbers(other)
    s_rows, t_rows = source.rows(), target.rows()
    label = other if column == other else f"{column}->{other}"
    limit = quote(float(tolerance))

    def decide_for(kind: str):
        def decide(s, t):
            a, b = _statistic(kind, s, ms), _statistic(kind, t, mt)
            pct = s.let(V.percent_gap(a, b))
            if kind in ("sum", "avg"):
                d_whole, d_micro = f"({s(ms['whole'])} - {t(mt['whole'])})", f"({s(ms['micro'])} - {t(mt['micro'])})"
                same = s.let(f"coalesce({d_whole} = 0 AND {d_micro} = 0, false)")
                equal = f"{same} AND {s(ms['n'])} = {t(mt['n'])}" if kind == "avg" else same
                exact = f"CASE WHEN {equal} AND {pct} <= {NOISE_PCT} THEN 0D"
                if kind == "sum":
                    gap = f"abs(CAST({d_whole} AS DOUBLE) + CAST({d_micro} AS DOUBLE) / 1e6D)"
                    exact += f" WHEN NOT {same} AND {pct} = 0 THEN try_divide({gap}, abs({a})) * 100"
                pct = s.let(f"{exact} ELSE {pct} END")
            elif kind == "variance":
                pct = s.let(f"CASE WHEN {pct} <= {NOISE_PCT} THEN 0D ELSE {pct} END")
            no_number = s.let(
                f"({s(s_rows)} > 0 AND {s(ms['n'])} = 0) OR ({t(t_rows)} > 0 AND {t(mt['n'])} = 0)"
            )
            unknown = f"{a} IS NULL OR {b} IS NULL"
            status = case(
                (no_number, WARN), (unknown, WARN), (f"{a} = 0", WARN), (f"{pct} = 0", PASS),
                (f"{pct} <= {limit}", WARN), otherwise=FAIL,
            )
            message = (
                f"CASE WHEN {no_number} THEN 'a side holds no numeric value'"
                f" WHEN {unknown} THEN 'not enough rows for a variance'"
                f" WHEN {a} = 0 THEN 'source {kind} is zero'"
                f" ELSE {text(kind + ': source %.6f, target %.6f, difference %.4f %%', a, b, pct)} END"
            )
            metrics = {"src_value": a, "tgt_value": b, "pct_difference": pct, "tolerance": limit}
            return [Finding("aggregates", kind, label, status, message, metrics)]

        return decide

    return [
        ScalarCheck(
            [s_rows, *[ms[k] for k in _NEEDS[kind]]], [t_rows, *[mt[k] for k in _NEEDS[kind]]], decide_for(kind)
        )
        for kind in kinds
    ]


def plan_junk(target: Side, column: str) -> ScalarCheck:
    """Non-null target values that are not numbers; a row only where there are some."""
    if V.is_number_type(target.dtype(column)):
        return ScalarCheck([], [], lambda s, t: [])  # a numeric column holds numbers only
    bad = f"({target.col(column)} IS NOT NULL AND {target.shared_number(column)} IS NULL)"
    value = f"CASE WHEN {bad} THEN {target.text(column)} END"
    junk = target.count_where("junk", column, bad)
    first, last = target.lowest("junk_first", column, value), target.highest("junk_last", column, value)

    def decide(s, t):
        return [
            Finding(
                "aggregates", "junk_values", column, quote(FAIL),
                text("%d target values are not numbers", t(junk)),
                {"junk_rows": t(junk)},
                samples=f"array_distinct(array_compact(array({t(first)}, {t(last)})))",
                when=f"{t(junk)} > 0",
            )
        ]

    return ScalarCheck([], [junk, first, last], decide)


def plan_aggregates(
    source: Side, target: Side, column: str, tolerance: float, target_column: str | None = None
) -> list[ScalarCheck]:
    """Presence, junk and drift of one configured column."""
    other = target_column or column
    if column not in source:
        return [missing("aggregates", "column_presence", column, FAIL, "the source")]
    if other not in target:
        return [missing("aggregates", "column_presence", other, WARN, "the target")]
    return [plan_junk(target, other), *plan_aggregate(source, target, column, tolerance, other)]


def plan_precision(
    source: Side,
    target: Side,
    column: str,
    expected_precision: int | None = None,
    expected_scale: int | None = None,
) -> ScalarCheck:
    if column not in source or column not in target:
        return missing("numeric_precision", "numeric_precision", column, FAIL, "source or target")
    ms, mt = source.digits(column), target.digits(column)

    def lost(src: str, tgt: str, expected: int | None) -> str:
        return f"{src} > {tgt}" if expected is None else f"({tgt} < {expected} AND {src} > {tgt})"

    def decide(s, t):
        none = f"{s(ms['n'])} = 0"
        src_scale, src_prec = s(ms["scale"]), s(ms["precision"])
        # a target without numbers has lost every digit
        tgt_scale, tgt_prec = s.let(f"coalesce({t(mt['scale'])}, 0)"), s.let(f"coalesce({t(mt['precision'])}, 0)")
        scale_lost = s.let(lost(src_scale, tgt_scale, expected_scale))
        prec_lost = s.let(lost(src_prec, tgt_prec, expected_precision))
        status = case((none, WARN), (f"{scale_lost} OR {prec_lost}", FAIL), otherwise=PASS)
        message = (
            f"CASE WHEN {none} THEN 'source holds no numeric value' ELSE concat_ws('; ',"
            f" CASE WHEN {scale_lost} THEN {text('scale truncation: %d to %d', src_scale, tgt_scale)} END,"
            f" CASE WHEN {prec_lost} THEN {text('precision truncation: %d to %d', src_prec, tgt_prec)} END,"
            f" CASE WHEN NOT {scale_lost} AND NOT {prec_lost} THEN 'digits preserved' END) END"
        )
        metrics = {
            "src_max_scale": src_scale, "tgt_max_scale": tgt_scale,
            "src_max_precision": src_prec, "tgt_max_precision": tgt_prec,
        }
        return [Finding("numeric_precision", "numeric_precision", column, status, message, metrics)]

    return ScalarCheck(list(ms.values()), list(mt.values()), decide)


def check_aggregates(
    source: DataFrame, target: DataFrame, columns: Sequence[str], table: str, tolerance: float
) -> DataFrame:
    """All statistics of several columns in one pass over each side."""
    s, t = Side.of(source), Side.of(target)
    return scalar_rows(source, target, [p for c in columns for p in plan_aggregate(s, t, c, tolerance)], table)


def check_aggregate(
    source: DataFrame,
    target: DataFrame,
    column: str,
    table: str,
    tolerance: float,
    kinds: Sequence[str] = AGGREGATES,
    target_column: str | None = None,
) -> DataFrame:
    """Drift of the named statistics. Equal is PASS, within tolerance WARN, beyond FAIL."""
    plans = plan_aggregate(Side.of(source), Side.of(target), column, tolerance, target_column, kinds)
    return scalar_rows(source, target, plans, table)


def check_sum(source: DataFrame, target: DataFrame, column: str, table: str, tolerance: float) -> DataFrame:
    return check_aggregate(source, target, column, table, tolerance, ("sum",))


def check_avg(source: DataFrame, target: DataFrame, column: str, table: str, tolerance: float) -> DataFrame:
    return check_aggregate(source, target, column, table, tolerance, ("avg",))


def check_max(source: DataFrame, target: DataFrame, column: str, table: str, tolerance: float) -> DataFrame:
    return check_aggregate(source, target, column, table, tolerance, ("max",))


def check_min(source: DataFrame, target: DataFrame, column: str, table: str, tolerance: float) -> DataFrame:
    return check_aggregate(source, target, column, table, tolerance, ("min",))


def check_variance(source: DataFrame, target: DataFrame, column: str, table: str, tolerance: float) -> DataFrame:
    return check_aggregate(source, target, column, table, tolerance, ("variance",))


def check_junk(target: DataFrame, column: str, table: str) -> DataFrame:
    """FAIL row with count and samples where values of a numeric column are not numbers."""
    return scalar_rows(target, target, [plan_junk(Side.of(target), column)], table)


def check_numeric_precision(
    source: DataFrame,
    target: DataFrame,
    column: str,
    table: str,
    expected_precision: int | None = None,
    expected_scale: int | None = None,
) -> DataFrame:
    """FAIL where the target has fewer digits than the source (and fewer than expected)."""
    plan = plan_precision(Side.of(source), Side.of(target), column, expected_precision, expected_scale)
    return scalar_rows(source, target, [plan], table)
