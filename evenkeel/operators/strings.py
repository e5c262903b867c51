"""White space, encoding damage and boolean tokens: conditional counts of both sides.

Truncation needs the distribution of lengths and lives in :mod:`evenkeel.operators.frequency`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from evenkeel.functions import values as V
from evenkeel.operators.aggregates import missing
from evenkeel.operators.facts import ScalarCheck, Side, derived
from evenkeel.operators.run import scalar_rows
from evenkeel.results import FAIL, PASS, WARN, Finding, case, text


def plan_whitespace(source: Side, target: Side, column: str) -> ScalarCheck:
    if column not in source or column not in target:
        return missing("string", "whitespace", column, FAIL, "source or target")
    ms, mt = (
        (side.nonnull(column), side.count_where("unstripped", column, V.is_unstripped(side.text(column))))
        for side in (source, target)
    )

    def decide(s, t):
        src, tgt = s(ms[1]), t(mt[1])
        status = case(
            (f"{s(ms[0])} = 0", WARN), (f"{src} > 0 AND {tgt} = 0", WARN), (f"{tgt} > {src}", FAIL), otherwise=PASS
        )
        message = text("values with outer white space: source %d, target %d", src, tgt)
        metrics = {
            "src_unstripped_count": src, "tgt_unstripped_count": tgt,
            "src_unstripped_pct": f"try_divide({src}, {s(ms[0])}) * 100",
            "tgt_unstripped_pct": f"coalesce(try_divide({tgt}, {t(mt[0])}) * 100, 0D)",
        }
        return [Finding("string", "whitespace", column, status, message, metrics)]

    return ScalarCheck(list(ms), list(mt), decide)


def plan_encoding(source: Side, target: Side, column: str) -> ScalarCheck:
    if column not in source or column not in target:
        return missing("string", "encoding", column, FAIL, "source or target")
    ms, mt = (
        (side.nonnull(column), side.count_where("corrupt", column, V.is_mojibake(side.text(column))))
        for side in (source, target)
    )

    def decide(s, t):
        src, tgt = s(ms[1]), t(mt[1])
        status = case(
            (f"{s(ms[0])} = 0", WARN), (f"{tgt} > {src}", FAIL), (f"{src} > 0 AND {tgt} = 0", WARN), otherwise=PASS
        )
        message = text("values with encoding damage: source %d, target %d", src, tgt)
        metrics = {"src_corrupt_count": src, "tgt_corrupt_count": tgt}
        return [Finding("string", "encoding", column, status, message, metrics)]

    return ScalarCheck(list(ms), list(mt), decide)


def plan_boolean(
    source: Side,
    target: Side,
    column: str,
    true_values: Sequence[str] = V.TRUE_TOKENS,
    false_values: Sequence[str] = V.FALSE_TOKENS,
) -> ScalarCheck:
    if column not in source or column not in target:
        return missing("boolean", "boolean", column, FAIL, "source or target")

    def metrics(side: Side):
        value = derived(V.to_boolean(side.col(column), side.dtype(column), true_values, false_values))
        tokens = (*true_values, "|", *false_values)
        return (
            side.nonnull(column),
            side.count_where("true", column, value, *tokens),
            side.count_where("false", column, f"NOT {value}", *tokens),
        )

    ms, mt = metrics(source), metrics(target)

    def decide(s, t):
        def share(get, m):
            return get.let(f"coalesce(try_divide({get(m[1])}, {get(m[1])} + {get(m[2])}), 0D)")

        share_s, share_t = share(s, ms), share(t, mt)
        gap = s.let(f"abs({share_s} - {share_t})")
        unknown_s = f"({s(ms[0])} - {s(ms[1])} - {s(ms[2])})"
        unknown_t = f"({t(mt[0])} - {t(mt[1])} - {t(mt[2])})"
        status = case(
            (f"{s(ms[0])} = 0", WARN), (f"{gap} > 0.001", FAIL),
            (f"{unknown_s} > 0 OR {unknown_t} > 0", WARN), otherwise=PASS,
        )
        message = text(
            "share of true: source %.4f, target %.4f; unknown tokens: source %d, target %d",
            share_s, share_t, unknown_s, unknown_t,
        )
        found = {
            "src_true_share": share_s, "tgt_true_share": share_t, "share_gap": gap,
            "src_unmapped": unknown_s, "tgt_unmapped": unknown_t,
        }
        return [Finding("boolean", "boolean", column, status, message, found)]

    return ScalarCheck(list(ms), list(mt), decide)


def check_whitespace_corruption(source: DataFrame, target: DataFrame, column: str, table: str) -> DataFrame:
    return scalar_rows(source, target, [plan_whitespace(Side.of(source), Side.of(target), column)], table)


def check_encoding_corruption(source: DataFrame, target: DataFrame, column: str, table: str) -> DataFrame:
    return scalar_rows(source, target, [plan_encoding(Side.of(source), Side.of(target), column)], table)


def check_boolean_normalization(
    source: DataFrame,
    target: DataFrame,
    column: str,
    table: str,
    true_values: Sequence[str] = V.TRUE_TOKENS,
    false_values: Sequence[str] = V.FALSE_TOKENS,
) -> DataFrame:
    plan = plan_boolean(Side.of(source), Side.of(target), column, true_values, false_values)
    return scalar_rows(source, target, [plan], table)
