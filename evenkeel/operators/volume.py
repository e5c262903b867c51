"""Row counts of the two sides."""

from __future__ import annotations

from pyspark.sql import DataFrame

from evenkeel.functions.values import quote
from evenkeel.operators.facts import ScalarCheck, Side
from evenkeel.operators.run import scalar_rows
from evenkeel.results import FAIL, PASS, WARN, Finding, case, text

RATIO_MAPPINGS = ("1:N", "N:1")


def plan_volume(
    source: Side,
    target: Side,
    tolerance_pct: float = 0.0,
    mapping_type: str | None = None,
    expected_ratio: float | None = None,
) -> ScalarCheck:
    s_rows, t_rows = source.rows(), target.rows()
    ratio = expected_ratio if mapping_type in RATIO_MAPPINGS else None
    tolerance = quote(float(tolerance_pct))

    def decide(s, t):
        src, tgt = s(s_rows), t(t_rows)
        expected = s.let(f"CAST({src} * {quote(float(ratio))} AS BIGINT)") if ratio else src
        gap = s.let(f"CASE WHEN {src} = 0 THEN {tgt} ELSE abs({tgt} - {expected}) END")
        loss = s.let(f"coalesce(try_divide({gap}, {expected}) * 100, 0D)")
        status = case(
            (f"{src} = 0 AND {tgt} = 0", PASS), (f"{src} = 0", WARN), (f"{loss} <= {tolerance}", PASS), otherwise=FAIL
        )
        message = text(
            "%d source rows, %d target rows, %d expected, difference %.2f %%", src, tgt, expected, loss
        )
        metrics = {
            "src_rows": src, "tgt_rows": tgt, "expected_rows": expected, "difference": gap,
            "loss_pct": loss, "tolerance": tolerance,
        }
        return [Finding("volume", "volume", None, status, message, metrics)]

    return ScalarCheck([s_rows], [t_rows], decide)


def check_volume(
    source: DataFrame,
    target: DataFrame,
    table: str,
    tolerance_pct: float = 0.0,
    mapping_type: str | None = None,
    expected_ratio: float | None = None,
) -> DataFrame:
    """Compare row counts; a surplus weighs like a loss. Within tolerance is a PASS."""
    plan = plan_volume(Side.of(source), Side.of(target), tolerance_pct, mapping_type, expected_ratio)
    return scalar_rows(source, target, [plan], table)
