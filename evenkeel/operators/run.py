"""Evaluate scalar checks and return result rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from evenkeel import results as R
from evenkeel.operators import facts as A

Measure = Callable[[str, Sequence[A.Metric]], DataFrame]  # (side, metrics) -> one row


def scalar_parts(
    spark: SparkSession, measure: Measure, checks: Sequence[A.ScalarCheck], table: str, run_id: str = ""
) -> list[DataFrame]:
    """Shape 1: one aggregate per side (per 48 metrics), no shuffle of data rows."""
    parts = []
    for batch in A.batches(checks):
        scope = R.Scope()
        found = A.findings(batch, scope)
        if not found:
            continue
        metrics = {
            "source": A.unique([m for c in batch for m in c.source]),
            "target": A.unique([m for c in batch for m in c.target]),
        }
        sides = [measure(side, wanted) for side, wanted in metrics.items() if wanted]
        if len(sides) == 2:
            facts = A.pair(*sides)
        elif sides:
            facts = sides[0].selectExpr(f"struct(*) AS {'s' if metrics['source'] else 't'}")
        else:
            facts = R.one_row(spark)
        parts.append(R.rows(facts, found, table, run_id, scope))
    return parts


def scalar_rows(
    source: DataFrame, target: DataFrame, checks: Sequence[A.ScalarCheck], table: str, run_id: str = ""
) -> DataFrame:
    """Result rows of scalar checks over two frames."""
    frames = {"source": source, "target": target}
    spark = source.sparkSession
    return R.union(
        spark, scalar_parts(spark, lambda side, metrics: A.measure(frames[side], metrics), checks, table, run_id)
    )
