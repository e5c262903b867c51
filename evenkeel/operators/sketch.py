"""Approximate key overlap and distinct counts from mergeable sketches.

A sketch has a fixed size, so nothing is shuffled but one sketch per task, and sketches of batches
merge. Counts are exact while a side has fewer than ``2 ** LOG_ENTRIES`` distinct keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from evenkeel import results as R
from evenkeel.functions.values import ident, quote
from evenkeel.results import FAIL, PASS, WARN, Finding, case, text

LOG_ENTRIES = 16
#: Standard errors that the stated error of an estimate covers.
DEVIATIONS = 3


def key_sketch(df: DataFrame, key: str) -> DataFrame:
    """One row: rows, null keys and a theta sketch of the keys (as text, so that both sides agree)."""
    k = f"CAST({ident(key)} AS STRING)"
    return key_text_sketch(df, k)


def key_text_sketch(df: DataFrame, k: str) -> DataFrame:
    """The same for an expression that gives the key as text."""
    return df.selectExpr(
        "count(1) AS rows", f"count_if({k} IS NULL) AS nulls",
        f"theta_sketch_agg({k}, {LOG_ENTRIES}) AS sketch",
    )


def merge_sketches(sketches: DataFrame) -> DataFrame:
    return sketches.selectExpr(
        "sum(rows) AS rows", "sum(nulls) AS nulls", f"theta_union_agg(sketch, {LOG_ENTRIES}) AS sketch"
    )


def approximate_overlap(source: DataFrame, target: DataFrame) -> DataFrame:
    """One row from two sketch rows: distinct keys of each side, common keys and the overlap in percent."""
    s = source.selectExpr("sketch AS s", "CAST(NULL AS BINARY) AS t")
    t = target.selectExpr("CAST(NULL AS BINARY) AS s", "sketch AS t")
    both = s.unionByName(t).selectExpr("first(s, true) AS s", "first(t, true) AS t")
    return both.selectExpr(
        "theta_sketch_estimate(s) AS src_keys", "theta_sketch_estimate(t) AS tgt_keys",
        "theta_sketch_estimate(theta_intersection(s, t)) AS common_keys",
    ).selectExpr("*", "coalesce(try_divide(common_keys, src_keys) * 100, 0D) AS overlap_pct")


def overlap_rows(source: DataFrame, target: DataFrame, column: str, table: str, threshold: float = 95.0, run_id: str = "") -> DataFrame:
    """The identity check from two sketch rows, with the error of the overlap.

    Below ``2 ** LOG_ENTRIES`` distinct keys on both sides all counts are exact. Above, a count that a sketch of all keys
    of both sides gives has a standard error of their number over the root of the entries; ``DEVIATIONS`` of these for the
    common keys and for the source's, in percent of the source's keys, are the stated error.
    """
    entries = 2**LOG_ENTRIES
    both = approximate_overlap(source, target).crossJoin(source.selectExpr("nulls AS src_nulls")).crossJoin(target.selectExpr("nulls AS tgt_nulls"))
    error = f"IF(greatest(src_keys, tgt_keys) < {entries}, 0D, try_divide({2 * DEVIATIONS}D * 100 * (src_keys + tgt_keys - common_keys), src_keys * sqrt({entries}D)))"
    facts = both.selectExpr("*", f"coalesce({error}, 0D) AS error_pct")
    status = case((f"overlap_pct >= {quote(float(threshold))}", PASS), ("overlap_pct > 0", WARN), otherwise=FAIL)
    metrics = {
        "overlap_pct": "overlap_pct", "error_pct": "error_pct", "common_keys": "common_keys", "src_keys": "src_keys", "tgt_keys": "tgt_keys",
        "src_null_keys": "src_nulls", "tgt_null_keys": "tgt_nulls",
    }
    message = text("about %.2f %% of the source keys are in the target, within %.2f points", "overlap_pct", "error_pct")
    return R.rows(facts, [Finding("identity", "identity", column, status, message, metrics)], table, run_id)
