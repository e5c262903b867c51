"""Sinks: quarantined rows, result tables and reports."""

from __future__ import annotations

import datetime as dt
import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.functions.values import quote
from evenkeel.operators import rollup
from evenkeel.operators.quarantine import RULES


def write_quarantine(invalid: DataFrame, path: str, fmt: str = "parquet", mode: str = "append") -> None:
    """Invalid rows with their reasons, partitioned by table and side."""
    if fmt == "csv":
        invalid = invalid.drop(RULES)  # text files hold no arrays
    writer = invalid.write.mode(mode).partitionBy("table_name", "side")
    writer.option("header", "true").format(fmt).save(path)


def write_results(results: DataFrame, path: str, mode: str = "append") -> None:
    """Result rows as parquet, partitioned by run."""
    results.write.mode(mode).partitionBy("run_id").parquet(path)


def content_hash(results: DataFrame, fields: tuple[str, ...] = ("table_name", "check", "column", "status", "message")) -> DataFrame:
    """SHA-256 over the sorted result rows; the same results give the same hash in any order.

    Results are as many as there are checks, so they fit one row.
    """
    line = "concat_ws('|', " + ", ".join(f"coalesce(`{f}`, '')" for f in fields) + ")"
    return results.selectExpr(
        f"sha2(concat_ws('\\n', sort_array(collect_list({line}))), 256) AS content_hash", "count(1) AS results"
    )


def ci_report(results: DataFrame, timestamp: str | None = None) -> DataFrame:
    """One row: verdict, counts by status, time, number of checks."""
    stamp = timestamp or dt.datetime.now(dt.timezone.utc).isoformat()
    return rollup.verdict(results).selectExpr(
        "verdict",
        "named_struct('pass', n_pass, 'warn', n_warn, 'fail', n_fail, 'error', n_error) AS summary",
        f"{quote(stamp)} AS timestamp",
        "total_checks",
    )


def ci_document(results: DataFrame, timestamp: str | None = None) -> dict:
    """The report for a build pipeline as one document, with every check."""
    head = json.loads(ci_report(results, timestamp).toJSON().first())
    checks = results.select("table_name", "check", "column", "status", "message", "details", "metrics", "samples")
    return {**head, "checks": [json.loads(row) for row in checks.toJSON().collect()]}


def exit_code(verdict: str, fail_on_warnings: bool = False) -> int:
    """0 where the migration may go on."""
    if verdict in (rollup.NO_GO, rollup.ERROR_VERDICT):
        return 1
    return int(fail_on_warnings and verdict == rollup.GO_WITH_WARNINGS)


def write_ci_report(results: DataFrame, path: str, timestamp: str | None = None) -> dict:
    document = ci_document(results, timestamp)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(document, f, indent=2, ensure_ascii=False)
    return document


def write_report(results: DataFrame, path: str, client: str = "Client", migration: str = "Source → Target") -> dict:
    """A folder with the result, section and table summaries as JSON lines and one ``summary.json`` row."""
    results = results.persist()
    try:
        results.write.mode("overwrite").json(os.path.join(path, "results"))
        rollup.section_verdicts(results).write.mode("overwrite").json(os.path.join(path, "sections"))
        rollup.table_summary(results).write.mode("overwrite").json(os.path.join(path, "tables"))
        summary = _with_hash(results)
        summary = summary.withColumns(
            {"client": F.lit(client), "migration": F.lit(migration), "date": F.lit(str(dt.date.today()))}
        )
        summary.coalesce(1).write.mode("overwrite").json(os.path.join(path, "summary"))
        return json.loads(summary.toJSON().first())
    finally:
        results.unpersist()


def _with_hash(results: DataFrame) -> DataFrame:
    value = content_hash(results).first()["content_hash"]
    return rollup.verdict(results).withColumn("content_hash", F.lit(value))
