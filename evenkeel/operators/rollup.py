"""From result rows to verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GO, GO_WITH_WARNINGS, NO_GO, ERROR_VERDICT = "GO", "GO WITH WARNINGS", "NO-GO", "ERROR"

# Category of a result -> section of the report.
SECTIONS = {
    "volume": "Data Volume Checks",
    "identity": "Identity Checks",
    "aggregates": "Aggregate Checks",
    "mappings": "Mapping Checks",
    "relationships": "Relationship Checks",
    "data_constraints": "Data Constraint Checks",
    "string": "String Data Quality Checks",
    "enum": "Enum & Categorical Checks",
    "datetime": "Datetime & Timezone Checks",
    "null_sentinel": "Null & Sentinel Value Checks",
    "numeric_precision": "Numeric Precision Checks",
    "boolean": "Boolean Normalization Checks",
}
GENERAL = "General Checks"


def _counts() -> list:
    return [F.expr(f"count_if(status = '{s}')").alias(f"n_{s.lower()}") for s in ("PASS", "WARN", "FAIL", "ERROR")]


def verdict(results: DataFrame) -> DataFrame:
    """One row. No result is NO-GO; then ERROR, FAIL and WARN decide in this order."""
    return results.agg(F.count(F.lit(1)).alias("total_checks"), *_counts()).selectExpr(
        f"CASE WHEN total_checks = 0 THEN '{NO_GO}' WHEN n_error > 0 THEN '{ERROR_VERDICT}'"
        f" WHEN n_fail > 0 THEN '{NO_GO}' WHEN n_warn > 0 THEN '{GO_WITH_WARNINGS}' ELSE '{GO}' END AS verdict",
        "total_checks", "n_pass", "n_warn", "n_fail", "n_error",
    ).selectExpr("*", f"verdict IN ('{GO}', '{GO_WITH_WARNINGS}') AS allowed")


def final_verdict(results: DataFrame) -> str:
    return verdict(results).first()["verdict"]


def is_migration_allowed(outcome: str) -> bool:
    return outcome in (GO, GO_WITH_WARNINGS)


def with_section(results: DataFrame) -> DataFrame:
    whens = " ".join(f"WHEN '{c}' THEN '{s}'" for c, s in SECTIONS.items())
    return results.withColumn("section", F.expr(f"CASE category {whens} ELSE '{GENERAL}' END"))


def section_verdicts(results: DataFrame) -> DataFrame:
    """Worst status of every section that has results."""
    worst = "element_at(array('PASS', 'WARN', 'FAIL', 'ERROR'), max(severity) + 1)"
    return with_section(results).groupBy("section").agg(
        F.expr(worst).alias("section_verdict"), F.count(F.lit(1)).alias("checks"), *_counts()
    )


def table_summary(results: DataFrame) -> DataFrame:
    """Results by status for every table."""
    return results.groupBy("table_name").agg(F.count(F.lit(1)).alias("checks"), *_counts())
