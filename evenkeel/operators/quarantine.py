"""Rows that break the rules of a table, with every reason.

A row is named by its file and its place there, from 0, which do not depend on how files are split into tasks: parquet tells
the row index; for delimited text the rows before each stretch of a file are counted, and added to the place in the
stretch. Other frames have no files; their rows are numbered as they come.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.config import TableConfig
from evenkeel.functions import values as V
from evenkeel.functions.values import ident, quote
from evenkeel.operators.facts import Side
from evenkeel.operators.lookup import attach
from evenkeel.staging import stage

ERRORS = "_validation_errors"
RULES = "_broken_rules"
ROW_INDEX, ROW_FILE = "_row_index", "_row_file"


@dataclass(frozen=True)
class Reason:
    """A rule a row can break: its code, the condition, and the text shown for the row."""

    code: str
    broken: str
    text: str


def _reasons(side: Side, table: TableConfig, is_source: bool) -> list[Reason]:
    """Other than in the checks of a whole table, a missing value is no bad date and no value that is
    not allowed."""
    out = []
    for column, rules in table.data_constraints.items():
        if column not in side:
            continue
        rules = [rules] if isinstance(rules, str) else rules
        value, text = side.col(column), side.text(column)
        blank = f"({value} IS NULL OR {text} = '')"
        if "not_null" in rules:
            out.append(Reason(f"{column}:not_null", blank, quote(f"{column} is null")))
        if "date" in rules:
            parsed = V.to_timestamp(value, side.dtype(column))
            out.append(
                Reason(
                    f"{column}:date", f"(NOT {blank} AND {parsed} IS NULL)",
                    f"concat({quote(f'{column} is no date: ')}, {text})",
                )
            )
    if not is_source:
        for rule in table.mappings:
            allowed = [str(a) for a in rule.allowed_values]
            for column in rule.columns:
                if column in side:
                    text = side.text(column)
                    out.append(
                        Reason(
                            f"{column}:allowed", f"({text} IS NOT NULL AND NOT {V.is_any(text, allowed)})",
                            f"concat({quote(f'{column} has a value that is not allowed: ')}, {text})",
                        )
                    )
    return out


def positioned(df: DataFrame) -> DataFrame:
    """Add ``_row_file`` and ``_row_index``, the file and the place of each row in it."""
    if _has(df, "_metadata.row_index"):
        return df.select("*", F.col("_metadata.file_path").alias(ROW_FILE), F.col("_metadata.row_index").alias(ROW_INDEX))
    if _has(df, "_metadata.file_block_start"):
        return _text_positions(df)
    return df.select("*", F.lit(None).cast("string").alias(ROW_FILE), F.monotonically_increasing_id().alias(ROW_INDEX))


def _has(df: DataFrame, field: str) -> bool:
    try:
        df.select(field).schema  # resolved here, nothing runs
        return True
    except AnalysisException:
        return False


def _text_positions(df: DataFrame) -> DataFrame:
    """For text: the rows of a stretch of a file are read in order by one task, and stretches stand in the order of bytes.

    One pass counts the rows of every stretch, a few numbers per task. The list is as long as the table has stretches of
    ``spark.sql.files.maxPartitionBytes``, and is joined as Spark finds best.
    """
    place = F.monotonically_increasing_id()
    named = df.select("*", F.col("_metadata.file_path").alias(ROW_FILE), F.col("_metadata.file_block_start").alias("_start"), place.alias("_place"))
    stretches = stage(named.groupBy(ROW_FILE, "_start").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n")), "stretches")
    before = Window.partitionBy(ROW_FILE).orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    stretches = stretches.select(ROW_FILE, "_start", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    found = named.join(stretches, [ROW_FILE, "_start"])
    return found.select(*[F.col(ident(c)) for c in df.columns], ROW_FILE, (F.col("_before") + F.col("_place") - F.col("_first")).alias(ROW_INDEX))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once: ``(key, rows)``. Counted before the shuffle, so skew does not matter."""
    counts = df.where(f"{ident(key)} IS NOT NULL").groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    return counts.where("rows > 1")


def mark_duplicates(df: DataFrame, key: str, order_by: Sequence[str] = ()) -> DataFrame:
    """Add ``_duplicate``: true for every row of a key but the first.

    First is the lowest by ``order_by``, then by position. Only rows whose key repeats are written to the
    staging folder; all others pass through without a shuffle of the table.
    """
    repeated = stage(duplicate_keys(df, key), "duplicate-keys")
    if repeated.isEmpty():
        return df.withColumn("_duplicate", F.lit(False))
    place = [ROW_FILE, ROW_INDEX]
    known = set(place) <= set(df.columns)
    marked = attach(df if known else positioned(df), repeated.withColumnRenamed("rows", "_rows"), key, "_rows")
    marked = marked if known else marked.withColumnsRenamed({c: "_at" + c for c in place})
    position = place if known else ["_at" + c for c in place]
    dropped = [] if known else position
    single = marked.where("_rows IS NULL").drop("_rows", *dropped).withColumn("_duplicate", F.lit(False))
    several = stage(marked.where("_rows IS NOT NULL"), "duplicate-rows")
    order = "struct(" + ", ".join([*map(ident, order_by), *position]) + ")"
    firsts = several.groupBy(key).agg(F.expr(f"min({order})").alias("_first"), F.count(F.lit(1)).alias("_n"))
    several = (
        attach(several, firsts, key, "_n")
        .withColumn("_duplicate", F.expr(f"{order} <> _first"))
        .drop("_rows", "_first", "_n", *dropped)
    )
    return single.unionByName(several)


def validate_rows(df: DataFrame, table: TableConfig, is_source: bool = True) -> DataFrame:
    """Add ``_validation_errors``, every reason joined by ``"; "`` or NULL for a valid row, and
    ``_broken_rules``, the codes of the rules."""
    checked, reasons = _test_rules(df, table, is_source)
    return _explain(checked, reasons)


def _test_rules(df: DataFrame, table: TableConfig, is_source: bool) -> tuple[DataFrame, list[Reason]]:
    """A boolean column per rule. The costly tests run here once; everything after reads the columns."""
    side = Side.of(df)
    reasons = _reasons(side, table, is_source)
    key = table.primary_key
    if not is_source and key in side:
        df = mark_duplicates(df, key, [c for c in table.order_by if c in side])
        text = f"concat({quote(f'duplicate key in {key}: ')}, {side.text(key)})"
        reasons.append(Reason(f"{key}:duplicate", "_duplicate", text))
    tests = [f"coalesce({r.broken}, false) AS _rule_{i}" for i, r in enumerate(reasons)]
    return df.selectExpr("*", *tests).drop("_duplicate"), reasons


def _explain(checked: DataFrame, reasons: list[Reason]) -> DataFrame:
    texts = ", ".join(["'; '", *[f"CASE WHEN _rule_{i} THEN {r.text} END" for i, r in enumerate(reasons)]])
    codes = ", ".join(f"CASE WHEN _rule_{i} THEN {quote(r.code)} END" for i, r in enumerate(reasons))
    return checked.selectExpr(
        "*", f"nullif(concat_ws({texts}), '') AS {ERRORS}",
        f"array_compact(CAST(array({codes}) AS array<string>)) AS {RULES}",
    ).drop(*_test_columns(reasons))


def _test_columns(reasons: list[Reason]) -> list[str]:
    return [f"_rule_{i}" for i in range(len(reasons))]


def split(df: DataFrame, table: TableConfig, is_source: bool = True) -> tuple[DataFrame, DataFrame]:
    """(valid rows, invalid rows with their reasons)."""
    checked, reasons = _test_rules(df, table, is_source)
    tests = _test_columns(reasons)
    broken = " OR ".join(tests) or "false"
    valid = checked.where(f"NOT ({broken})").drop(*tests)
    return valid, _explain(checked.where(broken), reasons)


def quarantine(
    df: DataFrame, table: TableConfig, name: str, is_source: bool = True, path: str = ""
) -> tuple[DataFrame, DataFrame]:
    """(valid rows, invalid rows as they go to the quarantine: with file and place there, table, side and path)."""
    valid, bad = split(positioned(df), table, is_source)
    bad = bad.withColumns(
        {"table_name": F.lit(name), "side": F.lit("source" if is_source else "target"), "path": F.lit(path)}
    )
    return valid.drop(ROW_FILE, ROW_INDEX), bad


def quarantine_summary(bad: DataFrame) -> DataFrame:
    """Invalid rows per table and side."""
    return bad.groupBy("table_name", "side").agg(F.count(F.lit(1)).alias("rows"))


def rule_summary(bad: DataFrame) -> DataFrame:
    """Invalid rows per broken rule; a row that breaks two rules counts under both."""
    rules = bad.select("table_name", "side", F.explode(RULES).alias("rule"))
    return rules.groupBy("table_name", "side", "rule").agg(F.count(F.lit(1)).alias("rows"))
