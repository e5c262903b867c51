"""What several operators of this folder need: reading tables, staging, row keys."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.staging import stage

__all__ = ["arrow_rows", "digest", "row_key", "stage", "table", "text_of", "whole_text"]

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: White space as the exact comparison of texts sees it.
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def arrow_rows(spark: SparkSession, most: int = 1_000) -> Iterator[None]:
    """Jobs that end in here hand rows to Python workers in batches of at most so many: rows with whole texts are large."""
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(min(most, int(before)) if int(before) > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


def whole_text(column: str) -> Column:
    """The whole text of a column; NULL is the empty text."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def text_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only ``doc_id`` and ``text`` under fixed names, so that no other column can clash."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), whole_text(text_col).alias("text"))


def row_key() -> Column:
    """A number per row; it is fixed only once the rows are staged."""
    return F.monotonically_increasing_id()


def digest(text: Column) -> Column:
    """SHA-256 in lowercase hex of a text whose white space runs are one space."""
    return F.sha2(F.regexp_replace(text, BLANKS, " ").cast("binary"), 256)
