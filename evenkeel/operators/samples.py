"""A few offending values for results that failed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.functions.values import ident


def offending_values(df: DataFrame, predicate: str, column: str, order_by: str, n: int = 5) -> DataFrame:
    """The first ``n`` rows that meet the predicate: ``(order_by, column)``. Each task keeps only ``n``."""
    return df.where(predicate).select(ident(order_by), ident(column)).orderBy(ident(order_by)).limit(n)


def sample_rows(df: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """A share of the rows chosen by the MD5 of their key: the same rows for any partitioning, in any engine."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(ident(key)).cast("string"), F.lit("")))
    return df.where(F.left(F.md5(text.cast("binary")), F.lit(8)) < f"{min(int(share * 2**32), 2**32 - 1):08x}")


def smallest_rows(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """Exactly ``n`` rows (all, if fewer): those whose keys have the smallest hashes, the same for any partitioning.

    Each task keeps ``n`` rows, so this is for samples that fit a task. Samples of parts merge: the sample of their union is the
    sample of the whole. Rows of a key stand in the order of their values, with NULL first.
    """
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(ident(key)).cast("string"), F.lit("")))
    values = F.to_json(F.struct(*[F.col(ident(c)) for c in df.columns]), {"ignoreNullFields": "false"})
    return df.orderBy(F.md5(text.cast("binary")), F.col(ident(key)).asc_nulls_first(), values).limit(n)
