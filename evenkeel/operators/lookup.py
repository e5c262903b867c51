"""Attach a keyed lookup to rows whose keys may be skewed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.staging import stage

# A key is hot if it holds more than one part in this many of all rows; so there are fewer such keys than this.
SHARE = 2_000

# Bytes of a key's own value up to which it may be broadcast: with SHARE, 8 MB at most.
KEY_BYTES = 4_096

# Parts over which rows that need no shuffle partner are spread.
SPREAD = 4_096


def _hot(counts: DataFrame, key: str, weight: str, share: int) -> DataFrame:
    """The keys that hold more than one part in ``share`` of the weight: fewer than ``share`` rows."""
    total = counts.agg(F.sum(weight)).first()[0] or 0
    short = F.octet_length(F.col(key).cast("string")) <= KEY_BYTES
    return counts.where((F.col(weight) > int(total) // share) & short)


def attach(rows: DataFrame, lookup: DataFrame, key: str, weight: str, share: int = SHARE) -> DataFrame:
    """Left join of ``rows`` with ``lookup`` (one row per ``key``).

    ``weight`` is the number of rows a key has. Hot keys are broadcast and the rest is joined by shuffle, or as Spark
    finds best for its size. Rows served by the broadcast, and rows without a key, take part in the other join under a
    part number that matches nothing.
    """
    values = [c for c in lookup.columns if c != key]
    hot = _hot(lookup, key, weight, share).select(key, *[F.col(v).alias(f"_hot_{v}") for v in values])
    # zero for every row, but no literal: Spark would turn a join on a literal into a filter, drop it from
    # the join keys and so undo the spreading
    zero = F.when(F.col(weight) < 0, 1).otherwise(0)
    cold = lookup.withColumn("_part", zero)
    spread = F.when(
        F.col(f"_hot_{weight}").isNotNull() | F.col(key).isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)).cast("int") + 1
    ).otherwise(0)
    joined = rows.join(F.broadcast(hot), key, "left").withColumn("_part", spread).join(cold, [key, "_part"], "left")
    filled = {v: F.coalesce(F.col(f"_hot_{v}"), F.col(v)) for v in values}
    return joined.withColumns(filled).drop("_part", *[f"_hot_{v}" for v in values])


def skewed_left_join(left: DataFrame, right: DataFrame, key: str, share: int = SHARE) -> DataFrame:
    """Left join where a key may hold a large part of the left rows.

    The left rows of hot keys are dealt out to parts, as many as their share calls for, and the right rows of those
    keys are copied to every part. Keys are counted before the shuffle.
    """
    counts = stage(left.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")), "key-counts")
    total = counts.agg(F.sum("_rows")).first()[0] or 0
    each = max(1, int(total) // share)
    hot = _hot(counts, key, "_rows", share).select(key, F.ceil(F.col("_rows") / each).cast("int").alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = left.join(F.broadcast(hot), key, "left").withColumn(
        "_part", F.pmod(F.monotonically_increasing_id(), parts).cast("int")
    )
    copied = right.join(F.broadcast(hot), key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.drop("_parts").join(copied.drop("_parts"), [key, "_part"], "left").drop("_part")
