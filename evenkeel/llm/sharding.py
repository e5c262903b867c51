"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups of rows with equal texts stay together. Taken by size, the largest first, a group enters the bin with the least
room that still holds it; bins are kept in a balanced tree by room. One bin packer can't take billions of groups, so
packing goes by levels: a level deals its items into cells of about ``CELL`` items, each task packs its cells into
boxes of a fixed capacity, and boxes are the items of the next level. The last level has at most ``LAST`` items, a
number that doesn't depend on the data, and packs them into the shards. The capacity of the shards is about the
smallest, from the equal share on, for which the items need no more shards than asked for. A group larger than a
shard's share gets a shard of at least its size.

NULL text is the empty text and has size 1. Ids may be NULL or repeated; repeated rows are rows of their own. An empty
table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.llm import common

#: Items of a cell; items that the last level packs at most; items that even shards need there.
CELL, LAST, ENOUGH = 2_000, 20_000, 8_000
#: Rows of a shard that are numbered in one go.
RUN = 20_000


class Rooms:
    """Bins by room, in a B-tree of two levels: leaves of at most ``2 * WIDTH`` bins under their largest rooms."""

    WIDTH = 256

    def __init__(self):
        self.leaves: list[list[tuple[int, int]]] = []
        self.tops: list[tuple[int, int]] = []

    def add(self, room: int, number: int) -> None:
        entry = (room, number)
        if not self.leaves:
            self.leaves, self.tops = [[entry]], [entry]
            return
        at = min(bisect_left(self.tops, entry), len(self.leaves) - 1)
        leaf = self.leaves[at]
        insort(leaf, entry)
        if len(leaf) > 2 * self.WIDTH:
            self.leaves[at : at + 1] = [leaf[: self.WIDTH], leaf[self.WIDTH :]]
            self.tops[at : at + 1] = [leaf[self.WIDTH - 1], leaf[-1]]
        else:
            self.tops[at] = leaf[-1]

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the bin with the least room of at least ``size``; of equal ones the first."""
        at = bisect_left(self.tops, (size, -1))
        if at == len(self.leaves):
            return None
        leaf = self.leaves[at]
        entry = leaf.pop(bisect_left(leaf, (size, -1)))
        if leaf:
            self.tops[at] = leaf[-1]
        else:
            del self.leaves[at], self.tops[at]
        return entry


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item. An item larger than ``capacity`` has a bin of its own."""
    bins, rooms, used = [0] * len(sizes), Rooms(), 0
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        found = rooms.take(sizes[k])
        if found is None:
            found, used = (capacity, used), used + 1
        bins[k] = found[1]
        if found[0] > sizes[k]:
            rooms.add(found[0] - sizes[k], found[1])
    return bins


def into_bins(sizes: list[int], bins: int) -> list[int]:
    """The bin of each item, at most ``bins`` of them, with a capacity as small as was found."""
    if not sizes:
        return []
    low = max(-(-sum(sizes) // bins), max(sizes))
    high, step, found = low, max(1, low // 8192), best_fit_decreasing(sizes, low)
    while max(found) >= bins:
        low, high, step = high + 1, high + step, 2 * step
        found = best_fit_decreasing(sizes, high)
    while low < high:
        middle = (low + high) // 2
        trial = best_fit_decreasing(sizes, middle)
        if max(trial) < bins:
            found, high = trial, middle
        else:
            low = middle + 1
    return found


def _pack_cell(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        boxes = best_fit_decreasing(pdf["bytes"].tolist(), capacity)
        return pd.DataFrame({"key": pdf["key"], "bytes": pdf["bytes"], "box": [f"{pdf['cell'].iloc[0]}-{b}" for b in boxes]})

    return run


def _level(items: DataFrame, count: int, total: int) -> DataFrame:
    """``key, bytes, box``: every item in a box of about as many items as the level needs to shrink."""
    cells = -(-count // CELL)
    capacity = max(1, total * max(4, min(32, count // ENOUGH)) // count)
    dealt = items.withColumn("cell", F.pmod(F.xxhash64("key"), F.lit(cells)))
    return dealt.groupBy("cell").applyInPandas(_pack_cell(capacity), "key string, bytes long, box string")


def group_shards(groups: DataFrame, shards: int, last: int = LAST) -> DataFrame:
    """``key, shard`` for groups ``key, bytes``."""
    spark = groups.sparkSession
    items, levels = common.stage(groups.select("key", "bytes"), "groups"), []
    while True:
        sums = items.agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).first()
        if sums["n"] <= last:
            break
        levels.append(common.stage(_level(items, sums["n"], sums["bytes"]), f"boxes-{len(levels)}"))
        boxes = levels[-1].groupBy(F.col("box").alias("key")).agg(F.sum("bytes").alias("bytes"))
        items = common.stage(boxes, f"items-{len(levels)}")
    rows = sorted((r["key"], r["bytes"]) for r in items.collect())
    found = into_bins([n for _, n in rows], shards)
    placed = [(key, shard) for (key, _), shard in zip(rows, found, strict=True)]
    assigned = F.broadcast(spark.createDataFrame(placed, "key string, shard int"))
    for level in reversed(levels):
        above = assigned.withColumnRenamed("key", "box")
        assigned = level.join(above, "box").select("key", "shard")
    return assigned


def shard(
    docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", last: int = LAST, run: int = RUN
) -> DataFrame:
    """One row per input row: ``doc_id, size, text_crc32, shard, slot``; ``slot`` numbers the rows of a shard from 0."""
    texts = common.text_of(docs, id_col, text_col)
    rows = texts.select(
        common.row_key().alias("row"),
        "doc_id",
        (F.octet_length("text") + 1).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.sha2(F.col("text").cast("binary"), 256).alias("key"),
    )
    rows = common.stage(rows, "sizes")
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"))
    runs = -(-rows.count() // run) or 1
    placed = rows.join(group_shards(groups, shards, last), "key").select(
        "row", "doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("row"), F.lit(runs)).alias("run")
    )
    placed = common.stage(placed, "shards")
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "run").agg(F.count(F.lit(1)).alias("n"))
    starts = starts.select("shard", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("shard", "run").orderBy("doc_id", "row"))
    return placed.withColumn("within", within).join(starts, ["shard", "run"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("within") - 1).alias("slot")
    )
