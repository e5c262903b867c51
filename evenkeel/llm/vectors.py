"""What the operators on vectors share: rows that take part as packed bytes, tiles of queries and shards, merged lists."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm import common

#: Lists of one query that are merged at once.
FAN = 16


def finite_rows(vectors: DataFrame, id_col: str, vector_col: str, factor: float = 1.0, label_col: str | None = None) -> DataFrame:
    """``row, vec_id, size, x``, and ``label`` if asked for: rows whose id, vector and components are there and finite.

    Components are doubles; ``factor`` times a component has to be finite too. ``row`` is fixed only once staged.
    """
    names = [F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("x")]
    if label_col:
        names.append(F.col(f"`{label_col}`").cast("long").alias("label"))
    rows = vectors.select(*names).dropna()
    bad = F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(factor * x) == float("inf")))
    return rows.where(~bad).select(common.row_key().alias("row"), "vec_id", *names[2:] and ["label"], F.size("x").alias("size"), "x")


def packed(column: pa.Array) -> pa.Array:
    """Lists of doubles as their bytes."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    at = column.offsets.to_numpy()
    values = np.ascontiguousarray(column.flatten().to_numpy(False), "<f8")
    offsets = pa.py_buffer(((at - at[0]) * 8).astype(np.int64))
    made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(column), [None, offsets, pa.py_buffer(values)])
    return made.cast(pa.binary())


def matrix(packed_rows: pd.Series | list, size: int) -> np.ndarray:
    """Packed vectors of ``size`` components as the rows of a matrix of doubles."""
    return np.frombuffer(b"".join(packed_rows), "<f8").reshape(len(packed_rows), size)


def dealt(rows: DataFrame, into: int, other: str, others: int, own: str) -> DataFrame:
    """Each row in one of ``into`` parts ``own`` by its hash, whatever its id, and with each of the ``others`` parts ``other``."""
    each = F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))
    return rows.withColumn(own, F.pmod(F.xxhash64("row", "vec_id"), F.lit(into))).withColumn(other, F.explode(each))


def parts(rows: int, most: int) -> int:
    return max(1, -(-rows // most))


def merged(lists: DataFrame, by: Iterable[str], order: Column, k: int, nodes: int) -> DataFrame:
    """``by``, ``rank`` from 1 and ``entry``: the ``k`` first entries of each list, found by merging level by level.

    ``lists`` has ``node`` from 0 to ``nodes - 1``: no group holds more than ``FAN * k`` rows.
    """
    by = [*by]
    lists = lists.select(*by, "node", order.alias("entry"))
    while True:
        lists = lists.withColumn("node", F.expr(f"node div {FAN}"))
        lists = lists.groupBy(*by, "node").agg(F.slice(F.array_sort(F.collect_list("entry")), 1, k).alias("entries"))
        if nodes <= FAN:
            break
        nodes = parts(nodes, FAN)
        lists = lists.select(*by, "node", F.explode("entries").alias("entry"))
    found = lists.select(*by, F.posexplode("entries").alias("place", "entry"))
    return found.select(*by, (F.col("place") + 1).alias("rank"), "entry")
