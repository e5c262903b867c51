"""Exact top-k search by inner product: tiles of queries and shards, partial selection, tree merging.

Component x becomes floor(64 * x) with x as double, so scores are whole numbers. Queries and candidates are dealt into
blocks of about equal size, whatever their ids are; a tile is one query block against one shard. Each tile is one
matrix product, from which every query keeps its ``k`` best candidates. The lists of a query are then merged ``FAN``
at a time, level by level, so that no group holds more than ``FAN * k`` rows.

The products are exact: in floating point where all sums stay below 2**53, else in integers. Scores beyond 64 bits
are set to the nearest 64-bit number.

Vectors that are NULL, or hold NULL or non-finite components (also after the factor 64), take no part, and neither do rows without an id. Only
vectors of one length are compared; empty vectors score 0 with each other. A query never meets its own row; repeated
rows are rows of their own, and a repeated query row gets its own list. Ties go to the smaller id. An empty table
gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm import common

#: Rows of a query block and of a shard; a tile holds both, and scores of ``SLAB`` queries at a time.
QUERY_ROWS, SHARD_ROWS, SLAB = 2048, 4096, 256
#: Lists that are merged at once.
FAN = 16

FOUND = "query_row long, query_id long, node long, vec_id long, candidate_row long, score long"


def taking_part(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``row, vec_id, size, v``: the vectors that take part, staged."""
    column = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), column.alias("x"))
    bad = F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(64 * x) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull()).where(~bad)
    rows = rows.select(common.row_key().alias("row"), "vec_id", F.size("x").alias("size"), F.col("x").alias("v"))
    return common.stage(rows, "vectors")


def matrix(vectors: pd.Series) -> np.ndarray:
    """The quantized vectors, whole numbers in doubles: ``floor`` of a double is exact at any size."""
    return np.floor(64 * np.array(vectors.tolist(), dtype=np.float64).reshape(len(vectors), -1))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` for matrices of whole numbers, as 64-bit integers."""
    if not a.shape[1]:
        return np.zeros((len(a), len(b)), np.int64)
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if bound < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    exact = whole(a).astype(object) @ whole(b).astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` highest scores of each row; of equal ones the first columns."""
    n = scores.shape[1]
    if n <= k:
        return np.tile(np.arange(n), (len(scores), 1))
    if float(np.abs(scores).max(initial=0)) * n < 2**62:
        keys = scores * n - np.arange(n)
        return np.argpartition(-keys, k - 1, axis=1)[:, :k]
    return np.argsort(-scores.astype(object), axis=1, kind="stable")[:, :k]


def _tile(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        shard, own = pdf[~pdf.is_query], pdf[pdf.is_query]
        if len(shard) and len(own):
            shard = shard.sort_values(["vec_id", "row"])
            ids, rows = shard.vec_id.to_numpy(), shard.row.to_numpy()
            held = matrix(shard.v)
            for at in range(0, len(own), SLAB):
                some = own.iloc[at : at + SLAB]
                scores = products(matrix(some.v), held)
                # k + 1, as a query's own row may be among them
                columns = best(scores, k + 1)
                lines = np.repeat(np.arange(len(some)), columns.shape[1])
                columns = columns.ravel()
                query_row = some.row.to_numpy()[lines]
                keep = rows[columns] != query_row
                lines, columns, query_row = lines[keep], columns[keep], query_row[keep]
                parts.append(pd.DataFrame({
                    "query_row": query_row, "query_id": some.vec_id.to_numpy()[lines], "node": int(pdf.shard.iloc[0]),
                    "vec_id": ids[columns], "candidate_row": rows[columns], "score": scores[lines, columns],
                }))
        names = [f.split(" ")[0] for f in FOUND.split(", ")]
        return pd.concat(parts) if parts else pd.DataFrame({n: pd.Series(dtype="int64") for n in names})

    return run


def top_k(
    vectors: DataFrame,
    queries,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    query_rows: int = QUERY_ROWS,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best rows for each row that meets the condition ``queries``.

    ``queries`` is a condition on ``vec_id``.
    """
    rows = taking_part(vectors, id_col, vector_col)
    sizes = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(queries).alias("queries")).first()
    blocks, shards = -(-sizes["queries"] // query_rows) or 1, -(-sizes["rows"] // shard_rows) or 1
    place = F.xxhash64("row", "vec_id")
    asked = rows.where(queries).withColumn("block", F.pmod(place, F.lit(blocks)))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    held = rows.withColumn("shard", F.pmod(place, F.lit(shards)))
    held = held.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    names = ["block", "shard", "size", "row", "vec_id", "v"]
    both = asked.select(*names, F.lit(True).alias("is_query")).unionByName(held.select(*names, F.lit(False).alias("is_query")))
    lists = both.groupBy("block", "shard", "size").applyInPandas(_tile(k), FOUND)
    order = F.struct((-F.col("score").cast("decimal(20,0)")).alias("s"), "vec_id", "candidate_row", "score")
    nodes = shards
    lists = lists.select("query_row", "query_id", "node", order.alias("entry"))
    while True:
        last = nodes <= FAN
        lists = lists.withColumn("node", F.expr(f"node div {FAN}"))
        lists = lists.groupBy("query_row", "query_id", "node").agg(
            F.slice(F.array_sort(F.collect_list("entry")), 1, k).alias("entries")
        )
        if last:
            break
        nodes = -(-nodes // FAN)
        lists = lists.select("query_row", "query_id", "node", F.explode("entries").alias("entry"))
    return lists.select("query_id", F.posexplode("entries").alias("place", "entry")).select(
        "query_id", (F.col("place") + 1).alias("rank"), F.col("entry.vec_id").alias("vec_id"), F.col("entry.score").alias("score")
    )


ORACLE = """
WITH raw AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings
), vectors AS (
  SELECT r, vec_id, list_transform(x, lambda c: floor(64 * c)) AS v FROM raw
  WHERE vec_id IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score, c.r AS cr
  FROM vectors q JOIN vectors c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, cr) AS rank FROM scored
) WHERE rank <= 20
"""
