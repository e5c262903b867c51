"""Hard negatives by rotated one-bit codes: popcount estimates, intervals that hold for certain, integer scores.

Component x becomes floor(256 * x) with x as double, so scores (inner products) are whole numbers. A vector x is rotated
by a fixed orthogonal matrix P; its code is the signs of P x, a unit vector u, stored with its alignment a = <P x, u> and
what the code leaves out, r = sqrt(|x|^2 - a^2). For an anchor q the part of its score along the code is a * t with
t = <P q, u>. P q is rounded to eight bits, so t comes from popcounts of eight bit planes, up to the sum of what rounding
left over. By the inequality of Cauchy and Schwarz the rest is at most r * sqrt(|q|^2 - t^2). So each score lies in
an interval known without the vector. Rows whose interval cannot reach a place in the list are left out for certain:
the best rows by estimate are scored first, and their scores are the bar. All others are scored in whole numbers.

Anchors and rows meet in tiles of a block of anchors and a shard of rows, both dealt by a hash, so that a hot label is
spread; lists of the shards are merged. A first pass over the tiles finds each anchor's positives, the best other rows
of its label. A second one finds for each positive the best rows of other labels whose score is at least ``low`` and at
most ``high`` hundredths of the positive's.

Rows without an id or label, with a NULL vector, or with NULL or non-finite components (also after the factor) take no
part. Only vectors of one length are compared; empty vectors score 0. Scores beyond 64 bits are set to the
nearest 64-bit number. Rows with equal ids are rows of their own; ties go to the smaller id. An anchor without positives, or
a positive without negatives, gives no rows, and neither does an empty table. Other columns are not looked at.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm import common
from evenkeel.llm.topk import best, products
from evenkeel.llm.vectors import dealt, finite_rows, matrix, merged, packed, parts

FACTOR, BITS = 256.0, 8
#: Anchors of a block and rows of a shard; a tile holds both, and intervals of ``SLAB`` anchors at a time.
ANCHOR_ROWS, SHARD_ROWS, SLAB = 4_096, 16_384, 64
#: Rows scored first, in multiples of what is asked for.
FIRST = 4

ROWS = "row long, vec_id long, label long, size int, v binary, code binary, along double, across double"
POSITIVE = "anchor_row long, anchor_id long, node long, vec_id long, other_row long, score long"
NEGATIVE = "anchor_row long, anchor_id long, positive_row long, positive_id long, positive_score long, node long, vec_id long, other_row long, score long"


@lru_cache(maxsize=4)
def rotation(size: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    return np.linalg.qr(np.random.default_rng(20_261_204).standard_normal((size, size)))[0]


def whole(vectors: np.ndarray) -> np.ndarray:
    return np.floor(FACTOR * vectors)


def coded(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes as 64-bit words, alignments, and lengths of what the codes leave out, for whole vectors."""
    size = vectors.shape[1]
    turned = vectors @ rotation(size) if size else vectors
    bits = np.zeros((len(vectors), -(-size // 64) * 64), bool)
    bits[:, :size] = turned >= 0
    along = np.abs(turned).sum(axis=1) / max(1.0, size**0.5)
    across = np.sqrt(np.maximum((turned * turned).sum(axis=1) - along * along, 0))
    return np.packbits(bits, axis=1, bitorder="little").view("<u8"), along, across


def intervals(anchors: np.ndarray, codes: np.ndarray, along: np.ndarray, across: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Estimates of all scores, and bounds below and above that hold for certain: a row per anchor, a column per code."""
    size = anchors.shape[1]
    if not size:
        none = np.zeros((len(anchors), len(codes)))
        return none, none, none
    turned = anchors @ rotation(size)
    step = np.maximum(np.abs(turned).max(axis=1, keepdims=True), 1e-300) / (2 ** (BITS - 1) - 1)
    rounded = np.rint(turned / step).astype(np.int64)
    shift = 2 ** (BITS - 1)
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
    along_code = np.zeros((len(anchors), len(codes)), np.int64)
    for bit in range(BITS):
        plane = np.zeros((len(anchors), codes.shape[1] * 64), bool)
        plane[:, :size] = (rounded + shift) >> bit & 1
        words = np.packbits(plane, axis=1, bitorder="little").view("<u8")
        for at in range(codes.shape[1]):
            along_code += np.bitwise_count(words[:, at : at + 1] & codes[:, at]).astype(np.int64) << bit
    # a set bit counts as 1, another as -1
    signed = 2 * (along_code - shift * ones) - rounded.sum(axis=1, keepdims=True)
    t = signed * (step / size**0.5)
    slack = np.abs(turned - rounded * step).sum(axis=1, keepdims=True) / size**0.5
    length = (turned * turned).sum(axis=1, keepdims=True)
    rest = np.sqrt(np.maximum(length - np.maximum(np.abs(t) - slack, 0) ** 2, 0))
    # the last term is far above what rounding in doubles can add
    reach = slack * along + rest * across + 1e-9 * np.sqrt(length) * (along + across)
    estimate = t * along
    return estimate, estimate - reach, estimate + reach


def hundredths(scores: np.ndarray, share: int, up: bool) -> np.ndarray:
    """``share`` hundredths of whole scores, to the whole number below or above, without leaving 64 bits."""
    tens, rest = np.divmod(scores, 100)
    return tens * share + (-(-(rest * share) // 100) if up else rest * share // 100)


def leading(
    anchors: np.ndarray, held: np.ndarray, bounds: tuple, allowed: np.ndarray, low: np.ndarray, high: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of the anchor, column and score of the ``k`` best allowed rows whose scores lie from ``low`` to ``high``.

    Columns stand in the order of ties. ``low`` and ``high`` hold one bound per anchor.
    """
    estimate, below, above = bounds
    # no interval is cut off by rounding a 64-bit bound to a double
    possible = allowed & (above >= low[:, None] - 1024.0) & (below <= high[:, None] + 1024.0)
    n = held.shape[0]
    first = min(n, FIRST * k)
    if n > first:
        tried = np.argpartition(np.where(possible, -estimate, np.inf), first - 1, axis=1)[:, :first]
        line = np.repeat(np.arange(len(anchors)), first)
        scores = _paired(anchors, held, line, tried.ravel()).reshape(tried.shape)
        fits = np.take_along_axis(possible, tried, axis=1) & (scores >= low[:, None]) & (scores <= high[:, None])
        bar = np.sort(np.where(fits, scores.astype(np.float64), -np.inf), axis=1)[:, -min(k, first)]
        bar[np.isfinite(bar)] -= 1e-12 * np.abs(bar[np.isfinite(bar)])  # as scores of more than 53 bits were rounded
        possible &= above >= bar[:, None]
    if possible.mean() < 0.05:
        line, column = np.nonzero(possible)
        scores = _paired(anchors, held, line, column)
        fits = (scores >= low[line]) & (scores <= high[line])
        line, column, scores = line[fits], column[fits], scores[fits]
        order = np.lexsort((column, ~scores, line))  # ~x is -x - 1 and never leaves 64 bits
        line, column, scores = line[order], column[order], scores[order]
        place = np.arange(len(line)) - np.searchsorted(line, np.arange(len(anchors)))[line]
        return line[place < k], column[place < k], scores[place < k]
    scores = products(anchors, held)
    fits = possible & (scores >= low[:, None]) & (scores <= high[:, None])
    least = max(int(scores.min(initial=0)) - 1, -(2**63))
    columns = best(np.where(fits, scores, least), k)
    line = np.repeat(np.arange(len(anchors)), columns.shape[1])
    columns = columns.ravel()
    keep = fits[line, columns]
    line, columns = line[keep], columns[keep]
    return line, columns, scores[line, columns]


def _paired(anchors: np.ndarray, held: np.ndarray, line: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Scores of single pairs, in the same whole numbers as ``products``."""
    bound = float(np.abs(anchors).max(initial=0)) * float(np.abs(held).max(initial=0)) * max(1, anchors.shape[1])
    out = np.zeros(len(line), np.int64)
    for at in range(0, len(line), 65_536):
        a, b = anchors[line[at : at + 65_536]], held[column[at : at + 65_536]]
        if bound < 2**53:
            out[at : at + len(a)] = np.einsum("ij,ij->i", a, b).astype(np.int64)
        else:
            out[at : at + len(a)] = [int(products(x[None], y[None])[0, 0]) for x, y in zip(a, b, strict=True)]
    return out


def rows_of(vectors: DataFrame, label: Column | None, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """The rows that take part, with their codes, staged; ``label`` is an expression over ``vec_id`` and ``label``."""
    rows = finite_rows(vectors, id_col, vector_col, FACTOR, label_col)
    if label is not None:
        rows = rows.withColumn("label", label.cast("long"))
    rows = rows.select("row", "vec_id", "label", "size", "x")

    def run(batches):
        for batch in batches:
            raw = packed(batch.column("x")).to_pylist()
            sizes = np.array(batch.column("size").to_pylist(), np.int64)
            found = [None] * len(raw)
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                codes, along, across = coded(whole(matrix([raw[i] for i in own], int(size))))
                for i, code, a, b in zip(own.tolist(), codes, along.tolist(), across.tolist(), strict=True):
                    found[i] = code.tobytes(), a, b
            made = [pa.array([f[j] for f in found], kind) for j, kind in enumerate((pa.binary(), pa.float64(), pa.float64()))]
            front = [batch.column(c) for c in ("row", "vec_id", "label", "size")]
            names = [f.split(" ")[0] for f in ROWS.split(", ")]
            yield pa.RecordBatch.from_arrays([*front, pa.array(raw, pa.binary()), *made], names)

    return common.stage(rows.mapInArrow(run, ROWS), "coded")


def _tile(pick, columns: str):
    """A task's part: the anchors of a block against the rows of a shard."""

    def run(key, asked: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        parts_of, size = [], int(key[0])
        if len(asked) and len(shard):
            shard = shard.sort_values(["vec_id", "row"])
            held = whole(matrix(shard.v.tolist(), size))
            codes = np.frombuffer(b"".join(shard.code), "<u8").reshape(len(shard), -1)
            along, across = shard.along.to_numpy(), shard.across.to_numpy()
            labels, rows, ids = shard.label.to_numpy(), shard.row.to_numpy(), shard.vec_id.to_numpy()
            for at in range(0, len(asked), SLAB):
                some = asked.iloc[at : at + SLAB]
                anchors = whole(matrix(some.v.tolist(), size))
                bounds = intervals(anchors, codes, along, across)
                same = some.label.to_numpy()[:, None] == labels
                for line, column, score, extra in pick(some, anchors, held, bounds, same, rows):
                    frame = {"anchor_row": some.row.to_numpy()[line], "anchor_id": some.vec_id.to_numpy()[line], **extra}
                    frame |= {"node": int(key[1]), "vec_id": ids[column], "other_row": rows[column], "score": score}
                    parts_of.append(pd.DataFrame(frame))
        names = [f.split(" ")[0] for f in columns.split(", ")]
        return pd.concat(parts_of)[names] if parts_of else pd.DataFrame({n: pd.Series(dtype="int64") for n in names})

    return run


def _tiles(asked: DataFrame, rows: DataFrame, pick, columns: str, shards: int, blocks: int) -> DataFrame:
    keys, tiles = ["size", "shard", "block"], shards * blocks
    asked = dealt(asked, blocks, "shard", shards, "block").repartition(tiles, *keys)
    held = dealt(rows, shards, "block", blocks, "shard").repartition(tiles, *keys)
    return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(_tile(pick, columns), columns)


def hard_negatives(
    vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    label: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    anchor_rows: int = ANCHOR_ROWS, shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchors`` is a condition on ``vec_id``, ``label`` an expression that replaces the label.
    """
    rows = rows_of(vectors, label, id_col, vector_col, label_col)
    asked = common.stage(rows.where(anchors).select("row", "vec_id", "label", "size", "v"), "anchors")
    shards, blocks = parts(rows.count(), shard_rows), parts(asked.count(), anchor_rows)

    def pick_positives(some, a, held, bounds, same, held_rows):
        wanted = same & (some.row.to_numpy()[:, None] != held_rows)
        least, most = np.full(len(some), -(2**63)), np.full(len(some), 2**63 - 1)
        yield *leading(a, held, bounds, wanted, least, most, positives), {}

    order = F.struct((-F.col("score").cast("decimal(20,0)")).alias("s"), "vec_id", "other_row", "score")
    found = _tiles(asked, rows, pick_positives, POSITIVE, shards, blocks)
    found = merged(found, ["anchor_row"], order, positives, shards)
    entry = F.struct("rank", "entry.other_row", "entry.vec_id", "entry.score")
    lists = found.groupBy(F.col("anchor_row").alias("row")).agg(F.array_sort(F.collect_list(entry)).alias("p"))
    columns = [F.col(f"p.{c}").alias(f"p_{c}") for c in ("other_row", "vec_id", "score")]
    asked = asked.join(lists.select("row", *columns), "row")
    asked = common.stage(asked, "anchors-with-positives")

    def pick_negatives(some, a, held, bounds, same, held_rows):
        count = some.p_score.map(len).to_numpy()
        for j in range(int(count.max(initial=0))):
            own = np.flatnonzero(count > j)
            row, vec_id, score = (np.array([x[j] for x in some[c].iloc[own]], np.int64) for c in ("p_other_row", "p_vec_id", "p_score"))
            least, most = hundredths(score, low, True), hundredths(score, high, False)
            line, column, got = leading(a[own], held, tuple(x[own] for x in bounds), ~same[own], least, most, negatives)
            yield own[line], column, got, {"positive_row": row[line], "positive_id": vec_id[line], "positive_score": score[line]}

    found = _tiles(asked, rows, pick_negatives, NEGATIVE, shards, blocks)
    by = ["anchor_row", "anchor_id", "positive_row", "positive_id", "positive_score"]
    found = merged(found, by, order, negatives, shards)
    return found.select(
        "anchor_id", "positive_id", "rank", F.col("entry.vec_id").alias("negative_id"), "positive_score", F.col("entry.score").alias("negative_score")
    )


ORACLE = """
WITH raw AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings
), rows AS (
  SELECT r, vec_id, label, list_transform(x, lambda c: floor(256 * c)) AS v FROM raw
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scored AS (
  SELECT a.r, a.vec_id AS anchor_id, o.r AS other_r, o.vec_id, a.label = o.label AS same,
    CAST(list_inner_product(a.v, o.v) AS BIGINT) AS score
  FROM rows a JOIN rows o ON a.r <> o.r AND len(a.v) = len(o.v) WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, other_r) AS place FROM scored WHERE same)
  WHERE place <= 5
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.r, p.other_r ORDER BY n.score DESC, n.vec_id, n.other_r) AS rank
  FROM positives p JOIN scored n ON p.r = n.r AND NOT n.same
  WHERE 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
) WHERE rank <= 3
"""
