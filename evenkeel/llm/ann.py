"""Approximate nearest neighbours by Euclidean distance: a navigable small-world graph with layers per shard.

Rows are dealt into shards of about equal size by a hash, so copies and dense regions are spread. In a shard equal
vectors are one node, which lists its rows. Nodes stand in the order of a hash; layer 0 holds all of them and each
layer above the first sixteenth of the one below, so a layer is a prefix and its graph one flat array: a row of
neighbours per node, -1 where there is none. Layers are built from the top; one starts as the copy of the layer above,
and further nodes enter in batches. A batch is searched from the top down, all its nodes in step; of the nodes found
and its own mates each keeps those neighbours that are nearer to it than to a neighbour kept before (then the nearest
left), and they list it too.

The index is a table with one row per shard: flat arrays of neighbours, vectors and ids. It covers every row. A query
is searched in every shard, in blocks of queries; the nodes found are measured again in double precision on the
original vectors, and the lists of the shards are merged. Only the graph's candidates are approximate: scores, ties (by
the smaller id) and copies are exact among them.

Vectors that are NULL, empty or zero, or hold NULL or non-finite components take no part, and neither do rows without
an id. Only vectors of one length are compared. A query never meets its own row; rows with equal ids are rows of their
own, and each query row gets its own list. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm import common
from evenkeel.llm.vectors import dealt, finite_rows, matrix, merged, packed, parts

#: Rows of a shard at most, on average; queries of a block.
SHARD_ROWS, QUERY_ROWS = 8_192, 16_384
#: Neighbours of a node (twice as many in layer 0), nodes kept while building and while searching.
LINKS, BUILD, SEARCH = 16, 96, 192
#: A layer holds one of so many nodes of the layer below.
THIN = 16
#: Nodes that enter together, queries that are searched in step, nodes expanded in a step.
BATCH, SLAB, STEP = 256, 256, 4

INDEX = "size int, shard long, layers array<int>, neighbours array<binary>, vectors binary, starts binary, vec_ids binary, rows binary"
FOUND = "query_row long, query_id long, node long, vec_id long, candidate_row long, score double"


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of ``a`` and ``b``, also where squares would leave the range of doubles."""
    difference = a - b
    most = np.abs(difference).max(axis=1, initial=0)
    scale = np.where((most > 1e150) | ((most < 1e-150) & (most > 0)), most, 1.0)
    difference = difference / scale[:, None]
    return np.sqrt((difference * difference).sum(axis=1)) * scale


class Graph:
    """Layers of flat neighbour arrays over the rows of a matrix."""

    def __init__(self, vectors: np.ndarray, neighbours: list[np.ndarray] | None = None):
        self.centre = vectors.mean(axis=0) if len(vectors) else np.zeros(vectors.shape[1])
        self.scale = float(np.abs(vectors - self.centre).max(initial=0)) or 1.0
        self.points = self.moved(vectors)
        self.neighbours = self._built() if neighbours is None else neighbours

    def moved(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors as the graph measures them: around the centre, within the range of short floats."""
        return np.clip((vectors - self.centre) / self.scale, -1e15, 1e15).astype(np.float32)

    def _squares(self, wanted: np.ndarray, rows: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        difference = self.points[nodes]
        difference -= wanted[rows]
        return np.einsum("ij,ij->i", difference, difference)

    def _search(self, layer: np.ndarray, wanted: np.ndarray, entries: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """The nodes of a layer found near each wanted point, nearest first, and their squared distances.

        Missing ones are -1 at an infinite distance. All points take a step together.
        """
        count, degree = len(wanted), layer.shape[1]
        seen = np.zeros((count, len(layer) + 1), bool)
        seen[:, -1] = True  # stands for no node
        lines = np.arange(count)[:, None]
        seen[lines, entries] = True
        flat = self._squares(wanted, np.repeat(np.arange(count), entries.shape[1]), entries.ravel())
        ids = np.full((count, keep), -1, np.int64)
        far = np.full((count, keep), np.inf, np.float32)
        order = np.argsort(flat.reshape(entries.shape), axis=1, kind="stable")[:, :keep]
        ids[:, : order.shape[1]] = entries[lines, order]
        far[:, : order.shape[1]] = flat.reshape(entries.shape)[lines, order]
        fresh = ids >= 0
        while True:
            active = np.flatnonzero(fresh.any(axis=1))
            if not len(active):
                return ids, far
            chosen = fresh[active] & (np.cumsum(fresh[active], axis=1) <= STEP)
            line, place = np.nonzero(chosen)
            fresh[active[line], place] = False
            slot = np.cumsum(chosen, axis=1)[line, place] - 1
            reached = np.full((len(active), STEP, degree), -1, np.int64)
            reached[line, slot] = layer[ids[active[line], place]]
            reached = np.sort(reached.reshape(len(active), -1), axis=1)
            new = ~seen[active[:, None], reached]
            new[:, 1:] &= reached[:, 1:] != reached[:, :-1]
            line, place = np.nonzero(new)
            if not len(line):
                continue
            nodes = reached[line, place]
            seen[active[line], nodes] = True
            reached[~new] = -1
            more = np.full(reached.shape, np.inf, np.float32)
            more[line, place] = self._squares(wanted, active[line], nodes)
            both = np.concatenate([far[active], more], axis=1)
            best = np.argsort(both, axis=1, kind="stable")[:, :keep]
            own = np.arange(len(active))[:, None]
            far[active] = both[own, best]
            ids[active] = np.concatenate([ids[active], reached], axis=1)[own, best]
            fresh[active] = np.concatenate([fresh[active], new], axis=1)[own, best]

    def search(self, wanted: np.ndarray, keep: int, layers: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """From the top layer down: a few entries from each layer to the next, ``keep`` nodes in the last."""
        layers = self.neighbours if layers is None else layers
        entries = np.tile(np.arange(min(len(layers[-1]), THIN)), (len(wanted), 1))
        for layer in layers[:0:-1]:
            entries, _ = self._search(layer, wanted, entries, THIN)
            # a layer may give fewer nodes than asked for; the first stands for those that miss
            entries = np.where(entries < 0, entries[:, :1], entries)
            entries = np.sort(entries, axis=1)
        return self._search(layers[0], wanted, entries[:, :keep], keep)

    def _chosen(self, nodes: np.ndarray, ids: np.ndarray, far: np.ndarray, most: int) -> np.ndarray:
        """Of the candidates of each node, nearest first, those to link: nearer to it than to one kept before, then the rest."""
        out = np.full((len(nodes), most), -1, np.int64)
        for at in range(0, len(nodes), 512):
            some, own = ids[at : at + 512], far[at : at + 512]
            points = self.points[some]
            squares = np.einsum("abi,abi->ab", points, points)
            between = squares[:, :, None] + squares[:, None, :] - 2 * np.matmul(points, points.transpose(0, 2, 1))
            there = np.isfinite(own)
            kept, blocked = np.zeros(some.shape, bool), ~there
            for c in range(some.shape[1]):
                good = ~blocked[:, c] & (kept.sum(axis=1) < most)
                kept[:, c] = good
                blocked |= good[:, None] & (between[:, c] < own)
            order = np.argsort(np.where(kept, 0, np.where(there, 1, 2)), axis=1, kind="stable")[:, :most]
            lines = np.arange(len(some))[:, None]
            out[at : at + 512, : order.shape[1]] = np.where(there[lines, order], some[lines, order], -1)
        return out

    def _link(self, layer: np.ndarray, nodes: np.ndarray, ids: np.ndarray, far: np.ndarray) -> None:
        """Enter ``nodes`` with their candidates, and list them with the neighbours they chose."""
        degree = layer.shape[1]
        own = self._chosen(nodes, ids, far, min(LINKS, degree))
        layer[nodes, : own.shape[1]] = own
        source = np.repeat(nodes, own.shape[1])
        target = own.ravel()
        source, target = source[target >= 0], target[target >= 0]
        square = self._squares(self.points, source, target)
        order = np.lexsort((square, target))
        source, target, square = source[order], target[order], square[order]
        first = np.flatnonzero(np.append(True, target[1:] != target[:-1])) if len(target) else np.zeros(0, np.int64)
        place = np.arange(len(target)) - np.repeat(first, np.diff(np.append(first, len(target))))
        near = place < degree  # farther ones would not stay in a full list
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(target))))
        touched = target[first]
        fresh = np.full((len(touched), int(place[near].max(initial=-1)) + 1), -1, np.int64)
        fresh[group[near], place[near]] = source[near]
        # a mate may have chosen the node already
        old = layer[touched]
        for c in range(fresh.shape[1]):
            fresh[(old == fresh[:, c : c + 1]).any(axis=1), c] = -1
        both = np.concatenate([old, fresh], axis=1)
        both = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), axis=1)
        full = (both >= 0).sum(axis=1) > degree
        layer[touched[~full]] = both[~full, :degree]
        for at in range(0, int(full.sum()), 2_048):
            some, mine = both[full][at : at + 2_048], touched[full][at : at + 2_048]
            square = self._squares(self.points, np.repeat(mine, some.shape[1]), np.maximum(some, 0).ravel()).reshape(some.shape)
            square[some < 0] = np.inf
            order = np.argsort(square, axis=1, kind="stable")
            lines = np.arange(len(some))[:, None]
            layer[mine] = self._chosen(mine, np.maximum(some[lines, order], 0), square[lines, order], degree)

    def _built(self) -> list[np.ndarray]:
        sizes = [len(self.points)]
        while sizes[-1] > 2 * LINKS:
            sizes.append(-(-sizes[-1] // THIN))
        layers: list[np.ndarray] = []  # from the top
        for depth, size in enumerate(reversed(sizes)):
            layer = np.full((size, LINKS * (2 if depth == len(sizes) - 1 else 1)), -1, np.int32)
            done = 1
            if layers:
                above = layers[-1]
                done = len(above)
                layer[:done, :LINKS] = above
            while done < size:
                nodes = np.arange(done, min(size, done + min(BATCH, done)))
                ids, far = self.search(self.points[nodes], BUILD, [layer[:done], *reversed(layers)])
                mates = np.tile(nodes, (len(nodes), 1))
                between = self._squares(self.points, np.repeat(nodes, len(nodes)), mates.ravel()).reshape(mates.shape)
                np.fill_diagonal(between, np.inf)
                ids, far = np.concatenate([ids, mates], axis=1), np.concatenate([far, between], axis=1)
                order = np.argsort(far, axis=1, kind="stable")[:, :BUILD]
                lines = np.arange(len(nodes))[:, None]
                self._link(layer, nodes, np.maximum(ids[lines, order], 0), far[lines, order])
                done = int(nodes[-1]) + 1
            layers.append(layer)
        return layers[::-1]


def _index(pdf: pd.DataFrame) -> pd.DataFrame:
    size = int(pdf["size"].iloc[0])
    # equal vectors are one node; 0.0 and -0.0 are equal
    pdf = pdf.sort_values(["vec_id", "row"], kind="stable")
    values = matrix(pdf.v.tolist(), size) + 0.0
    raw = np.ascontiguousarray(values).view([("", "V8")] * size).ravel() if size else np.zeros(len(pdf), "V1")
    _, first, node, counts = np.unique(raw, return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(pdf.place.to_numpy()[first], kind="stable")  # nodes in the order of a hash
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    members = np.argsort(rank[node], kind="stable")
    starts = np.append(0, np.cumsum(counts[order]))
    vectors = np.ascontiguousarray(values[first[order]])
    graph = Graph(vectors)
    return pd.DataFrame({
        "size": [size], "shard": [int(pdf["shard"].iloc[0])], "layers": [[len(x) for x in graph.neighbours]],
        "neighbours": [[x.astype("<i4").tobytes() for x in graph.neighbours]], "vectors": [vectors.tobytes()],
        "starts": [starts.astype("<i8").tobytes()], "vec_ids": [pdf.vec_id.to_numpy("<i8")[members].tobytes()],
        "rows": [pdf.row.to_numpy("<i8")[members].tobytes()],
    })


def rows_of(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``row, vec_id, size, v``: the vectors that take part, as packed doubles. Staged."""
    rows = finite_rows(vectors, id_col, vector_col).where(F.exists("x", lambda x: x != 0))

    def run(batches):
        for batch in batches:
            columns = [batch.column(c) for c in ("row", "vec_id", "size")]
            yield pa.RecordBatch.from_arrays([*columns, packed(batch.column("x"))], ["row", "vec_id", "size", "v"])

    return common.stage(rows.mapInArrow(run, "row long, vec_id long, size int, v binary"), "vectors")


def build(rows: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The index of ``rows_of(..)``: one row per shard and length of vectors. Staged."""
    shards = parts(rows.count(), shard_rows)
    place = F.xxhash64("row", "vec_id")
    held = rows.withColumn("place", place).withColumn("shard", F.pmod(place, F.lit(shards)))
    return common.stage(held.repartition(shards, "size", "shard").groupBy("size", "shard").applyInPandas(_index, INDEX), "index")


def _searcher(k: int, keep: int):
    def run(key, asked: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        names = [f.split(" ")[0] for f in FOUND.split(", ")]
        if asked.empty or index.empty:
            return pd.DataFrame({n: pd.Series(dtype="float64" if n == "score" else "int64") for n in names})
        held, size = index.iloc[0], int(key[0])
        vectors = np.frombuffer(held.vectors, "<f8").reshape(-1, size)
        layers = [np.frombuffer(x, "<i4").reshape(n, -1) for x, n in zip(held.neighbours, held.layers, strict=True)]
        starts, ids, rows = (np.frombuffer(held[c], "<i8") for c in ("starts", "vec_ids", "rows"))
        graph = Graph(vectors, layers)
        out = []
        for at in range(0, len(asked), SLAB):
            some = asked.iloc[at : at + SLAB]
            wanted = matrix(some.v.tolist(), size)
            found, _ = graph.search(graph.moved(wanted), max(keep, k + 1))
            line, place = np.nonzero(found >= 0)
            nodes = found[line, place]
            score = distances(vectors[nodes], wanted[line])
            # of a node's rows the first k + 1 by id, as one may be the query's own
            count = np.minimum(starts[nodes + 1] - starts[nodes], k + 1)
            member = np.repeat(starts[nodes], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            line, score = np.repeat(line, count), np.repeat(score, count)
            query_row = some.row.to_numpy()[line]
            other = rows[member] != query_row
            line, score, member, query_row = line[other], score[other], member[other], query_row[other]
            order = np.lexsort((rows[member], ids[member], score, line))
            line, score, member, query_row = line[order], score[order], member[order], query_row[order]
            first = np.searchsorted(line, np.arange(len(some)))
            best = np.arange(len(line)) - first[line] < k
            out.append(pd.DataFrame({
                "query_row": query_row[best], "query_id": some.vec_id.to_numpy()[line[best]], "node": int(key[1]),
                "vec_id": ids[member[best]], "candidate_row": rows[member[best]], "score": score[best],
            }))
        return pd.concat(out)

    return run


def search(index: DataFrame, asked: DataFrame, k: int = 10, keep: int = SEARCH, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found for each row ``row, vec_id, size, v`` of ``asked``."""
    blocks = parts(asked.count(), query_rows)
    shards = int(index.agg(F.coalesce(F.max("shard"), F.lit(0))).first()[0]) + 1
    tiles = blocks * shards
    asked = dealt(asked, blocks, "shard", shards, "block").repartition(tiles, "size", "shard", "block")
    each = F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))
    index = index.withColumn("block", F.explode(each)).repartition(tiles, "size", "shard", "block")
    keys = ["size", "shard", "block"]
    lists = asked.groupBy(*keys).cogroup(index.groupBy(*keys)).applyInPandas(_searcher(k, keep), FOUND)
    found = merged(lists, ["query_row", "query_id"], F.struct("score", "vec_id", "candidate_row"), k, shards)
    return found.select("query_id", "rank", F.col("entry.vec_id").alias("vec_id"), F.col("entry.score").alias("score"))


def nearest(
    vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
    shard_rows: int = SHARD_ROWS, keep: int = SEARCH,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows that meet ``queries``, a condition on ``vec_id``, among all rows."""
    rows = rows_of(vectors, id_col, vector_col)
    return search(build(rows, shard_rows), rows.where(queries), k, keep)
