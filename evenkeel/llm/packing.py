"""Hierarchical packing of tokenized documents into windows of several lengths.

Each task reads its documents once, encodes them and packs them as they come:

1. full windows are cut off a document; what is left is routed to the smallest tier that holds it;
2. each tier is packed, the longest first. A piece opens a window, and its gap takes the longest piece of the shorter
   tiers that fits, again and again. If none fits, the shortest of the others is cut to fill the gap, and what is left
   of it is routed anew. So every window is filled;
3. sequences of a tier are dealt to step groups of equal token count in order of their attention cost (the sum of
   squared piece lengths), forwards and backwards in turn, so that groups cost about the same. Full windows of long
   documents are dealt along with the others; sequences beyond the last whole group wait for the next ones, so a task
   has one group of fewer tokens per tier at most.

Less than one window is left over per task. These pieces, with their ids, are packed again by groups of ``FAN`` tasks,
and so on; in the end one sequence of the whole table may be padded. No document is shuffled, and memory is bounded by
``POOL`` tokens of pieces that wait and the longest document.

NULL text is the empty text: a document of the end id alone. Repeated rows are packed each on its own; NULL ids are
kept. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm import common, tokens

#: Context sizes; the longest is the window that gaps are filled in first.
TIERS = (256, 512, 1024, 2048)
#: Tokens of pieces that a task gathers before it packs them.
POOL = 1_000_000
#: Tokens of a step group.
STEP = 32_768
#: Leftovers of so many tasks are packed together.
FAN = 64


class Piece:
    __slots__ = ("doc", "start", "ids", "total")

    def __init__(self, doc, start: int, ids: np.ndarray, total: int):
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def cut(self, at: int) -> tuple[Piece, Piece]:
        tail = Piece(self.doc, self.start + at, self.ids[at:], self.total)
        return Piece(self.doc, self.start, self.ids[:at], self.total), tail


class Pool:
    """Waiting pieces by length."""

    def __init__(self, pieces):
        self.order = sorted((len(p.ids), k) for k, p in enumerate(pieces))
        self.pieces = list(pieces)

    def __len__(self) -> int:
        return len(self.order)

    def add(self, piece: Piece) -> None:
        insort(self.order, (len(piece.ids), len(self.pieces)))
        self.pieces.append(piece)

    def _take(self, at: int) -> Piece:
        _, k = self.order.pop(at)
        piece, self.pieces[k] = self.pieces[k], None
        return piece

    def longest(self) -> Piece:
        return self._take(-1)

    def longest_length(self) -> int:
        return self.order[-1][0] if self.order else 0

    def filling(self, gap: int, below: int) -> Piece:
        """For a gap: the longest piece that fits, if none then the shortest; pieces up to ``below`` come first."""
        at = bisect_right(self.order, (min(gap, below), len(self.pieces))) - 1
        if at >= 0:
            return self._take(at)
        return self._take(bisect_left(self.order, (min(gap, below) + 1, -1)))


def pack_pieces(pieces: list[Piece], tiers=TIERS) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """Filled windows ``(tier, pieces)``, and the pieces of the one window that couldn't be filled."""
    pool, filled, window = Pool(pieces), [], max(tiers)
    while len(pool):
        longest = pool.longest_length()
        tier = min((t for t in tiers if t >= longest), default=window)
        shorter = max((t for t in tiers if t < tier), default=tier)
        parts, gap = [], tier
        while gap and len(pool):
            piece = pool.filling(gap, shorter) if parts else pool.longest()
            if len(piece.ids) > gap:
                piece, rest = piece.cut(gap)
                pool.add(rest)
            parts.append(piece)
            gap -= len(piece.ids)
        if gap:
            return filled, parts
        filled.append((tier, parts))
    return filled, []


def step_groups(filled: list[tuple[int, list[Piece]]], step: int, last: bool = False) -> list[int | None]:
    """The step group of each window: groups of one tier hold equal token counts and have about equal cost.

    Windows beyond the last whole group of their tier get none, or one group of their own if they are the ``last``.
    """
    groups, used = [None] * len(filled), 0
    for tier in sorted({t for t, _ in filled}):
        own = [k for k, (t, _) in enumerate(filled) if t == tier]
        most = max(1, step // tier)
        n = len(own) // most
        whole, rest = own[: n * most], own[n * most :]
        whole.sort(key=lambda k: -sum(len(p.ids) ** 2 for p in filled[k][1]))
        for place, k in enumerate(whole):
            turn, at = divmod(place, n)
            groups[k] = used + (at if turn % 2 == 0 else n - 1 - at)
        used += n
        if last and rest:
            for k in rest:
                groups[k] = used
            used += 1
    return groups


class Packer:
    """The packing of one task."""

    def __init__(self, cell: int, base: int, window: int, tiers, step: int, pool: int, keep_ids: bool):
        self.cell, self.base, self.window, self.tiers = cell, base, window, tiers
        self.step, self.most, self.keep_ids = step, pool, keep_ids
        self.waiting: list[Piece] = []
        self.full: list[tuple[int, list[Piece]]] = []
        self.tokens = self.sequences = self.groups = 0
        self.rows: list[tuple] = []

    def _emit(self, parts: list[Piece], tier: int, group: int) -> None:
        offset, sequence = 0, self.base + self.sequences
        self.sequences += 1
        for p in parts:
            raw = p.ids.tobytes()
            self.rows.append((
                p.doc, p.start, len(p.ids), zlib.crc32(raw), p.total, sequence, offset, tier, self.base + group,
                self.cell, raw if self.keep_ids else None, False,
            ))
            offset += len(p.ids)

    def add(self, doc, ids: np.ndarray) -> None:
        total = len(ids)
        for start in range(0, total, self.window):
            # the array of the whole document isn't kept alive
            piece = Piece(doc, start, ids[start : start + self.window].copy(), total)
            if len(piece.ids) < self.window:
                self.add_piece(piece)
            else:
                self.full.append((self.window, [piece]))
                self._gathered(self.window)

    def add_piece(self, piece: Piece) -> None:
        self.waiting.append(piece)
        self._gathered(len(piece.ids))

    def _gathered(self, more: int) -> None:
        self.tokens += more
        if self.tokens >= self.most:
            self.pack()

    def pack(self, last: bool = False) -> None:
        filled, self.waiting = pack_pieces(self.waiting, self.tiers)
        filled = self.full + filled
        groups, self.full = step_groups(filled, self.step, last), []
        for (tier, parts), group in zip(filled, groups, strict=True):
            if group is None:
                self.full.append((tier, parts))
            else:
                self._emit(parts, tier, self.groups + group)
        self.groups += max((g for g in groups if g is not None), default=-1) + 1
        self.tokens = sum(len(p.ids) for p in self.waiting)

    def end(self, last: bool) -> None:
        """``last``: no further level follows, so what is left becomes a sequence that is padded."""
        self.pack(True)
        if last and self.waiting:
            self._emit(self.waiting, self.window, self.groups)
        else:
            for p in self.waiting:
                self.rows.append((p.doc, p.start, len(p.ids), 0, p.total, 0, 0, 0, 0, self.cell, p.ids.tobytes(), True))

    def take(self, schema: pa.Schema) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * len(schema)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


FIELDS = (
    "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, "
    "step_group long, cell long, ids binary, waiting boolean"
)


def _schema(doc_type: pa.DataType) -> pa.Schema:
    kinds = [("doc_id", doc_type)]
    for field in FIELDS.split(", "):
        name, kind = field.split(" ")
        kinds.append((name, {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}[kind]))
    return pa.schema(kinds)


def pack(
    docs: DataFrame,
    path: str,
    ranks: str,
    pattern: str,
    end_id: int = 1,
    tiers=TIERS,
    pool: int = POOL,
    step: int = STEP,
    keep_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group, ids``.

    ``path`` is a tokenizer file on every executor, ``ranks`` the same vocabulary as ranks, split by ``pattern``;
    ``end_id`` ends each document. A sequence is as long as its
    ``tier``, but for one of the whole table that is padded to the longest tier. ``ids`` is filled if ``keep_ids``.
    """
    texts = common.text_of(docs, id_col, text_col)
    doc_type = texts.schema["doc_id"].dataType
    out = f"doc_id {doc_type.simpleString()}, {FIELDS}"
    window = max(tiers)
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, schema = tokens.file_encoder(path, ranks, pattern), None
        cell = TaskContext.get().partitionId()
        packer = Packer(cell, cell << 32, window, tiers, step, pool, keep_ids)
        for batch in batches:
            schema = schema or _schema(batch.schema.field("doc_id").type)
            ids, at = batch.column("doc_id").to_pylist(), 0
            for some in tokens.slices(batch.column("text")):
                for doc, raw in zip(ids[at : at + len(some)], encoder(some), strict=True):
                    packer.add(doc, np.frombuffer(raw + end, dtype="<u4"))
                at += len(some)
                yield packer.take(schema)
        if schema is not None:
            packer.end(False)
            yield packer.take(schema)

    rows = common.stage(texts.mapInArrow(first, out), "packed")
    results, left = [rows.where("NOT waiting")], rows.where("waiting")
    cells, level = (left.agg(F.max("cell")).first()[0] or 0) + 1, 0
    while True:
        level, cells = level + 1, -(-cells // FAN)
        rows = common.stage(_again(left, out, level, cells == 1, window, tiers, step, pool, keep_ids), f"packed-{level}")
        results.append(rows.where("NOT waiting"))
        left = rows.where("waiting")
        if cells == 1:
            break
    whole = results[0]
    for more in results[1:]:
        whole = whole.unionByName(more)
    return whole.drop("cell", "waiting")


def _again(left: DataFrame, out: str, level: int, last: bool, window, tiers, step, pool, keep_ids) -> DataFrame:
    """The next level: what is left of ``FAN`` cells, less than a window each."""

    def group(key, table):
        cell = key[0].as_py()
        packer = Packer(cell, (level << 56) + (cell << 32), window, tiers, step, pool, keep_ids)
        columns = [table.column(c).to_pylist() for c in ("cell", "doc_id", "start", "ids", "doc_tokens")]
        rows = sorted(zip(*columns, strict=True), key=lambda r: (r[0], str(r[1]), r[2]))
        for _, doc, start, raw, total in rows:
            packer.add_piece(Piece(doc, start, np.frombuffer(raw, dtype="<u4"), total))
        packer.end(last)
        return pa.Table.from_batches([packer.take(_schema(table.schema.field("doc_id").type))])

    return left.withColumn("parent", F.expr(f"cell div {FAN}")).groupBy("parent").applyInArrow(group, out)
