"""Near-duplicate texts by Order MinHash on shingles of words, verified by banded alignment.

1. A text is a row of words. Its shingles are labelled with their occurrence, so that repeated ones differ. For each
   of ``SKETCHES`` orders the two smallest labelled shingles, put in the order of the text, give one sketch: texts
   share a sketch if they share shingles in the same order, as copies with few edits do. Shingles only find candidates; what
   is a near-duplicate is told by the alignment. Texts of up to ``EXACT`` words
   have few shingles that survive edits, so pairs of such texts are found by a prefix filter instead, without a miss:
   d edits leave at least c = n - 1 - 2 d of the n - 1 labelled pairs of neighbouring words, so similar texts share one
   of their n - c rarest pairs. How rare a pair is comes from a table of 2^18 counters over all short texts.
2. Texts with the same words are one node; copies never meet in pairs. Nodes that share a sketch or pair form a bucket.
3. In every bucket the node that shares most buckets with others, weighted by their sizes, is the pivot, as the centre of a
   group does; it is paired with all nodes of the bucket in other classes. A pair is linked if the edit distance of
   its words, by alignment in a band around the diagonal, leaves a similarity of ``SIMILARITY`` or more. Linked nodes
   become one class. Buckets that are of more than one class then go on without their pivots, round by round, with ``PIVOTS``
   pivots each, the heaviest of as many parts of the bucket. Rounds end when one links nothing, or less than ``SETTLED`` of
   all links so far. A round is linear in the sizes of the buckets. ``all_pairs`` also verifies all other pairs of a
   bucket in different classes, in blocks of nodes.
4. Sketches may miss a pair and rounds leave pairs out, so what is left is found without a miss: of the labelled pairs of
   neighbouring words, all but 2 d of the longer text's stand in both texts, so similar texts share some of their rarest ones
   (``rare_runs`` says how many each text shows, ``spare`` how many of them two texts share at least). Rare are runs that few
   texts hold, by counters, so passages that many texts hold come last. Runs are dealt into buckets by their values, many in a row
   as arrays; in a bucket nodes of different classes meet if their lengths allow it, both show the run early enough for these
   lengths, and it stands where an alignment can match it (``place_fits``); those that share as many runs over all buckets are
   verified. Runs that more than a share of ``BLOCK`` nodes show meet in cells of nodes, all such runs of two cells at once, and pairs whose
   words rule the similarity out, by ``BAG`` bits of either text, go no further. Only this step grows with the square of the
   texts that show one run.
5. Classes are the connected components of all links, found by passing on the smallest node.

Words are runs of letters, digits and underscores in lower case. Texts without words are equal if they are identical;
NULL is the empty text. Of a class the row with the smallest id
stays, NULL last; of repeated rows with one id exactly one. An empty table gives no rows. Other columns are not looked
at.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.llm import common
from evenkeel.llm.tokens import small_batches

SHINGLE, SKETCHES, SIMILARITY = 3, 32, 0.8
#: Pairs of texts of up to so many words are found by their rarest pairs of words, without a miss.
EXACT = 50
#: Counters that tell rare pairs of words from common ones, for any number of texts.
COUNTERS = 2**18
#: Pivots of a bucket in a round after the first; share of links below which no further round follows.
PIVOTS, SETTLED = 4, 0.001
#: Of so many words of a text one more rare run is shown, and one more has to be shared.
SPARE = 32
#: One of so many nodes tells how common words and runs are, runs by so many counters. This orders runs and decides nothing else.
RANKED, RUN_COUNTERS = 8, 2**22
#: Rare runs that meet in one bucket, and words or pairs that a task handles at once.
BUCKET, AT_ONCE = 500_000, 500_000
#: The place of a run that stands more than once in its text, or too late for 16 bits.
ANYWHERE = 2**16 - 1
#: Nodes of a bucket on either side of a block of pairs.
BLOCK = 1_000
#: Runs that more nodes show than a block divided by this meet in cells of nodes.
COMMON = 4
#: Numbers of nodes that may be broadcast, 8 bytes each; more are joined.
BROADCAST_NODES = 1_000_000
#: Rows to drop that may be broadcast, about 100 bytes each; more are joined.
BROADCAST_ROWS = 100_000

WORD = re.compile(r"\w+")
ODD = np.random.default_rng(20_240_601).integers(1, 2**63, size=1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)


LETTERS = np.random.default_rng(20_240_602).integers(1, 2**64, size=256, dtype=np.uint64)
WEIGHTS = np.random.default_rng(20_240_603).integers(1, 2**63, size=2**12, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The bytes of an ASCII text in lower case, with spaces for all that is no part of a word.
ASCII = bytes(ord(c.lower()) if WORD.match(c) else 32 for c in map(chr, range(128))).ljust(256)


class _Hashes(dict):
    """64-bit hashes of words, the same on every machine."""

    def __missing__(self, word: str) -> int:
        return int(word_hashes(word.encode() + b"\n")[0])


def word_lines(text: str) -> bytes:
    """The words of a text, each with a line feed behind it."""
    words = text.encode().translate(ASCII).split() if text.isascii() else [w.encode() for w in WORD.findall(text.lower())]
    return b"\n".join([*words, b""])


def word_hashes(lines: bytes) -> np.ndarray:
    """A 64-bit hash of each word in :func:`word_lines`, the same on every machine: the sum of its letters, each with a weight by its place."""
    data = np.frombuffer(lines, np.uint8)
    ends = np.flatnonzero(data == 10) + 1
    if not len(ends):
        return np.zeros(0, np.uint64)
    starts = np.append(0, ends[:-1])
    place = np.arange(len(data)) - np.repeat(starts, ends - starts)
    letters = LETTERS[data] * WEIGHTS[place % len(WEIGHTS)]
    if (ends - starts).max() > len(WEIGHTS):
        letters *= mixed((place // len(WEIGHTS)).astype(np.uint64)) | np.uint64(1)
    return mixed(mixed(np.add.reduceat(letters, starts)))


def mixed(values: np.ndarray) -> np.ndarray:
    values = values ^ (values >> np.uint64(33))
    values = values * MIX
    return values ^ (values >> np.uint64(29))


def shingles(hashes: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """One number per run of ``k`` words; a shorter text is one run."""
    k = min(k, len(hashes))
    out = np.zeros(len(hashes) - k + 1, np.uint64)
    for at in range(k):
        out = mixed(out) + hashes[at : at + len(out)]
    return mixed(out)


def occurrences(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """How often each run stands before, and whether it stands more than once; nothing if all stand once."""
    ordered = np.sort(runs)
    if not (ordered[1:] == ordered[:-1]).any():
        return None
    order = np.argsort(runs, kind="stable")
    again = np.append(False, ordered[1:] == ordered[:-1])
    starts = np.maximum.accumulate(np.where(again, 0, np.arange(len(runs))))
    occurrence, repeated = np.empty(len(runs), np.uint64), np.empty(len(runs), bool)
    occurrence[order] = (np.arange(len(runs)) - starts).astype(np.uint64)
    repeated[order] = again | np.append(again[1:], False)
    return occurrence, repeated


def labelled(runs: np.ndarray) -> np.ndarray:
    """Runs with their occurrence: the second place of a run differs from the first."""
    times = occurrences(runs)
    return mixed(runs if times is None else runs + times[0] * ODD[-1])


def sketch(hashes: np.ndarray, sketches: int = SKETCHES) -> np.ndarray:
    """The sketches of a text's words, one number for each order; none for a text without words."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    runs = shingles(hashes)
    marks = labelled(runs)
    out = np.empty(sketches, np.uint64)
    step = max(1, 200_000 // len(runs))
    mixed_marks = mixed(marks)
    for at in range(0, sketches, step):
        ranks = mixed_marks[None, :] * ODD[at : min(at + step, sketches), None]
        rows = np.arange(len(ranks))
        first = ranks.argmin(axis=1)
        if len(runs) > 1:
            ranks[rows, first] = np.uint64(2**64 - 1)
            second = ranks.argmin(axis=1)
        else:
            second = first
        a, b = np.minimum(first, second), np.maximum(first, second)
        out[at : at + len(rows)] = mixed(mixed_marks[a] + marks[b])
    return mixed(out + np.arange(sketches, dtype=np.uint64) * MIX).view(np.int64)


@lru_cache(maxsize=None)
def run_length(least: float, exact: int) -> int:
    """Words of a run: two, if edits within the similarity always leave one run of two words, else one."""
    edits = [(n, int((1 - least) * n + 1e-9)) for n in range(1, exact + 1)]
    return 2 if all(n - 1 - 2 * d >= 1 for n, d in edits if d) else 1


@lru_cache(maxsize=None)
def prefix(n: int, least: float, exact: int) -> int:
    """How many of the rarest runs of a text of ``n`` words hold one of any similar, not equal text of up to ``exact`` words.

    Of the runs of the longer of two texts ``d`` edits leave all but ``k * d``; both texts share these.
    """
    k, shared = run_length(least, exact), []
    for longest in range(n, exact + 1):
        d = int((1 - least) * longest + 1e-9)
        if d and longest - n <= d:
            shared.append(longest - k + 1 - k * d)
    return max(0, max(0, n - k + 1) - min(shared) + 1) if shared else 0


@lru_cache(maxsize=None)
def shown(n: int, least: float) -> int:
    """How many of its rarest runs a text of ``n`` words has to show, so that it shares ``1 + spare`` of them with any similar,
    not equal text; see :func:`spare`.

    Of the runs of the longer of two texts ``d`` edits leave all but ``k * d``, at least ``shared``. Of two lists of shown runs
    take the one that ends first in the common order: what both texts share is shown by both, or is one of the runs not shown
    of this text. If these are ``shared - 1 - spare``, at least ``1 + spare`` shared runs are shown by both.
    """
    most, shared = _shared_runs(n, least)
    return most - shared + 1 + spare(n, least) if shared else 0


@lru_cache(maxsize=None)
def spare(n: int, least: float) -> int:
    """How many runs beyond one a text of ``n`` words has to share with any similar one, among those shown by both."""
    return max(0, min(n // SPARE, _shared_runs(n, least)[1] - 1))


def long_run(least: float) -> int:
    """Words of a run for texts of any length; see :func:`run_length`."""
    return run_length(least, int(2 / (2 * least - 1)) + 2) if least > 0.5 else 1


def _shared_runs(n: int, least: float) -> tuple[int, int]:
    """The runs of a text of ``n`` words, and how many any similar, not equal text shares at least; 0 if there is none."""
    k = long_run(least)
    longest = np.arange(n, int(n / least) + 2)
    edits = np.floor((1 - least) * longest + 1e-9).astype(np.int64)
    there = (edits > 0) & (longest - n <= edits)
    return max(0, n - k + 1), int((longest - k + 1 - k * edits)[there].min()) if there.any() else 0


def rare_runs(words: np.ndarray, ranks: np.ndarray, least: float = SIMILARITY, common_runs: np.ndarray | None = None) -> np.ndarray:
    """The rarest labelled runs of a text, the rarest first, as numbers in that order: 16 bits of how common it is, 48 of the run.

    ``common_runs`` tells how common runs are, by classes of runs, and ``ranks`` how common words are, by classes of words.
    """
    return placed_runs(words, ranks, least, common_runs)[0]


def placed_runs(words: np.ndarray, ranks: np.ndarray, least: float, common_runs: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The runs of :func:`rare_runs`, and where each stands in the text, if it stands there once; see ``ANYWHERE``."""
    most = shown(len(words), least)
    if not most:
        return np.zeros(0, np.int64), np.zeros(0, np.uint16)
    k, own = long_run(least), ranks[words % np.uint32(len(ranks))]
    plain = shingles(words.astype(np.uint64), k)
    times = occurrences(plain)
    runs = mixed(plain if times is None else plain + times[0] * ODD[-1])
    together = own[1:] + own[:-1] if k == 2 else own
    place = np.minimum(together * 32, 1023).astype(np.uint64)
    if common_runs is not None:
        place |= np.minimum(common_runs[plain % np.uint64(len(common_runs))], 31).astype(np.uint64) << np.uint64(10)
    value = (place << np.uint64(48)) | (runs >> np.uint64(16))
    first = np.argsort(value)[:most]
    at = np.minimum(first, ANYWHERE)
    if times is not None:
        at[times[1][first]] = ANYWHERE
    return value[first].view(np.int64), at.astype(np.uint16)


def short_runs(hashes: np.ndarray, least: float = SIMILARITY, exact: int = EXACT) -> np.ndarray:
    """The labelled runs of a short text."""
    return labelled(shingles(hashes, run_length(least, exact)))


def keys(
    hashes: np.ndarray, sketches: int = SKETCHES, least: float = SIMILARITY, exact: int = EXACT, counts: np.ndarray | None = None
) -> np.ndarray:
    """What similar texts share: rare runs of words in texts of up to ``exact`` words, sketches in those similar to longer ones.

    ``counts`` tells how common runs are, by ``COUNTERS`` classes of runs. The order of runs has to be one for all texts.
    """
    n, found = len(hashes), []
    if n <= exact and (most := prefix(n, least, exact)):
        runs = short_runs(hashes, least, exact)
        common_first = counts[runs % np.uint64(len(counts))] if counts is not None else np.zeros(len(runs), np.int64)
        found.append(mixed(runs[np.lexsort((runs, common_first))][:most] + ODD[2]).view(np.int64))
    if n and n + int((1 - least) * (exact + 1) + 1e-9) > exact:
        found.append(sketch(hashes, sketches))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def run_counts(texts: DataFrame, least: float = SIMILARITY, exact: int = EXACT) -> np.ndarray:
    """How often runs of words stand in all texts of up to ``exact`` words, by ``COUNTERS`` classes of runs.

    Each task sends one row per class at most, and the driver gets ``COUNTERS`` numbers, however many texts there are.
    """

    def run(batches):
        counts = np.zeros(COUNTERS, np.int64)
        for batch in small_batches(batches, "text"):
            for text in batch.column("text").to_pylist():
                words = [m.group() for m in islice(WORD.finditer(text.lower()), exact + 1)]
                if 0 < len(words) <= exact:
                    runs = short_runs(word_hashes("\n".join([*words, ""]).encode()), least, exact)
                    np.add.at(counts, (runs % np.uint64(COUNTERS)).astype(np.int64), 1)
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(counts[there], pa.int64())], ["slot", "n"])

    found = texts.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    counts = np.zeros(COUNTERS, np.int64)
    for slot, n in found.collect():
        counts[slot] = n
    return counts


def distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """The edit distance of two rows of words, or ``most + 1`` if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    same = min(len(a), len(b))
    differ = np.flatnonzero(a[:same] != b[:same])
    front = int(differ[0]) if len(differ) else same
    a, b = a[front:], b[front:]
    same = min(len(a), len(b))
    if same:
        differ = np.flatnonzero(a[::-1][:same] != b[::-1][:same])
        back = int(differ[0]) if len(differ) else same
        a, b = a[: len(a) - back], b[: len(b) - back]
    if not len(a) or not len(b):
        return max(len(a), len(b))
    if max(len(a), len(b)) - _shared(a, b) > most:
        return most + 1
    places: dict[int, list[int]] = {}
    for at, word in enumerate(a.tolist()):
        places.setdefault(word, []).append(at)
    width = max(8, abs(len(a) - len(b)))
    while True:
        width = min(width, most)
        found = _banded(places, len(a), b.tolist(), width)
        if found <= width or width == most:
            return min(found, most + 1)
        width *= 2


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Words that both hold, counted as often as both do."""
    words, counts = np.unique(a, return_counts=True)
    others, more = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(words, others, assume_unique=True, return_indices=True)
    return int(np.minimum(counts[i], more[j]).sum())


def _banded(places: dict[int, list[int]], n: int, text: list[int], width: int) -> int:
    """Edit distance within ``width`` of the diagonal; exact if it is at most ``width``.

    The band of a column covers the rows from ``width`` above to ``width`` below the diagonal, as bits of two numbers:
    where the next row is one more, and where it is one less. Bit ``2 * width`` is the lowest row, whose value is
    followed along the diagonal. From one column to the next the band moves down by one row.
    """
    span = 2 * width + 1
    full, last = (1 << span) - 1, 1 << (span - 1)
    more, less, value = (full >> width) << width, 0, width
    for column, word in enumerate(text, 1):
        top = column - width - 1  # the first row of the band, from 0
        match = 0
        at = places.get(word)
        if at is not None:
            for k in range(bisect_left(at, top), len(at)):
                bit = at[k] - top
                if bit >= span:
                    break
                match |= 1 << bit
        diagonal = ((((match & more) + more) ^ more) | match | less) & full
        right_more = less | (full & ~(diagonal | more))
        right_less = diagonal & more
        if not diagonal & last:
            value += 1
        shifted = diagonal >> 1
        more = right_less | (full & ~(shifted | right_more))
        less = shifted & right_more
    # down from row n to the lowest row of the last column
    below = n - len(text) + width
    mask = ((1 << (span - 1)) - 1) >> below << below
    return value - (more & mask).bit_count() + (less & mask).bit_count()


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    longest = max(len(a), len(b))
    most = int((1 - least) * longest + 1e-9)
    return distance(a, b, most) <= most


SIGNATURE = "row long, doc_id long, same string, key string, n int, sketch array<long>, words array<int>"


def _lists(parts: list[np.ndarray], kind: type) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, kind), *parts]).astype(kind)))


def signatures(
    docs: DataFrame, sketches: int, id_col: str, text_col: str, least: float = SIMILARITY, exact: int = EXACT
) -> DataFrame:
    """One row per input row, staged: ids, the words' key, the keys it may share, and the words as 32-bit hashes."""
    texts = common.text_of(docs, id_col, text_col)
    id_type = texts.schema["doc_id"].dataType.simpleString()
    with common.arrow_rows(docs.sparkSession):
        counts = run_counts(texts, least, exact)
    texts = texts.select(common.row_key().alias("row"), "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("same"), "text")

    def run(batches):
        for batch in small_batches(batches, "text"):
            named, sizes, found, words_of = [], [], [], []
            for text, same in zip(batch.column("text").to_pylist(), batch.column("same").to_pylist(), strict=True):
                words = word_lines(text)
                own = word_hashes(words)
                named.append(hashlib.blake2b(words[:-1], digest_size=16).hexdigest() if words else same)
                sizes.append(len(own))
                found.append(keys(own, sketches, least, exact, counts))
                words_of.append(own.astype(np.uint32).view(np.int32))
            made = [pa.array(named, pa.string()), pa.array(sizes, pa.int32()), _lists(found, np.int64), _lists(words_of, np.int32)]
            front = [batch.column(c) for c in ("row", "doc_id", "same")]
            yield pa.RecordBatch.from_arrays([*front, *made], ["row", "doc_id", "same", "key", "n", "sketch", "words"])

    with common.arrow_rows(docs.sparkSession):
        return common.stage(texts.mapInArrow(run, SIGNATURE.replace("doc_id long", f"doc_id {id_type}")), "signatures")


def shared_keys(nodes: DataFrame) -> DataFrame:
    """``value, node, n, size, weight, class``: each node in each of its buckets of two or more. Staged.

    The weight of a node is the sum of the sizes of its buckets; each node is a class of its own.
    """
    entries = nodes.select("node", "n", F.explode("sketch").alias("value"))
    sizes = entries.groupBy("value").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    entries = common.stage(entries.join(sizes, "value").select("value", "node", "n", "size"), "buckets")
    weights = entries.groupBy("node").agg(F.sum("size").alias("weight"))
    return common.stage(entries.join(weights, "node").withColumn("class", F.col("node")), "weighed-buckets")


def fits(least: float, a: str, b: str):
    """Whether lengths allow the similarity."""
    return F.abs(F.col(a) - F.col(b)) <= F.floor((1 - least) * F.greatest(a, b) + 1e-9)


def pairs_left(entries: DataFrame, met: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """``a, b`` with ``a > b``: all pairs of a bucket in different classes that are not in ``met``. Staged.

    Pairs whose lengths alone rule out the similarity are left out. Parts of a bucket are paired as blocks.
    """
    mixed_ones = entries.groupBy("value").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high")
    own = common.stage(entries.join(mixed_ones.select("value"), "value"), "open-buckets")
    both = _meetings(own, least, block).select("a", "b", "class_a", "class_b").distinct()
    return common.stage(both.join(met, ["a", "b"], "left_anti"), "pairs-left")


def _meetings(own: DataFrame, least: float, block: int) -> DataFrame:
    """All pairs of a bucket in different classes whose lengths allow the similarity, once for each of their buckets."""
    cells = F.ceil(F.col("size") / block)
    own = own.withColumn("cell", F.pmod(F.xxhash64("node"), cells)).withColumn("other", F.explode(F.sequence(F.lit(0), cells - 1)))

    def side(end: str, i: str, j: str) -> DataFrame:
        return own.select(
            "value", F.col("cell").alias(i), F.col("other").cast("long").alias(j),
            F.col("node").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in ("n", "class")],
        )

    both = side("a", "i", "j").join(side("b", "j", "i"), ["value", "i", "j"])
    return both.where("a > b AND class_a <> class_b").where(fits(least, "n_a", "n_b"))


def run_ranks(words: DataFrame, least: float) -> tuple[np.ndarray, np.ndarray]:
    """How common words and runs are in one of ``RANKED`` nodes, by ``COUNTERS`` classes of words and ``RUN_COUNTERS`` of runs.

    Classes travel as arrays, by parts of 2^16 of them; the driver gets the sums only. Of a class of runs only what stands out of
    the many rare runs in any class tells that it holds a common one.
    """
    k = long_run(least)

    def dealt(found: list[np.ndarray]) -> pa.RecordBatch:
        slots = np.sort(np.concatenate([np.zeros(0, np.int64), *found]))
        parts, starts = np.unique(slots >> 16, return_index=True)
        low = [x.astype(np.uint16).tobytes() for x in np.split(slots, starts[1:])] if len(slots) else []
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(low, pa.binary())], ["part", "slots"])

    def run(batches):
        found, held = [], 0
        for batch in batches:
            lists = batch.column("words")
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy(False).view(np.uint32)
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                found.append((np.unique(values[a:b]) % np.uint32(COUNTERS)).astype(np.int64))
                if b - a >= k:
                    runs = np.unique(shingles(values[a:b].astype(np.uint64), k)) % np.uint64(RUN_COUNTERS)
                    found.append(runs.astype(np.int64) + COUNTERS)
                held += b - a
                if held > AT_ONCE:
                    yield dealt(found)
                    found, held = [], 0
        yield dealt(found)

    def counted(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2**16, np.int32)
        for batch in batches:
            for low in batch.column("slots"):
                counts += np.bincount(np.frombuffer(low.as_py(), np.uint16), minlength=2**16).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([counts.tobytes()], pa.binary())], ["part", "counts"])

    some = words.where(f"pmod(xxhash64(node), {RANKED}) = 0").select("words").mapInArrow(run, "part int, slots binary")
    counts = np.zeros((COUNTERS + RUN_COUNTERS + 2**16 - 1 >> 16) << 16, np.int32)
    for part, own in some.groupBy("part").applyInArrow(counted, "part int, counts binary").collect():
        counts[part << 16 :][: 2**16] = np.frombuffer(own, np.int32)
    counts = counts[: COUNTERS + RUN_COUNTERS]
    usual = counts[COUNTERS:].mean()
    beyond = np.maximum(counts[COUNTERS:] - usual - 3 * np.sqrt(usual), 0).astype(np.float32)
    # half powers of two: what differs less is told apart by the words
    return np.log1p(counts[:COUNTERS]).astype(np.float32), np.floor(np.log1p(beyond) * (2 / np.log(2)) + 1e-3).astype(np.uint8)


def _stretches(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` words together, one text at least and fewer than 2^16."""
    at = 0
    while at < len(ends) - 1:
        to = min(max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1), at + 2**16 - 1)
        yield at, to
        at = to


#: Rare runs of many nodes: their values, the places of their nodes among ``node, class, n``, their places in the order of a node, and in
#: its text.
RUNS = "bucket int, value binary, place binary, at binary, word binary, node binary, class binary, n binary"
#: A pair and how many runs it shares, or (without ``b``) the runs of a bucket that many nodes show (see ``COMMON``), in one of the cells
#: that their nodes are dealt into: as ``ENTRY``, and the nodes.
MET = "a long, class_a long, b long, class_b long, spare int, times long, bucket int, cells int, cell int, runs binary, nodes array<long>"
ENTRY = np.dtype([("value", "<i8"), ("node", "<i8"), ("class", "<i8"), ("n", "<i4"), ("at", "<i4"), ("word", "<i4")])
#: Bits that tell what words a text has.
BAG = 2**12


def shown_runs(words: DataFrame, least: float, buckets: int, ranks: np.ndarray, common_runs: np.ndarray) -> DataFrame:
    """The rare runs of all nodes, dealt into ``buckets`` by their values; see ``RUNS``."""

    def run(batches):
        for batch in batches:
            lists = batch.column("words")
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy(False).view(np.uint32)
            whole = [batch.column(c).to_numpy() for c in ("node", "class")] + [np.diff(ends).astype(np.int32)]
            for first, last in _stretches(ends, AT_ONCE):
                shows = [placed_runs(values[a:b], ranks, least, common_runs) for a, b in zip(ends[first:last].tolist(), ends[first + 1 : last + 1].tolist(), strict=True)]
                times = np.array([len(x) for x, _ in shows], np.int64)
                value, word = (np.concatenate(x) for x in zip(*shows, strict=True))
                value = value.view(np.uint64)
                place = np.repeat(np.arange(last - first, dtype=np.uint16), times)
                # of places beyond, only that they are large
                at = np.minimum(np.arange(len(value)) - np.repeat(np.cumsum(times) - times, times), 2**16 - 1).astype(np.uint16)
                bucket = (((value >> np.uint64(32)) & np.uint64(2**16 - 1)) % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.diff(bucket[order])) + 1
                rows = []
                for own in np.split(order, cuts) if len(order) else ():
                    there, local = np.unique(place[own], return_inverse=True)
                    made = value[own].astype(np.uint32), local.astype(np.uint16), at[own], word[own], *(x[first:last][there] for x in whole)
                    rows.append((int(bucket[own[0]]), *(x.tobytes() for x in made)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in rows], pa.binary() if i else pa.int32()) for i in range(8)],
                    ["bucket", "value", "place", "at", "word", "node", "class", "n"],
                )

    return words.select("node", "class", "words").mapInArrow(run, RUNS)


def _reach(n: np.ndarray, longest: np.ndarray, spares: np.ndarray, least: float) -> np.ndarray:
    """How many of its rarest runs a text of ``n`` words has to show to a similar one, if ``longest`` is the longer's length; see :func:`shown`."""
    k = long_run(least)
    shared = longest - k + 1 - k * np.floor((1 - least) * longest + 1e-9).astype(np.int64)
    return n - k + 1 - shared + 1 + spares


def place_fits(word_a, word_b, n_a, n_b, least: float) -> np.ndarray:
    """Whether an alignment within the similarity can match runs at these places of two texts.

    Before a match stand at most all words that the alignment leaves out of either text. These are at most the edits together, and
    their difference is that of the lengths. Of runs that stand once in either text this tells whether they can be among those that
    edits leave.
    """
    most = np.floor((1 - least) * np.maximum(n_a, n_b) + 1e-9)
    return (word_a == ANYWHERE) | (word_b == ANYWHERE) | (np.abs(2 * (word_a - word_b) - (n_a - n_b)) <= most)


def cell_of(node: np.ndarray, cells) -> np.ndarray:
    """The cell of a node, of so many."""
    return (mixed(node.astype(np.uint64)) >> np.uint64(20)).astype(np.int64) % cells


def bag(words: np.ndarray) -> bytes:
    """``BAG`` bits, each telling whether an odd number of the text's labelled words fall on it."""
    marks = labelled(mixed(words.astype(np.uint64)))
    return np.packbits(np.bincount((marks >> np.uint64(8)).astype(np.int64) % BAG, minlength=BAG) & 1 > 0).tobytes()


def bags_fit(x: np.ndarray, y: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, least: float) -> np.ndarray:
    """Whether texts with the bags in these rows can be similar.

    Texts apart by ``d`` edits share all but ``d`` words of the longer one, so at most ``2 d`` less the difference of the lengths
    stand in one of them only; each of these words turns one bit.
    """
    differ = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return differ <= 2 * np.floor((1 - least) * np.maximum(n_a, n_b) + 1e-9) - np.abs(n_a - n_b)


def _bucket_pairs(value, node, group, n, at, word, least: float, block: int, side: np.ndarray | None = None) -> Iterator[dict[str, np.ndarray]]:
    """Columns of ``MET`` from all entries of a bucket: pairs of nodes of different classes with common runs, and how many.

    The entries of runs that more than ``block`` nodes show come first, as columns of ``ENTRY`` and the number of nodes. With
    ``side`` only entries of different sides meet.
    """
    order = np.lexsort((n, value))
    value, group = value[order], group[order]
    starts = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
    sizes = np.diff(np.append(starts, len(value)))
    several = np.minimum.reduceat(group, starts) != np.maximum.reduceat(group, starts)
    keep, large = np.repeat(several, sizes), np.repeat(sizes > block, sizes)
    if (there := keep & large).any():
        rest = {c: x[order[there]] for c, x in (("node", node), ("n", n), ("at", at), ("word", word))}
        yield {"value": value[there], "class": group[there], "size": np.repeat(sizes, sizes)[there]} | rest
    keep &= ~large
    order, value, group = order[keep], value[keep], group[keep]
    node, n, at, word, side = (x[order] if x is not None else None for x in (node, n, at, word, side))
    del keep, large, there, order
    lengths, back = np.unique(n, return_inverse=True)
    spares = np.array([spare(x, least) for x in lengths.tolist()], np.int64)[back] if len(n) else np.zeros(0, np.int64)
    nodes, local = np.unique(node, return_inverse=True)
    # in the order of lengths, each with the next, the one after it, and so on while the lengths allow the similarity
    parts, held = [], 0
    here, step = np.arange(len(value)), 1
    while len(here):
        here = here[here + step < len(value)]
        there = here + step
        near = (value[here] == value[there]) & (n[there] - n[here] <= np.floor((1 - least) * n[there] + 1e-9))
        here, there, step = here[near], there[near], step + 1
        s = np.minimum(spares[here], spares[there])
        pairs = (group[here] != group[there]) & (side is None or side[here] != side[there]) & (at[here] < _reach(n[here], n[there], s, least)) & (at[there] < _reach(n[there], n[there], s, least))
        i, j = here[pairs], there[pairs]
        fit = place_fits(word[i], word[j], n[i], n[j], least)
        parts.append((i[fit], j[fit]))
        held += int(fit.sum())
        if held > AT_ONCE or not len(here):
            i, j = (np.concatenate(x) for x in zip(*parts, strict=True))
            i, j = np.where(local[i] > local[j], i, j), np.where(local[i] > local[j], j, i)
            _, first, times = np.unique(local[i] * len(nodes) + local[j], return_index=True, return_counts=True)
            i, j = i[first], j[first]
            lengths = {"n_a": n[i], "n_b": n[j]}
            yield {"a": node[i], "class_a": group[i], "b": node[j], "class_b": group[j], "spare": np.minimum(spares[i], spares[j]), "times": times} | lengths
            parts, held = [], 0


def met_runs(runs: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """``MET`` for the rows of :func:`shown_runs`, bucket by bucket. Staged.

    Pairs stand there with the runs that both show early enough for their lengths, and where an alignment can match them.
    """
    kinds = {"value": np.uint32, "place": np.uint16, "at": np.uint16, "word": np.uint16, "node": np.int64, "class": np.int64, "n": np.int32}
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    schema = pa.schema([(c, types[t]) for c, t in (x.split() for x in MET.split(", "))])

    def dealt(bucket: int, found: dict[str, np.ndarray]) -> dict[str, list]:
        """A row for each cell of each number of cells."""
        entries = np.empty(len(found["value"]), ENTRY)
        for c in ENTRY.names:
            entries[c] = found[c]
        entries["value"] += bucket << 32
        cells = 2 ** np.ceil(np.log2(np.maximum(found["size"] / block, 1))).astype(np.int64)
        own = np.stack([cells, cell_of(entries["node"], cells)])
        kinds, back = np.unique(own, axis=1, return_inverse=True)
        parts = [entries[back == i] for i in range(kinds.shape[1])]
        made = {"cells": kinds[0].tolist(), "cell": kinds[1].tolist(), "bucket": [bucket] * len(parts)}
        return made | {"runs": [x.tobytes() for x in parts], "nodes": [np.unique(x["node"]) for x in parts]}

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[str, list[np.ndarray]] = {c: [] for c in ("value", "node", "class", "n", "at", "word")}
        for batch in batches:
            for row in batch.select(list(kinds)).to_pylist():
                own = {c: np.frombuffer(row[c], kind) for c, kind in kinds.items()}
                for c in parts:
                    parts[c].append(own[c][own["place"]] if c in ("node", "class", "n") else own[c])
        value, node, group, *rest = (np.concatenate(x) for x in parts.values())
        parts.clear()
        for found in _bucket_pairs(value, node, group, *(x.astype(np.int32) for x in rest), least, max(1, block // COMMON)):
            if "value" in found:
                found = dealt(key[0].as_py(), found)
            rows = len(found["b"] if "b" in found else found["cell"])
            made = [pa.array(found[f.name], f.type) if f.name in found else pa.nulls(rows, f.type) for f in schema]
            yield pa.RecordBatch.from_arrays(made, schema=schema)

    return common.stage(runs.groupBy("bucket").applyInArrow(run, MET), "met-runs")


#: Of one pair of cells the runs, or the bag of a node.
CELLS = "cells int, part int, i int, j int, runs binary, node long, bag binary"
PAIRS = "a long, class_a long, b long, class_b long, spare int, times long"


def met_in_cells(made: DataFrame, words: DataFrame, least: float, by_words: bool = False, bucket: int = BUCKET) -> DataFrame:
    """``PAIRS`` for the runs of ``met_runs`` that many nodes show: cells of nodes meet with all these runs at once, so
    that a pair is one row, not one for each run. With ``by_words`` pairs are left out whose words rule the similarity out.

    So that a pair of cells has no more than ``bucket`` entries or so, it may have its runs in several parts.
    """
    own = made.where("b IS NULL").select("bucket", "cells", "cell", "runs", "nodes")
    most = own.groupBy("cells").agg((F.sum(F.length("runs")) / F.col("cells")).alias("held")).agg(F.max("held")).first()[0]
    parts = 1 + int((most or 0) * 2 / ENTRY.itemsize) // bucket

    def meet(rows: DataFrame, *rest) -> DataFrame:
        both = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
        return both.select("cells", "part", F.least("cell", "other").alias("i"), F.greatest("cell", "other").alias("j"), *rest)

    none = lambda kind: F.lit(None).cast(kind)
    own = own.withColumn("part", F.pmod("bucket", F.lit(parts)))
    rows = meet(own, "runs", none("long").alias("node"), none("binary").alias("bag"))
    if by_words:
        there = common.stage(own.select("cells", "part", "cell", F.explode("nodes").alias("node")).distinct(), "nodes-in-cells")

        def run(lists: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for x in lists:
                ends, values = x.offsets.to_numpy(), x.values.to_numpy(False).view(np.uint32)
                yield pa.array([bag(values[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())

        bags = there.join(words.select("node", "words"), "node").select("cells", "part", "cell", "node", F.arrow_udf(run, "binary")("words").alias("bag"))
        rows = rows.unionByName(meet(bags, none("binary").alias("runs"), "node", "bag"))
    schema = pa.schema([(c, pa.int32() if t == "int" else pa.int64()) for c, t in (x.split() for x in PAIRS.split(", "))])

    def pairs(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, _, i, j = (x.as_py() for x in key)
        parts, nodes, bags = [], [], []
        for batch in batches:
            for runs, node, own in zip(*(batch.column(c).to_pylist() for c in ("runs", "node", "bag")), strict=True):
                if runs is not None:
                    parts.append(np.frombuffer(runs, ENTRY))
                else:
                    nodes.append(node)
                    bags.append(own)
        if not parts:
            return
        entries = np.concatenate(parts)
        order = np.argsort(np.array(nodes, np.int64))
        known, bits = np.array(nodes, np.int64)[order], np.frombuffer(b"".join(bags), np.uint64).reshape(-1, BAG // 64)[order]
        side = cell_of(entries["node"], cells) if i != j else None
        for found in _bucket_pairs(*(entries[c].copy() for c in ENTRY.names), least, len(entries), side):
            if by_words:
                fit = np.zeros(len(found["a"]), bool)
                for at in range(0, len(fit), 10_000):
                    some = slice(at, at + 10_000)
                    x, y = (bits[np.searchsorted(known, found[c][some])] for c in "ab")
                    fit[some] = bags_fit(x, y, found["n_a"][some], found["n_b"][some], least)
                found = {c: x[fit] for c, x in found.items()}
            yield pa.RecordBatch.from_arrays([pa.array(found[f.name], f.type) for f in schema], schema=schema)

    return rows.groupBy("cells", "part", "i", "j").applyInArrow(pairs, PAIRS)


def pairs_missed(
    words: DataFrame, met: DataFrame, least: float, block: int = BLOCK, bucket: int = BUCKET, by_words: bool = False
) -> DataFrame:
    """``a, b, class_a, class_b`` with ``a > b``: all pairs of nodes in different classes that may be similar and are not in ``met``.
    Staged.

    ``words`` has ``node, class, words``. Runs that only nodes of one class show are left out before any pair is made. A bucket
    holds about ``bucket`` runs, however many nodes there are; runs that many nodes show are met in cells of nodes,
    and what pairs find there may be left out ``by_words``; see :func:`met_in_cells`.
    """
    ranks, common_runs = run_ranks(words, least)
    total = words.agg(F.sum(F.size("words").cast("long")).alias("n")).first()["n"] or 0
    made = met_runs(shown_runs(words, least, 1 + total // (2 * bucket), ranks, common_runs), least, block)
    pairs = made.where("b IS NOT NULL").select("a", "b", "class_a", "class_b", "spare", "times")
    if not made.where("b IS NULL").isEmpty():
        pairs = pairs.unionByName(met_in_cells(made, words, least, by_words, bucket))
    both = pairs.groupBy("a", "b", "class_a", "class_b").agg(F.sum("times").alias("shared"), F.min("spare").alias("spare"))
    return common.stage(both.where("shared > spare").select("a", "b", "class_a", "class_b").join(met, ["a", "b"], "left_anti"), "pairs-missed")


def linked(edges: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """The edges ``a, b, ..`` whose texts are similar; ``words`` has ``node, words``. Staged."""
    left = edges.join(words.select(F.col("node").alias("a"), F.col("words").alias("x")), "a")
    both = left.join(words.select(F.col("node").alias("b"), F.col("words").alias("y")), "b")

    def run(batches):
        for xs, ys in batches:
            (p, x), (q, y) = ((a.offsets.to_numpy(), a.values.to_numpy(False)) for a in (xs, ys))
            yield pa.array([similar(x[p[i] : p[i + 1]], y[q[i] : q[i + 1]], least) for i in range(len(xs))], pa.bool_())

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return common.stage(both.where(F.arrow_udf(run, "boolean")("x", "y")).select(*edges.columns), "links")


def components(links: DataFrame) -> DataFrame:
    """``node, class`` for all nodes of ``links``; the class is its smallest node. Staged."""
    both = common.stage(links.select("a", "b").union(links.select("b", "a")).distinct(), "both-ways")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("class"))
    labels = common.stage(labels, "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "class"), "b").groupBy(F.col("a").alias("node"))
        hooked = labels.join(near.agg(F.min("class").alias("near")), "node")
        hooked = hooked.select("node", F.col("class").alias("old"), F.least("class", "near").alias("class"))
        further = labels.select(F.col("node").alias("class"), F.col("class").alias("jump"))
        moved = hooked.join(further, "class").select("node", F.least("class", "jump").alias("class"), "old")
        moved = common.stage(moved, "labels")
        labels = moved.select("node", "class")
        if moved.where("class <> old").isEmpty():
            return labels


def _verified(pairs: DataFrame, words: DataFrame, least: float) -> DataFrame | None:
    """What is linked of the staged ``pairs``, or nothing if there are none."""
    if pairs.isEmpty():
        return None
    # only the words of nodes in a pair are moved
    ends = common.stage(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ends")
    few = ends.count() <= BROADCAST_NODES
    links = linked(pairs, words.join(F.broadcast(ends) if few else ends, "node", "left_semi"), least)
    return None if links.isEmpty() else links


def _grown(classes: DataFrame | None, moved: DataFrame) -> DataFrame:
    """``node, class`` after classes have moved: ``moved`` has ``node, class`` for classes, and for nodes without one."""
    if classes is None:
        return moved
    further = moved.select(F.col("node").alias("class"), F.col("class").alias("to"))
    old = classes.join(further, "class", "left").select("node", F.coalesce("to", "class").alias("class"))
    return common.stage(old.unionByName(moved.join(classes, "node", "left_anti")), "classes")


def node_classes(
    nodes: DataFrame, words: DataFrame, least: float, all_pairs: bool = False, settled: float = SETTLED, block: int = BLOCK
) -> DataFrame:
    """``node, class`` of nodes that are linked with another."""
    entries, classes, met, pivots, found = shared_keys(nodes), None, None, 1, 0
    while True:
        part = F.pmod(F.xxhash64("node", F.lit(pivots)), F.lit(pivots)).alias("part")
        pivot = F.max(F.struct("weight", "node", "n", "class")).alias("pivot")
        of_part = entries.groupBy("value", part).agg(F.min("class").alias("low"), F.max("class").alias("high"), pivot)
        mixed_ones = of_part.groupBy("value").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.collect_list("pivot").alias("pivots"))
        entries = common.stage(entries.join(mixed_ones.where("low <> high").select("value", "pivots"), "value"), "open-buckets")
        # only pivots that a node may be alike to become rows
        alike = f"abs(n - p.n) <= floor({1 - least} * greatest(n, p.n) + 1e-9D)"
        met_here = entries.withColumn("pivots", F.expr(f"filter(pivots, p -> p.class <> class AND {alike})")).where("size(pivots) > 0")
        pivot = F.col("pivots")[0] if pivots == 1 else F.explode("pivots")
        pairs = met_here.select("node", "n", "class", pivot.alias("pivot"))
        first = F.col("node") > F.col("pivot.node")
        ends = [(c, F.col(c), F.col(f"pivot.{c}")) for c in ("node", "class")]
        larger, smaller = ([F.when(first, (x, y)[k]).otherwise((y, x)[k]).alias(n + e) for n, x, y in ends] for k, e in ((0, "_a"), (1, "_b")))
        pairs = pairs.select(*larger, *smaller).distinct().withColumnsRenamed({"node_a": "a", "node_b": "b"})
        pairs = common.stage(pairs.join(met, ["a", "b"], "left_anti") if met is not None else pairs, "pairs")
        links = _verified(pairs, words, least)
        met = pairs.select("a", "b") if met is None else met.unionByName(pairs.select("a", "b"))
        if links is None:
            break
        moved = components(links.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")))
        classes = _grown(classes, moved)
        further = moved.select(F.col("node").alias("class"), F.col("class").alias("to"))
        entries = entries.join(further, "class", "left").withColumn("class", F.coalesce("to", "class")).drop("to")
        more, pivots = links.count(), PIVOTS
        found += more
        if more < settled * found:
            break
        # other pairs of a pivot have been verified; `all_pairs` leaves them out as well
        entries = entries.where("NOT array_contains(pivots.node, node)").drop("pivots")
    if all_pairs:
        links = _verified(pairs_left(entries.drop("pivots"), met, least, block), words, least)
        if links is not None:
            classes = _grown(classes, components(links.select(F.col("class_a").alias("a"), F.col("class_b").alias("b"))))
    heads = nodes.select("node", F.col("node").alias("class")) if classes is None else nodes.select("node").join(classes, "node", "left")
    heads = common.stage(heads.select("node", F.coalesce("class", "node").alias("class")), "heads")
    few = heads.count() <= BROADCAST_NODES
    missed = pairs_missed(words.join(F.broadcast(heads) if few else heads, "node"), met, least, block, by_words=True)
    links = _verified(missed, words, least)
    if links is not None:
        classes = _grown(classes, components(links.select(F.col("class_a").alias("a"), F.col("class_b").alias("b"))))
    return classes if classes is not None else nodes.select("node", F.col("node").alias("class")).limit(0)


def classes_of(rows: DataFrame, least: float, all_pairs: bool = False) -> DataFrame:
    """For signatures: ``row, doc_id, same, class_id, class_size, kept``.

    The class id is its smallest ``doc_id``. Rows meet their class once, through the key of their words.
    """
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("row"))
    by_key = rows.groupBy("key").agg(F.min("row").alias("node"), F.min(order).alias("first"), F.count(F.lit(1)).alias("copies"))
    by_key = common.stage(by_key, "keys")
    own = rows.join(by_key.select(F.col("node").alias("row")), "row", "left_semi")
    nodes, words = own.select(F.col("row").alias("node"), "n", "sketch"), rows.select(F.col("row").alias("node"), "words")
    with common.arrow_rows(rows.sparkSession):
        found = node_classes(nodes, words, least, all_pairs)
    by_key = by_key.join(found, "node", "left").withColumn("class", F.coalesce("class", "node"))
    firsts = by_key.groupBy("class").agg(F.min("first").alias("first"), F.sum("copies").alias("class_size"))
    by_key = by_key.select("key", "class").join(firsts, "class")
    by_key = common.stage(by_key.select("key", F.col("first.doc_id").alias("class_id"), F.col("first.row").alias("stays"), "class_size"), "class-of-key")
    rows = rows.select("row", "doc_id", "same", "key").join(by_key, "key")
    return rows.select("row", "doc_id", "same", "class_id", "class_size", (F.col("stays") == F.col("row")).alias("kept"))


def near_duplicates(
    docs: DataFrame,
    least: float = SIMILARITY,
    sketches: int = SKETCHES,
    id_col: str = "doc_id",
    text_col: str = "text",
    exact: int = EXACT,
    all_pairs: bool = False,
) -> DataFrame:
    """One row per input row: ``doc_id, class_id, class_size, kept``; the class id is its smallest ``doc_id``."""
    return classes_of(signatures(docs, sketches, id_col, text_col, least, exact), least, all_pairs).drop("row", "same")


def deduplicate(
    docs: DataFrame,
    least: float = SIMILARITY,
    sketches: int = SKETCHES,
    id_col: str = "doc_id",
    text_col: str = "text",
    exact: int = EXACT,
    all_pairs: bool = False,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """The rows of ``docs`` that stay, one of each class, with their columns."""
    judged = classes_of(signatures(docs, sketches, id_col, text_col, least, exact), least, all_pairs)
    # rows are named by id and text: of rows with equal ones, all stay or go
    sums = judged.groupBy("same", "doc_id").agg(F.bool_or("kept").alias("kept"), F.count(F.lit(1)).alias("copies"))
    named = common.stage(sums, "judged")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"),
        F.col(f"`{id_col}`").alias("doc_id"),
        F.sha2(common.whole_text(text_col).cast("binary"), 256).alias("same"),
    )
    dropped = named.where("NOT kept").select(F.col("same").alias("gone"), F.col("doc_id").alias("gone_id"))
    if dropped.count() <= broadcast_rows:
        dropped = F.broadcast(dropped)
    rows = rows.join(dropped, (F.col("same") == F.col("gone")) & F.col("doc_id").eqNullSafe(F.col("gone_id")), "left_anti")
    if not named.where("kept AND copies > 1").isEmpty():
        rows = rows.dropDuplicates(["same", "doc_id"])
    return rows.select("whole.*")
