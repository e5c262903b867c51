"""Toxicity by compression distance: windows of a text against a dictionary of ordinary and one of toxic text.

Training, on the driver, from a bounded sample of labelled texts:

* the ordinary dictionary is trained by zstandard on windows of ordinary texts;
* the toxic one is trained by the same trainer on windows of toxic texts, reduced to what ordinary text doesn't explain:
  beginnings of words that stand after clearly more different words in toxic texts than in ordinary ones (copies of a
  text add nothing), each as long as it keeps most of its places. Windows as they are would teach it ordinary words
  again, as toxic text is ordinary text with some strings of its own. What it learnt follows the ordinary content, so
  that either dictionary holds ordinary words alike; a string counts once, and pieces that the trainer cut are left out;
* a window of ``WORDS`` words is compressed with either; the difference of the lengths is what toxic strings save. A
  saving counts by the thresholds that it reaches, quantiles of ordinary windows. A logistic curve over a text's savings
  is calibrated on the sample.

Scoring runs where the texts are, over all windows of the whole text. A text without words, so also NULL, has the
score of a text without savings. If the sample lacks one of the classes, every score is that of the other class, and 0
without any labels. Rows are scored on their own, so repeated rows score alike. Other columns are never looked at.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm import common
from evenkeel.llm.tokens import slices

#: Labelled texts of each class in the sample, and the bytes a text there has at most: 4 000 texts and 400 MB.
TOXIC_ROWS, ORDINARY_ROWS, SAMPLE_BYTES = 1_000, 3_000, 100_000
#: Words of a window; bytes of the ordinary dictionary; windows it is trained on.
WORDS, DICTIONARY, TRAINING_WINDOWS = 12, 16_384, 40_000
#: Lengths of beginnings of words; places a toxic one needs; how much likelier it is (log), alone and times places.
SHORTEST, LONGEST, PLACES, RATIO, EVIDENCE = 4, 10, 5, 2.0, 25.0
#: Such beginnings that windows are reduced to, the strongest, and bytes that are trained from them.
STRINGS, TOXIC_DICTIONARY, PASSES = 1_000, 8_192, 5
#: Bytes from which a beginning stands alone, without the longer ones.
ALONE = 6
#: Matches shorter than this don't count.
MATCH = 5
#: Shares of ordinary windows that save less than each threshold; the least threshold in bytes.
QUANTILES, LEAST = (0.95, 0.985, 0.995), 2.0

WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def windows(text: str) -> list[bytes]:
    """Windows of words, one at least."""
    own = words(text)
    return [(" " + " ".join(own[at : at + WORDS]) + " ").encode() for at in range(0, max(1, len(own)), WORDS)]


def _beginnings(texts: list[str]) -> Iterator[tuple[str, str]]:
    """Beginnings of words, and the word before."""
    for text in texts:
        before = ""
        for word in words(text):
            for n in range(SHORTEST, min(len(word), LONGEST) + 1):
                yield word[:n], before
            before = word


def _places(texts: list[str], only: set[int] | None) -> tuple[dict[int, int], dict[int, str]]:
    """How many different words stand before each beginning, by hash; with names for those with enough places."""
    starts, befores = array("q"), array("q")
    for start, before in _beginnings(texts):
        h = hash(start)
        if only is None or h in only:
            starts.append(h)
            befores.append(hash(before))
    first = np.frombuffer(starts, np.int64)
    _, at = np.unique(first * 1_000_003 + np.frombuffer(befores, np.int64), return_index=True)
    kinds, counts = np.unique(first[at], return_counts=True)
    enough = counts >= (PLACES if only is None else 1)
    found = dict(zip(kinds[enough].tolist(), counts[enough].tolist(), strict=True))
    names = {hash(s): s for s, _ in _beginnings(texts) if hash(s) in found} if only is None else {}
    return found, names


def toxic_strings(toxic: list[str], ordinary: list[str]) -> list[str]:
    """The beginnings of words that mark toxic texts, the strongest first."""
    here, names = _places(toxic, None)
    there, _ = _places(ordinary, set(here))
    sizes = [1 + sum(len(words(t)) for t in texts) for texts in (toxic, ordinary)]
    strength = {}
    for h, n in here.items():
        ratio = math.log((n + 0.5) / sizes[0] * sizes[1] / (there.get(h, 0) + 0.5))
        if ratio > RATIO and n * ratio >= EVIDENCE:
            strength[names[h]] = n, n * ratio
    # a beginning that goes on in the same way nearly everywhere is left to the longer one
    most_after: dict[str, int] = {}
    for s, (n, _) in strength.items():
        most_after[s[:-1]] = max(n, most_after.get(s[:-1], 0))
    chosen: list[str] = []
    enough: set[str] = set()
    for s in sorted(strength, key=len):
        # what follows a beginning that is long enough to save much also stands in ordinary words
        if most_after.get(s, 0) < 0.8 * strength[s][0] and not any(s[:n] in enough for n in range(SHORTEST, len(s))):
            chosen.append(s)
            if len(s.encode()) >= ALONE:
                enough.add(s)
    return sorted(chosen, key=lambda s: (-strength[s][1], s))[:STRINGS]


def toxic_dictionary(toxic: list[str], ordinary: list[str]) -> bytes:
    """What the trainer learns from the windows of toxic texts, reduced to strings that mark them.

    It is trained in passes: what one pass learnt is taken out of the windows of the next. The strongest strings stand
    last, where they are nearest to the window.
    """
    strongest = toxic_strings(toxic, ordinary)
    strings = set(strongest)
    reduced = []
    for window in sorted({w for t in toxic for w in windows(t)}):
        begun = [max((w[:n] for n in range(SHORTEST, LONGEST + 1) if w[:n] in strings), key=len, default="") for w in window.decode().split()]
        reduced.append([s for s in begun if s])
    found: set[str] = set()
    for _ in range(PASSES):
        samples = ["".join(f" {s}" for s in row) + " " for row in ([s for s in row if s not in found] for row in reduced) if row]
        learnt = _trained([s.encode() for s in samples], TOXIC_DICTIONARY).decode("utf-8", "replace").split()
        more = strings & set(learnt) - found
        if not more:
            break
        found |= more
    return "".join(" " + s for s in reversed(strongest) if s in found).encode()


def _trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary of at most ``size`` bytes; the library asks for more samples than there may be for that size."""
    while size >= 256:
        try:
            return zstandard.train_dictionary(size, samples, k=64, d=6).as_bytes()
        except zstandard.ZstdError:
            size //= 2
    return b"".join(dict.fromkeys(samples))


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    settings = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_DFAST, min_match=MATCH, window_log=16, hash_log=15, chain_log=15,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(compression_params=settings, dict_data=raw)


@dataclass
class Model:
    """What scoring needs; a few dozen kilobytes."""

    ordinary: bytes
    toxic: bytes
    large: tuple[float, ...]
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    constant: float | None = None

    def savings(self, text: str, pair) -> np.ndarray:
        plain, toxic = pair
        return np.array([len(plain.compress(w)) - len(toxic.compress(w)) for w in windows(text)])

    def compressors(self):
        return _compressor(self.ordinary), _compressor(self.toxic)

    def features(self, savings: np.ndarray) -> list[float]:
        n = len(savings)
        out = [np.maximum(savings - 1, 0).sum() / (4 + n), min(savings.max(), 12), math.log(1 + n)]
        for least in self.large:
            count = (savings >= least).sum()
            out += [count / (4 + n), min(count, 6), float(count > 0)]
        return out

    def scores(self, texts: list[str]) -> list[float]:
        if self.constant is not None:
            return [self.constant] * len(texts)
        pair = self.compressors()
        rows = np.array([self.features(self.savings(t, pair)) for t in texts]).reshape(len(texts), -1)
        return (1 / (1 + np.exp(-self._logits(rows)))).tolist()

    def _logits(self, rows: np.ndarray) -> np.ndarray:
        inputs = np.c_[np.ones(len(rows)), (rows - self.center) / self.scale]
        # row by row, so that equal texts score alike in any batch
        return np.clip((inputs * self.weights).sum(axis=1), -30, 30)


def _logistic(rows: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Weights by Newton's method, slightly held back."""
    weights, back = np.zeros(rows.shape[1]), 0.01
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ weights, -30, 30)))
        slope = rows.T @ (p - labels) + back * weights
        weights -= np.linalg.solve((rows.T * (p * (1 - p))) @ rows + back * np.eye(len(weights)), slope)
    return weights


def train(toxic: list[str], ordinary: list[str]) -> Model:
    """The order of the texts doesn't matter."""
    toxic, ordinary = sorted(toxic), sorted(ordinary)
    none = np.zeros(0)
    if not toxic or not ordinary:
        return Model(b"", b"", (), none, none, none, 1.0 if toxic else 0.0)
    seen = [w for t in ordinary for w in windows(t)]
    seen = seen[:: max(1, len(seen) // TRAINING_WINDOWS)]
    content = _trained(seen, DICTIONARY)[-DICTIONARY:]
    model = Model(content, content + toxic_dictionary(toxic, ordinary), (), none, none, none)
    pair = model.compressors()
    savings = [model.savings(t, pair) for t in ordinary + toxic]
    model.large = tuple(np.maximum(LEAST, np.quantile(np.concatenate(savings[: len(ordinary)]), QUANTILES)).tolist())
    rows = np.array([model.features(s) for s in savings])
    model.center, model.scale = rows.mean(0), rows.std(0) + 1e-9
    labels = np.repeat([0.0, 1.0], [len(ordinary), len(toxic)])
    model.weights = _logistic(np.c_[np.ones(len(rows)), (rows - model.center) / model.scale], labels)
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from: CRC-32 of the id as text leaves remainder 0 by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text"):
    """Bounded lists of toxic and ordinary texts. An id with several labels has the one most rows give."""
    known = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    known = known.where("doc_id IS NOT NULL AND label IS NOT NULL").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.avg("label") > 0.5).alias("toxic"))
    texts = common.text_of(docs, id_col, text_col).where(F.octet_length("text") <= SAMPLE_BYTES)
    out = []
    for toxic, most in ((True, TOXIC_ROWS), (False, ORDINARY_ROWS)):
        ids = known.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id").limit(most)
        rows = texts.join(F.broadcast(ids), "doc_id").orderBy(F.xxhash64("doc_id"), "text").limit(most)
        out.append([r["text"] for r in rows.collect()])
    return out


def fit(docs: DataFrame, labels: DataFrame, **columns: str) -> Model:
    return train(*sample(docs, labels, **columns))


def batch_scores(texts: pa.Array, model: Model) -> pa.Array:
    """The scores of a batch; only a few million bytes of its text are strings at a time."""
    return pa.array([x for some in slices(texts) for x in model.scores(some.to_pylist())], pa.float64())


def score(text: Column, model: Model) -> Column:
    """The score of a text column, 0 to 1."""

    def run(batches):
        for batch in batches:
            yield batch_scores(batch.fill_null(""), model)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "double")(text)


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``."""
    rows = common.text_of(docs, id_col, text_col).select("doc_id", score(F.col("text"), model).alias("score"))
    return rows.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def keep_ordinary(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below 0.5."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    whole = docs.select(F.struct(*names).alias("whole"), common.whole_text(text_col).alias("text"))
    return whole.where(score(F.col("text"), model) < 0.5).select("whole.*")
