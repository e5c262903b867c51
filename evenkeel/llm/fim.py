"""Fill-in-middle by displacement scatter: whole batches of texts are rearranged with array operations on their bytes.

A text is cut into units: white space and the word after it, or white space at the end. Two cuts, chosen by a hash of
the seed and the id, part it into prefix, middle and suffix. In the form ``psm`` the output is the marks and parts
P prefix S suffix M middle, in ``spm`` S suffix P prefix M middle, in ``plain`` the text itself.

The cuts of all texts of a batch come from one scan of its bytes. Within a part all bytes move equally far, so the places
where parts begin, with the change of the shift there, are a difference array; its running sum is the shift of
every byte, and one scatter writes all outputs. The inverse looks up the marks in the outputs, builds the running sum
over the outputs' bytes, and one gather gives the texts back: it needs output and form only.

White space is the blank and the bytes 9 to 13, none of which is part of another UTF-8 character, so scanning bytes
finds the units of code points. A text that holds a mark stays plain, so marks in other outputs are unique. NULL is
the empty text, which is plain; a NULL id is hashed as the empty string. Rows with equal ids get equal hashes, each with
its own cuts. An empty table gives no rows. Texts may be as long as a column allows: a batch is taken in stretches of
a few million bytes, one text at least. Only id and text are looked at, whatever other columns there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm import common
from evenkeel.llm.tokens import slices

MARKS = ("<P>", "<S>", "<M>")
SEED, RATE, SPM = 42, 50, 80
PLAIN, PSM, SPM_FORM = range(3)
FORMS = ("plain", "psm", "spm")
#: Parts of the text in the order of the output, and the mark before each: prefix, middle, suffix are 0, 1, 2.
ORDERS = {PSM: (0, 2, 1), SPM_FORM: (2, 0, 1)}
MARK_OF = {0: 0, 2: 1, 1: 2}

CUT = "doc_id {id}, n long, form string, prefix_chars long, middle_chars long, output string"


def hashes(seed: int, id_col: str = "doc_id", count: int = 4) -> list[Column]:
    """The first groups of eight hexadecimal digits of the SHA-256 of seed and id, as numbers."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    hexadecimal = F.sha2(text.cast("binary"), 256)
    return [F.conv(F.substring(hexadecimal, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(count)]


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each begins, with the end of the last."""
    texts = texts.cast(pa.large_binary())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]], at - at[0]


def texts_from(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """Texts from their bytes; the other way round than ``flat``."""
    buffers = [None, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(data)]
    return pa.LargeStringArray.from_buffers(len(at) - 1, *buffers[1:]).cast(pa.string())


def unit_ends(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where units end, for all texts one after the other, and how many come before each text's, with the sum of all."""
    word = (data != 32) & ((data < 9) | (data > 13))
    ends = np.zeros(len(data) + 1, bool)
    ends[1:-1] = word[:-1] & ~word[1:]
    ends[at[1:][np.diff(at) > 0]] = True
    places = np.flatnonzero(ends)
    return places, np.searchsorted(places, at, side="right")


def moved(starts: np.ndarray, shifts: np.ndarray, size: int) -> np.ndarray:
    """Where each of ``size`` bytes goes: the running sum of a difference array.

    ``starts`` are the places where parts begin, in order (empty parts begin where the next one does), from the first
    byte on; ``shifts`` how far the bytes of each part move.
    """
    step = np.ones(size + 1, np.int64)
    step[0] = 0
    np.add.at(step, starts, np.diff(shifts, prepend=0))
    return np.cumsum(step[:-1], out=step[:-1])


def _marks(marks: tuple[str, ...]) -> list[np.ndarray]:
    return [np.frombuffer(m.encode(), np.uint8) for m in marks]


def rearranged(data: np.ndarray, at: np.ndarray, cuts: np.ndarray, form: np.ndarray, marks: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The outputs' bytes and where each begins. ``cuts`` holds the ends of prefix and middle per text, as places."""
    coded = _marks(marks)
    begins = np.stack([at[:-1], cuts[:, 0], cuts[:, 1]], axis=1)
    sizes = np.diff(np.concatenate([begins, at[1:, None]], axis=1), axis=1)
    out_at = np.append(0, np.cumsum(np.diff(at) + np.where(form == PLAIN, 0, sum(map(len, coded)))))
    targets, mark_at = begins - at[:-1, None] + out_at[:-1, None], []
    for kind, order in ORDERS.items():
        own = np.flatnonzero(form == kind)
        place = out_at[own]
        for part in order:
            mark = coded[MARK_OF[part]]
            mark_at.append((mark, place))
            targets[own, part] = place + len(mark)
            place = place + len(mark) + sizes[own, part]
    out = np.empty(int(out_at[-1]), np.uint8)
    if len(data):
        out[moved(begins.ravel(), (targets - begins).ravel(), len(data))] = data
    for mark, places in mark_at:
        for k, byte in enumerate(mark.tolist()):
            out[places + k] = byte
    return out, out_at


def _found(data: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """All places where ``mark`` begins."""
    if len(data) < len(mark):
        return np.zeros(0, np.int64)
    end = len(data) - len(mark) + 1
    places = np.flatnonzero(data[:end] == mark[0])
    for k in range(1, len(mark)):
        places = places[data[places + k] == mark[k]]
    return places


def put_back(data: np.ndarray, at: np.ndarray, form: np.ndarray, marks: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes and where each begins, from the outputs' bytes and forms alone."""
    coded = _marks(marks)
    lengths = np.diff(at)
    texts_at = np.append(0, np.cumsum(lengths - np.where(form == PLAIN, 0, sum(map(len, coded)))))
    cut = np.flatnonzero(form != PLAIN)
    # where each text's marks begin in the output: one of a kind in each that is not plain
    places = np.zeros((len(form), 3), np.int64)
    for kind, mark in enumerate(coded):
        found = _found(data, mark)
        owner = np.searchsorted(at, found, side="right") - 1
        inside = (form[owner] != PLAIN) & (found + len(mark) <= at[owner + 1])
        found, owner = found[inside], owner[inside]
        if len(owner) != len(cut) or (owner != cut).any():
            raise ValueError("an output does not hold each mark once")
        places[cut, kind] = found
    # a text's bytes come from these parts of the output, in the order of the text
    sources = np.tile(at[:-1, None], (1, 3))
    sizes = np.zeros((len(form), 3), np.int64)
    sizes[form == PLAIN, 0] = lengths[form == PLAIN]
    for kind, order in ORDERS.items():
        own = np.flatnonzero(form == kind)
        for k, part in enumerate(order):
            start = places[own, MARK_OF[part]] + len(coded[MARK_OF[part]])
            end = places[own, MARK_OF[order[k + 1]]] if k < 2 else at[own + 1]
            sources[own, part], sizes[own, part] = start, end - start
    begins = texts_at[:-1, None] + np.cumsum(sizes, axis=1) - sizes
    size = int(texts_at[-1])
    return (data[moved(begins.ravel(), (sources - begins).ravel(), size)] if size else data[:0]), texts_at


def _cuts(data: np.ndarray, at: np.ndarray, h: list[np.ndarray], rate: int, spm: int, marks: tuple[str, ...]):
    ends, before = unit_ends(data, at)
    n = np.diff(before)
    first, second = h[0] % (n + 1), h[1] % (n + 1)
    padded = np.append(ends, 0)

    def cut(units):
        return np.where(units == 0, at[:-1], padded[np.minimum(before[:-1] + units - 1, len(ends))])

    cuts = np.stack([cut(np.minimum(first, second)), cut(np.maximum(first, second))], axis=1)
    plain = (n == 0) | (h[2] % 100 >= rate)
    for mark in _marks(marks):
        places = _found(data, mark)
        owner = np.searchsorted(at, places, side="right") - 1
        plain[owner[places + len(mark) <= at[owner + 1]]] = True
    form = np.where(plain, PLAIN, np.where(h[3] % 100 < spm, SPM_FORM, PSM))
    return n, cuts, form


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm: int = SPM,
    marks: tuple[str, str, str] = MARKS,
) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output``; code points of the parts are NULL in plain outputs.

    ``rate`` of a hundred texts are rearranged, ``spm`` of a hundred of these as ``spm``; ``marks`` stand before
    prefix, suffix and middle, none is part of another, and no end of one is the beginning of another.
    """
    texts = common.text_of(docs, id_col, text_col)
    kind = texts.schema["doc_id"].dataType.simpleString()
    texts = texts.select("doc_id", "text", *hashes(seed))

    def run(batches):
        for batch in batches:
            at = 0
            for some in slices(batch.column("text")):
                own = batch.slice(at, len(some))
                at += len(some)
                data, starts = flat(some)
                h = [own.column(f"h{i}").to_numpy() for i in (1, 2, 3, 4)]
                n, cuts, form = _cuts(data, starts, h, rate, spm, marks)
                out, out_at = rearranged(data, starts, cuts, form, marks)
                # code points begin at all bytes but those from 0x80 to 0xBF
                points = np.append(0, np.cumsum((data & 0xC0) != 0x80))
                plain = form == PLAIN
                chars = points[np.concatenate([starts[:-1, None], cuts], axis=1)]
                columns = [
                    own.column("doc_id"), pa.array(n, pa.int64()), pa.array(FORMS).take(pa.array(form)),
                    pa.array(chars[:, 1] - chars[:, 0], pa.int64(), mask=plain), pa.array(chars[:, 2] - chars[:, 1], pa.int64(), mask=plain),
                    texts_from(out, out_at),
                ]
                yield pa.RecordBatch.from_arrays(columns, [c.split(" ")[0] for c in CUT.split(", ")])

    return texts.mapInArrow(run, CUT.format(id=kind))


def restored(rows: DataFrame, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """``rows`` of ``fill_in_middle`` with the texts put back from ``output`` and ``form`` as ``text``."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", text string"

    def run(batches):
        for batch in batches:
            at = 0
            for some in slices(batch.column("output")):
                own = batch.slice(at, len(some))
                at += len(some)
                data, starts = flat(some)
                form = np.array([FORMS.index(f) for f in own.column("form").to_pylist()], np.int64)
                text = texts_from(*put_back(data, starts, form, marks))
                yield pa.RecordBatch.from_arrays([*own.columns, text], [*own.schema.names, "text"])

    return rows.mapInArrow(run, schema)


ORACLE = r"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents
), chosen AS (
  SELECT *, len(units) AS n, CAST('0x' || h[1:8] AS UBIGINT) % (len(units) + 1) AS c1, CAST('0x' || h[9:16] AS UBIGINT) % (len(units) + 1) AS c2,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
        OR CAST('0x' || h[17:24] AS UBIGINT) % 100 >= 50 THEN 'plain'
      WHEN CAST('0x' || h[25:32] AS UBIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM hashed
), cut AS (
  SELECT *, array_to_string(units[1:least(c1, c2)], '') AS p, array_to_string(units[least(c1, c2) + 1:greatest(c1, c2)], '') AS m,
    array_to_string(units[greatest(c1, c2) + 1:], '') AS s
  FROM chosen
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END)
    AS output_sha256, sha256(text) AS restored_sha256
FROM cut
"""
