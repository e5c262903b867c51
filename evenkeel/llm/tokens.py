"""Encoding of whole texts with a byte-level BPE vocabulary, by pieces between safe boundaries.

The split pattern of these vocabularies never matches across a single space that has other than white space on both
sides, except that the space starts the next match. Cutting there leaves all matches as they are. Pieces repeat, so
the library only encodes the distinct pieces of a batch; finding them and putting ids together is array work.

Long texts are cut where a match ends whatever follows: before white space, and between a letter and a mark. In a run of
white space the pattern takes all but the last character as one match (all of it at the end of the text). The library
fails on runs of about a million characters, so long runs are encoded as that one match, without the pattern.

NULL is not taken here: callers make it the empty text, which has no ids. Texts may be of any length, repeat, or
consist of white space only. An empty column gives an empty list. Ids are kept as little-endian unsigned 32-bit
integers in bytes.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space as the split pattern's library sees it.
BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Places where one match ends and another begins: before white space, and between a letter and a mark.
SAFE = re.compile(rf"(?<=[^{BLANK}])(?=[{BLANK}])|(?<=[A-Za-z\u4e00-\u9fa5\u3041-\u3096\u30a1-\u30fa\uac00-\ud7a3])(?=[,.;:!?。、，！？])")
#: Characters that are encoded in one call at most, if there is a safe place to cut.
LONG = 100_000
#: Runs of white space from this length on are encoded without the pattern.
RUN = re.compile(rf"[{BLANK}]{{10000,}}")

Encode = Callable[[str], Sequence[int]]


def packed(ids: Sequence[int]) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


def whole(text: str, encode: Encode, single: Encode, most: int = LONG, run: re.Pattern = RUN) -> bytes:
    """The ids of any text; long ones are cut at safe places into stretches of about ``most`` characters.

    ``encode`` gives the ids of a text, ``single`` those of one match of the pattern.
    """
    out, at = [], 0

    def stretch(end: int) -> None:
        nonlocal at
        while end - at > most and (cut := SAFE.search(text, at + most, end)) and cut.start() < end:
            out.append(packed(encode(text[at : cut.start()])))
            at = cut.start()
        if at < end:
            out.append(packed(encode(text[at:end])))
        at = end

    if len(text) > most:
        for blank in run.finditer(text):
            stretch(blank.start())
            # the last one may belong to the next match
            at = blank.end() - (blank.end() < len(text))
            out.append(packed(single(text[blank.start() : at])))
    stretch(len(text))
    return b"".join(out)


class PieceEncoder:
    """Whole texts to ids.

    ``encode`` gives the ids of a text and ``single`` those of one match, ``opens`` tells for each id whether its bytes
    start with a space. Pieces are encoded many at once; in a row of pieces exactly the first id of each starts with a
    space, as they hold no other.
    """

    def __init__(self, encode: Encode, single: Encode, opens: np.ndarray):
        self.encode, self.single, self.opens = encode, single, opens

    def _pieces(self, parts: list[str]) -> tuple[bytes, np.ndarray]:
        """Ids of all ``parts``, each with a space before it, and the number of ids of each."""
        raw, counts = [], []
        for at in range(0, len(parts), 5000):
            ids = np.asarray(self.encode(" " + " ".join(parts[at : at + 5000])), dtype="<u4")
            starts = np.flatnonzero(self.opens[ids])
            raw.append(ids.tobytes())
            counts.append(np.diff(np.append(starts, len(ids))))
        return b"".join(raw), np.concatenate([np.zeros(0, np.int64), *counts])

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """``texts`` hold no NULL."""
        lists = pc.split_pattern(texts.cast(pa.large_string()), " ")
        ends, flat = lists.offsets.to_numpy(), lists.values
        coded = flat.dictionary_encode()
        parts, index = coded.dictionary, coded.indices.to_numpy()
        clean = pc.and_(pc.not_equal(parts, ""), pc.equal(pc.utf8_trim_whitespace(parts), parts))
        clean = pc.and_(clean, pc.less_equal(pc.binary_length(parts), LONG)).to_numpy(False)
        raw, counts = self._pieces(parts.filter(pa.array(clean)).to_pylist())
        size = np.zeros(len(parts) + 1, np.int64)
        size[1:][clean] = 4 * counts
        buffers = [None, pa.py_buffer(np.cumsum(size)), pa.py_buffer(raw)]
        joined = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(parts), buffers).take(coded.indices)
        at, data = np.frombuffer(joined.buffers()[1], np.int64), memoryview(joined.buffers()[2] or b"")
        odd = np.append(0, np.cumsum(~clean[index]))
        out = []
        for k, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            if odd[a] != odd[b]:  # other white space than single spaces between other characters, or long pieces
                text = texts[k].as_py()
                out.append(whole(text, self.encode, self.single))
            else:
                out.append(packed(self.encode(flat[a].as_py())) + bytes(data[at[a + 1] : at[b]]))
        return out


def slices(texts: pa.Array, most: int = 3_000_000) -> Iterable[pa.Array]:
    """Runs of texts of about ``most`` bytes together, one text at least."""
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(False))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
        yield texts.slice(at, end - at)
        at = end


def small_batches(batches: Iterable[pa.RecordBatch], column: str, most: int = 3_000_000) -> Iterable[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of a text column together, one row at least."""
    for batch in batches:
        at = 0
        for texts in slices(batch.column(column), most):
            yield batch.slice(at, len(texts))
            at += len(texts)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


_LOADED: dict = {}


def loaded(key, make):
    """One object per Python worker."""
    if key not in _LOADED:
        _LOADED[key] = make()
    return _LOADED[key]


def rank_encoding(path: str, pattern: str):
    """The library's encoding for a local rank file, without special tokens."""

    def make():
        import tiktoken

        return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})

    return loaded(("ranks", path, pattern), make)


def vocabulary(path: str, pattern: str) -> pa.Array:
    """The bytes of every id."""
    size = rank_encoding(path, pattern).n_vocab

    def make():
        by_id = {i: token for token, i in read_ranks(path).items()}
        return pa.array([by_id.get(i) for i in range(size)], pa.large_binary())

    return loaded(("vocabulary", path), make)


def decoded(rows: pa.Array, known: pa.Array) -> pa.Array:
    """Binary ids to the bytes they stand for; an unknown id is an error."""
    raw = [x or b"" for x in rows.to_pylist()]
    taken = known.take(pa.array(np.frombuffer(b"".join(raw), dtype="<u4")))
    if taken.null_count:
        raise ValueError("an id has no token")
    at = np.frombuffer(taken.buffers()[1], np.int64) if len(taken) else np.zeros(1, np.int64)
    ends = np.cumsum([0, *(len(x) // 4 for x in raw)], dtype=np.int64)
    offsets = pa.py_buffer(np.ascontiguousarray(at[ends], dtype=np.int64))
    values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(raw), [None, offsets, taken.buffers()[2]])
    return values.cast(pa.binary())


def _opens(path: str, pattern: str) -> np.ndarray:
    """Which ids stand for bytes that start with a space."""
    return pc.fill_null(pc.starts_with(vocabulary(path, pattern), b" "), False).to_numpy(False)


def one_match(encoding) -> Encode:
    """Ids of a text that is one match of the pattern."""
    return lambda text: encoding._core_bpe.encode_single_piece(text.encode())


def rank_encoder(path: str, pattern: str) -> PieceEncoder:
    encoding = rank_encoding(path, pattern)

    def make():
        return PieceEncoder(encoding.encode_ordinary, one_match(encoding), _opens(path, pattern))

    return loaded(("pieces", path, pattern), make)


def file_encoder(path: str, ranks: str, pattern: str) -> PieceEncoder:
    """The ids of a tokenizer file, for a file whose vocabulary is also there as ranks.

    The ``tokenizers`` library takes about six times as long as ``tiktoken`` for the same ids, so it only encodes
    texts with a special token's string, where the two differ.
    """

    def make():
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer, encoding = Tokenizer.from_file(path), rank_encoding(ranks, pattern)
        special = re.compile("|".join(re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()) or "(?!)")

        def encode(text):
            if special.search(text):
                return tokenizer.encode(text, add_special_tokens=False).ids
            return encoding.encode_ordinary(text)

        opens = _opens(ranks, pattern)
        return PieceEncoder(encode, one_match(encoding), np.concatenate([opens, np.zeros(max(0, tokenizer.get_vocab_size() - len(opens)), bool)]))

    return loaded(("file", path, ranks, pattern), make)
