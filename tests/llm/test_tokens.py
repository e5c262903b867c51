import re

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from evenkeel.llm import bpe, tokens

MULTI, RANKS, FILE = (P.path(f) for f in ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"))
LIBRARY = Tokenizer.from_file(FILE)
TEXTS = [
    "", " ", "a", "  a  b ", "don't  stop\n\n now", "a b   c", "x\x1c y", "日本語 テキスト、です", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>",
    "one two,\nThree 4.5!", "\n", "a" * 3000, "é\r\n é", "a \tb", "　x y　 z", "it's we'll 's 't", "🙂🙂 🙂",
]


def plain(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_ranks_as_the_library():
    want = tokens.rank_encoding(MULTI, P.PATTERN)
    got = tokens.rank_encoder(MULTI, P.PATTERN)(pa.array(TEXTS))
    assert [plain(x) for x in got] == [want.encode_ordinary(t) for t in TEXTS]


def test_file_as_the_library():
    got = tokens.file_encoder(FILE, RANKS, P.PATTERN)(pa.array(TEXTS))
    assert [plain(x) for x in got] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in TEXTS]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab' .\n\t  é1s,日")), max_size=30), max_size=5))
def test_any_text(texts):
    column = pa.array(texts, pa.string())
    want = tokens.rank_encoding(MULTI, P.PATTERN)
    got = tokens.rank_encoder(MULTI, P.PATTERN)(column)
    assert [plain(x) for x in got] == [want.encode_ordinary(t) for t in texts]
    back = tokens.decoded(pa.array(got, pa.binary()), tokens.vocabulary(MULTI, P.PATTERN)).to_pylist()
    assert back == [t.encode() for t in texts]
    got = tokens.file_encoder(FILE, RANKS, P.PATTERN)(column)
    assert [plain(x) for x in got] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab' .\n\t  \x85\x1c\u3000é1s,日。！")), max_size=120), st.integers(1, 40), st.integers(2, 4))
def test_long_texts_are_cut_at_safe_places(text, most, run):
    want = tokens.rank_encoding(MULTI, P.PATTERN)
    blanks = re.compile(rf"[{tokens.BLANK}]{{{run},}}")
    assert plain(tokens.whole(text, want.encode_ordinary, tokens.one_match(want), most, blanks)) == want.encode_ordinary(text)


N = 2_000_000
LONG_TEXTS = [
    "a" + " " * N + "b", " " * N, "\n" * N, "a b" + "\n" * N, "a" * N, "世" * (N // 4), "世界。" * (N // 8), "x\n" * (N // 4), "a b  c " * (N // 8),
    "\u3000" * (N // 2) + "\u3000x" + " " * N + "\n",
]


@pytest.mark.parametrize("text", LONG_TEXTS, ids=range(len(LONG_TEXTS)))
def test_very_long_texts_match_by_match(text):
    """The matches are found with another library; each alone is encoded as the encoding's library does."""
    known = {}
    want = tokens.rank_encoding(MULTI, P.PATTERN)
    single = tokens.one_match(want)
    for match in regex.finditer(P.PATTERN, text):
        own = match.group()
        if own not in known:
            known[own] = single(own) if len(own) > 1000 else want.encode_ordinary(own)
    got = plain(tokens.rank_encoder(MULTI, P.PATTERN)(pa.array([text, "a b"]))[0])
    assert got == [i for match in regex.finditer(P.PATTERN, text) for i in known[match.group()]]
    assert want.decode_bytes(got) == text.encode()


def test_slices_hold_every_text_once():
    texts = pa.array(["x" * n for n in (0, 5, 100, 1, 1, 0)])
    assert [t for s in tokens.slices(texts, 10) for t in s.to_pylist()] == texts.to_pylist()


def test_decoding_needs_no_valid_text():
    raw = tokens.packed([tokens.read_ranks(MULTI)[b"\xff"]])
    known = tokens.vocabulary(MULTI, P.PATTERN)
    assert tokens.decoded(pa.array([raw, None, b""], pa.binary()), known).to_pylist() == [b"\xff", b"", b""]
    with pytest.raises(ValueError):
        tokens.decoded(pa.array([tokens.packed([50256])], pa.binary()), pa.array([b"a"] * 50256 + [None], pa.large_binary()))


def test_round_trip_of_a_table(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, None, None), (0, TEXTS[3], "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    found = bpe.round_trip(docs, MULTI, P.PATTERN).collect()
    want = tokens.rank_encoding(MULTI, P.PATTERN)
    assert [(r.doc_id, plain(r.ids), r.n_tokens, bytes(r.decoded)) for r in found] == [
        (i, want.encode_ordinary(t or ""), len(want.encode_ordinary(t or "")), (t or "").encode()) for i, t, _ in rows
    ]
    assert bpe.round_trip(docs.limit(0), MULTI, P.PATTERN).count() == 0


def test_round_trip_needs_one_worker_for_each_task(spark, capsys):
    docs = spark.createDataFrame([(0, "a b")], "doc_id long, text string")
    bpe.round_trip(docs, MULTI, P.PATTERN).explain()
    plan = capsys.readouterr().out
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan


def test_small_batches_hold_every_row_once():
    batch = pa.RecordBatch.from_pydict({"id": [1, 2, 3, 4], "text": ["x" * n for n in (5, 100, 1, 0)]})
    found = list(tokens.small_batches([batch, batch.slice(0, 0)], "text", 10))
    assert [b.num_rows for b in found] == [1, 1, 2] and pa.Table.from_batches(found).to_pydict() == batch.to_pydict()
