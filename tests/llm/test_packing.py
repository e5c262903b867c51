import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from evenkeel.llm import packing

FILE, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


def check(rows, documents, window=2048):
    """``documents``: ids of each by doc_id (unique there)."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert by_doc.keys() == documents.keys()
    for doc, pieces in by_doc.items():
        ids, at = documents[doc], 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids)
            own = np.asarray(ids[at : at + p["length"]], "<u4").tobytes()
            assert p["ids_crc32"] == zlib.crc32(own)
            assert p["ids"] is None or bytes(p["ids"]) == own
            at += p["length"]
        assert at == len(ids)
    unfilled = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window and len({p["tier"] for p in pieces}) == 1
        unfilled += at != pieces[0]["tier"]
    assert unfilled <= 1
    return by_sequence


def test_table(spark):
    texts = ["", None, "a b c", "word " * 5000, "x " * 300, "y" * 10_000] + [f"number {i} " * (i % 37) for i in range(300)]
    rows = [(i, t, "no", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tier string, start int").repartition(5)
    found = packing.pack(docs, FILE, RANKS, P.PATTERN, pool=5000, keep_ids=True)
    library = Tokenizer.from_file(FILE)
    check(
        [r.asDict() for r in found.collect()],
        {i: library.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(texts)},
    )


def test_several_levels(spark):
    docs = spark.range(0, 200, 1, 130).selectExpr("id AS doc_id", "repeat('w ', CAST(id AS int)) AS text")
    library = Tokenizer.from_file(FILE)
    rows = [r.asDict() for r in packing.pack(docs, FILE, RANKS, P.PATTERN).collect()]
    check(rows, {i: library.encode("w " * i, add_special_tokens=False).ids + [1] for i in range(200)})


def test_empty_repeated_and_without_id(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(docs, FILE, RANKS, P.PATTERN).count() == 0
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "doc_id long, text string")
    rows = packing.pack(docs, FILE, RANKS, P.PATTERN).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["1", "1", "None"]
    assert sorted(r.offset for r in rows) == [0, 2, 4]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 5000), min_size=1, max_size=60), st.integers(1, 9000))
def test_any_lengths(lengths, pool):
    packer = packing.Packer(0, 0, 2048, packing.TIERS, 8192, pool, True)
    documents = {}
    for doc, n in enumerate(lengths):
        documents[doc] = list(range(doc, doc + n))
        packer.add(doc, np.arange(doc, doc + n, dtype="<u4"))
    packer.end(True)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group", "cell", "ids"]
    rows = [dict(zip(names, r)) for r in packer.rows]
    check(rows, documents)


def test_step_groups_are_balanced():
    pieces = [packing.Piece(k, 0, np.zeros(100 + 37 * k % 1900, "<u4"), 0) for k in range(400)]
    filled, _ = packing.pack_pieces(pieces)
    groups = packing.step_groups(filled, 16_384)
    tokens, cost = defaultdict(int), defaultdict(int)
    for (tier, parts), g in zip(filled, groups):
        if g is not None:
            tokens[tier, g] += tier
            cost[tier, g] += sum(len(p.ids) ** 2 for p in parts)
    assert len({g for _, g in tokens}) > 10 and set(tokens.values()) == {16_384}
    for tier in {t for t, _ in tokens}:
        costs = [n for (t, _), n in cost.items() if t == tier]
        assert max(costs) <= 1.5 * min(costs)
        assert sum(t == tier and g is None for (t, _), g in zip(filled, groups)) < 16_384 // tier


def test_step_groups_go_on_from_one_flush_to_the_next():
    rng = np.random.default_rng(3)
    packer = packing.Packer(0, 0, 2048, packing.TIERS, packing.STEP, 300_000, False)
    for doc, n in enumerate(rng.integers(300, 9_000, 400).tolist()):
        packer.add(doc, np.zeros(n, "<u4"))
    packer.end(True)
    tier_of, tokens = {}, defaultdict(int)
    for row in packer.rows:
        tier_of[row[8]] = row[7]
        tokens[row[8]] += row[2]
    for tier in set(tier_of.values()):
        sizes = sorted(n for g, n in tokens.items() if tier_of[g] == tier)
        # all but the last of a tier are whole; the padded sequence is a group of its own
        assert all(n == packing.STEP for n in sizes[2 if tier == 2048 else 1 :])
    assert len(tokens) < sum(tokens.values()) / packing.STEP + 6
