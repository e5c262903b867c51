import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evenkeel.llm import common
from evenkeel.llm import near_dedup as N


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=40), st.lists(st.integers(0, 4), max_size=40), st.integers(0, 45))
def test_distance_as_by_brute_force(a, b, most):
    d = slow_distance(a, b)
    assert N.distance(np.array(a, np.uint32), np.array(b, np.uint32), most) == min(d, most + 1)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=30, max_size=120), st.data())
def test_distance_of_edited_rows(a, data):
    b = list(a)
    for _ in range(data.draw(st.integers(0, 12))):
        at, kind = data.draw(st.integers(0, len(b) - 1)), data.draw(st.sampled_from("ids"))
        b[at : at + 1] = {"i": [b[at], 77], "d": [], "s": [88]}[kind] if len(b) > 1 else [b[at]]
    assert N.distance(np.array(a, np.uint32), np.array(b, np.uint32), 30) == min(slow_distance(a, b), 31)


def test_sketches_keep_the_order_of_the_text():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 400, dtype=np.uint64)
    swapped = np.concatenate([a[200:], a[:200]])
    same = (N.sketch(a, 200) == N.sketch(swapped, 200)).mean()
    assert 0.3 < same < 0.7  # as sets of shingles they are almost equal, as rows half of the pairs change their order
    assert (N.sketch(a, 50) == N.sketch(a, 50)).all() and len(set(N.sketch(a, 50).tolist())) == 50
    assert len(N.sketch(a[:0])) == 0 and len(N.sketch(a[:1])) == N.SKETCHES


def test_repeated_shingles_are_labelled():
    runs = np.array([5, 7, 5, 5, 7], np.uint64)
    assert len(set(N.labelled(runs).tolist())) == 5
    assert (N.labelled(runs)[:2] == N.labelled(runs[:2])).all()


def corpus(seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts, truth = [], []
    passage = [word() for _ in range(60)]
    for group in range(40):
        base = [word() for _ in range(rng.choice((40, 120, 400)))]
        if group % 3 == 0:
            base[20:20] = passage
        for copy in range(rng.choice((1, 1, 2, 5, 30))):
            own = list(base)
            for _ in range(len(base) // 40 if copy else 0):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own))
            truth.append(group)
    return texts, truth


def brute(texts):
    """Components of all pairs that are similar."""
    rows = [N.WORD.findall((t or "").lower()) for t in texts]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = rows[i], rows[j]
            longest = max(len(a), len(b))
            if (not a and not b and (texts[i] or "") == (texts[j] or "")) or (
                longest and abs(len(a) - len(b)) <= 0.2 * longest and len(set(a) & set(b)) > 0.3 * len(set(a)) and slow_distance(a, b) <= 0.2 * longest
            ):
                parent[top(i)] = top(j)
    return [top(i) for i in range(len(rows))]


def partition(labels):
    groups = defaultdict(set)
    for i, label in labels:
        groups[label].add(i)
    return sorted(map(sorted, groups.values()))


@pytest.fixture(scope="module")
def made():
    texts, _ = corpus()
    texts += [None, "", "...", "!!!", "...", "one two", "One, two!", "one two three", texts[0], texts[0].upper()]
    return texts, partition(enumerate(brute(texts)))


@pytest.mark.parametrize("all_pairs", [False, True])
def test_classes_as_by_brute_force(spark, made, all_pairs):
    texts, want = made
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, key string, row int")
    found = N.near_duplicates(docs.repartition(5), all_pairs=all_pairs).collect()
    assert partition((r.doc_id, r.class_id) for r in found) == want
    sizes = {min(g): len(g) for g in want}
    assert all(r.class_size == sizes[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in found)


def test_deduplicate(spark, made):
    texts, want = made
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, "some other text of its own here", "y", 2), (None, "some other text of its own here", "y", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, same string, kept int")
    for most in (0, 1000):
        kept = N.deduplicate(docs, broadcast_rows=most)
        assert kept.columns == docs.columns
        assert sorted(str(r.doc_id) for r in kept.collect()) == sorted([*(str(min(g)) for g in want), "None"])


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert N.near_duplicates(docs).count() == 0 and N.deduplicate(docs).count() == 0


def edited(rng, base, share):
    """A text with that share of its words replaced by new ones."""
    own = list(base)
    for at in rng.sample(range(len(own)), round(share * len(own))):
        own[at] = f"new{rng.randrange(10**9)}"
    return own


@pytest.mark.parametrize("first", [True, False])
def test_star_of_variants_alike_only_to_their_centre(spark, first):
    rng = random.Random(7)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts = [" ".join(edited(rng, base, 0.14)) for _ in range(150)]
    texts.insert(0 if first else len(texts), " ".join(base))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    found = N.near_duplicates(docs, sketches=200).collect()
    assert {(r.class_id, r.class_size) for r in found} == {(0, len(texts))}


COUNTS = np.random.default_rng(2).integers(0, 5, 64)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=N.EXACT), st.sampled_from([0.5, 0.8, 0.9]), st.data())
def test_similar_texts_of_few_words_share_a_key(a, least, data):
    b = list(a)
    for _ in range(data.draw(st.integers(0, int(len(a) * (1 - least)) + 1))):
        at = data.draw(st.integers(0, len(b) - 1))
        b[at : at + 1] = data.draw(st.sampled_from([[b[at], 77], [88]] + ([[]] if len(b) > 1 else [])))
    x, y = np.array(a, np.uint64), np.array(b, np.uint64)
    if max(len(x), len(y)) <= N.EXACT and N.similar(x, y, least) and a != b:
        own = [{*N.keys(z, 1, least, counts=COUNTS).tolist()} - {*N.sketch(z, 1).tolist()} for z in (x, y)]
        assert own[0] & own[1]


@pytest.mark.parametrize(("n", "recall"), [(5, 1), (6, 1), (20, 1), (50, 1), (60, 0.9), (100, 0.9), (300, 0.92)])
def test_candidates_at_the_threshold(n, recall):
    rng = np.random.default_rng(n)
    hits = 0
    for _ in range(300):
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        b = a.copy()
        b[rng.choice(n, n // 5, replace=False)] += np.uint64(1)
        hits += bool(set(N.keys(a).tolist()) & set(N.keys(b).tolist()))
    assert hits >= recall * 300


def test_common_pairs_of_words_are_no_keys(spark):
    rng = random.Random(5)
    texts = [f"all the same {rng.randrange(10**9)} and {rng.randrange(10**9)} {rng.randrange(10**9)} here too" for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = N.signatures(docs, 8, "doc_id", "text")
    nodes = rows.selectExpr("row AS node", "n", "sketch")
    # pairs of words that all texts hold would give buckets of 300
    assert N.shared_keys(nodes).where("size > 100").count() == 0
    counts = N.run_counts(docs)
    assert counts.sum() == 300 * 8 and (counts >= 300).sum() >= 3


def test_rounds_go_on_in_buckets_of_several_classes(spark):
    # two groups and single texts with one passage in common: only one of them can hold the first pivot
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = [word() for _ in range(60)]
    groups = [[word() for _ in range(50)] for _ in range(12)]
    texts = [" ".join(passage + edited(rng, g, 0.06)) for g in groups for _ in range(5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    found = N.near_duplicates(docs).collect()
    assert partition((r.doc_id, r.class_id) for r in found) == [list(range(5 * g, 5 * g + 5)) for g in range(12)]


@pytest.mark.parametrize("block", [2, 1000])
def test_all_pairs_left(spark, block):
    own, n = {0: 0, 1: 0, 2: 0}, [10, 10, 9, 10, 8, 7, 10]
    rows = [(v, i, k, 7, own.get(i, i)) for v in (1, 2) for i, k in enumerate(n)]
    entries = spark.createDataFrame(rows, "value long, node long, n int, size long, class long")
    met = spark.createDataFrame([(3, 0)], "a long, b long")
    found = sorted(tuple(r)[:2] for r in N.pairs_left(entries, met, 0.8, block).collect())
    want = [(a, b) for a in range(7) for b in range(a) if own.get(a, a) != own.get(b, b) and abs(n[a] - n[b]) <= int(0.2 * max(n[a], n[b]) + 1e-9)]
    assert found == [p for p in want if p != (3, 0)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=120), st.sampled_from([0.5, 0.8, 0.9]), st.data())
def test_similar_texts_share_rare_runs(a, least, data):
    b = list(a)
    for _ in range(data.draw(st.integers(0, int(len(a) * (1 - least)) + 1))):
        at = data.draw(st.integers(0, len(b) - 1))
        b[at : at + 1] = data.draw(st.sampled_from([[b[at], 77], [88]] + ([[]] if len(b) > 1 else [])))
    x, y = np.array(a, np.uint32), np.array(b, np.uint32)
    if N.similar(x, y, least) and a != b:
        ranks = COUNTS.astype(np.float32)
        shared = {*N.rare_runs(x, ranks, least).tolist()} & {*N.rare_runs(y, ranks, least).tolist()}
        assert len(shared) > min(N.spare(len(a), least), N.spare(len(b), least))


@pytest.mark.parametrize("deduplicated", [False, True])
def test_similar_texts_without_a_common_sketch(spark, deduplicated):
    rng, pairs = random.Random(8), []
    while len(pairs) < 6:
        base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        pair = base, edited(rng, base, 0.2)
        a, b = (N.keys(np.array([N._Hashes()[w] for w in words], np.uint64)).tolist() for words in pair)
        if not set(a) & set(b):
            pairs.append(pair)
    docs = spark.createDataFrame([(i, " ".join(words)) for i, words in enumerate(sum(pairs, ()))], "doc_id long, text string")
    if deduplicated:
        assert sorted(r.doc_id for r in N.deduplicate(docs).collect()) == [0, 2, 4, 6, 8, 10]
    else:
        found = N.near_duplicates(docs).collect()
        assert partition((r.doc_id, r.class_id) for r in found) == [[2 * i, 2 * i + 1] for i in range(6)]


def test_pairs_that_no_pivot_meets(spark):
    # a bucket of many classes whose pivots are alike to none: two further nodes are
    rng = random.Random(9)
    passage = [f"p{rng.randrange(10**6)}" for _ in range(60)]
    texts = [passage + [f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(60)]
    texts += [passage + edited(rng, t[60:], 0.3) for t in texts[20:23]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    found = N.near_duplicates(docs, sketches=2).collect()
    assert [g for g in partition((r.doc_id, r.class_id) for r in found) if len(g) > 1] == [[20, 60], [21, 61], [22, 62]]


def meetings(words, ranks, common_runs, least):
    """Pairs of different classes that share enough of the runs both have to show for their lengths, in plain Python."""
    k, out = N.long_run(least), set()
    shows = {i: N.rare_runs(w, ranks, least, common_runs).tolist() for i, (_, w) in words.items()}
    for i, (x, a) in words.items():
        for j, (y, b) in words.items():
            longest = max(len(a), len(b))
            edits = int((1 - least) * longest + 1e-9)
            if i > j and x != y and abs(len(a) - len(b)) <= edits:
                spare = min(N.spare(len(a), least), N.spare(len(b), least))
                first = [s[: max(0, len(w) - k + 1 - (longest - k + 1 - k * edits) + 1 + spare)] for s, w in ((shows[i], a), (shows[j], b))]
                if len(set(first[0]) & set(first[1])) > spare:
                    out.add((i, j, x, y))
    return out


@pytest.mark.parametrize(("block", "bucket"), [(1000, 10**6), (2, 10**6), (1000, 50), (3, 50)])
def test_pairs_missed_in_any_buckets_and_blocks(spark, monkeypatch, block, bucket):
    monkeypatch.setattr(N, "AT_ONCE", 300)
    rng = random.Random(10)
    passage, words = [rng.randrange(2**31) for _ in range(15)], {}
    for group in range(12):
        base = [rng.randrange(2**31) for _ in range(rng.choice((4, 12, 60)))]
        for copy in range(4):
            own = list(base) + passage * (group % 3 == 0)
            for _ in range(len(own) // 6):
                own[rng.randrange(len(own))] = rng.randrange(50)
            i = 100 * group + copy
            words[i] = (i - i % 2 if copy < 2 else i, np.array(own, np.uint32))
    frame = spark.createDataFrame([(i, c, w.view(np.int32).tolist()) for i, (c, w) in words.items()], "node long, class long, words array<int>")
    want = meetings(words, *N.run_ranks(frame, 0.8), 0.8)
    met = spark.createDataFrame([max(want)[:2]], "a long, b long")
    assert {tuple(r) for r in N.pairs_missed(frame, met, 0.8, block, bucket).collect()} == want - {max(want)}
    alike = {(i, j, x, y) for i, (x, a) in words.items() for j, (y, b) in words.items() if i > j and x != y and a.tolist() != b.tolist() and N.similar(a, b)}
    assert alike and alike <= want


def test_runs_of_common_passages_are_shown_last(spark):
    rng = np.random.default_rng(11)
    passage = rng.integers(0, 2**31, 40)
    rows = [(i, i, [*passage.tolist()[: 40 * (i % 2)], *rng.integers(0, 20, 60).tolist()]) for i in range(800)]
    frame = spark.createDataFrame(rows, "node long, class long, words array<int>")
    ranks, common_runs = N.run_ranks(frame, 0.8)
    # the words of the passage are rarer than those beside it, which are common alone but not as pairs
    low = 2**48 - 1
    inside = {x >> 16 for x in N.labelled(N.shingles(passage.astype(np.uint64), 2)).tolist()}
    shown = [N.rare_runs(np.array(w, np.uint32), ranks, 0.8, common_runs).tolist() for _, _, w in rows[1:20:2]]
    assert all(not inside & {x & low for x in runs} for runs in shown)
    assert inside & {x & low for x in N.rare_runs(np.array(rows[1][2], np.uint32), ranks, 0.8).tolist()}


def test_workers_get_few_rows_at_a_time(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    before = spark.conf.get(common.ARROW_ROWS)
    rows = spark.range(0, 25, 1, 1)
    with common.arrow_rows(spark, 10):
        assert [r.n for r in rows.mapInArrow(sizes, "n long").collect()] == [10, 10, 5]
    assert spark.conf.get(common.ARROW_ROWS) == before
    assert [r.n for r in rows.mapInArrow(sizes, "n long").collect()] == [25]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=120), st.sampled_from([0.5, 0.8, 0.9]), st.data())
def test_similar_texts_share_rare_runs_where_an_alignment_can_match_them(a, least, data):
    b = list(a)
    for _ in range(data.draw(st.integers(0, int(len(a) * (1 - least)) + 1))):
        at = data.draw(st.integers(0, len(b) - 1))
        b[at : at + 1] = data.draw(st.sampled_from([[b[at], 77], [88]] + ([[]] if len(b) > 1 else [])))
    x, y = np.array(a, np.uint32), np.array(b, np.uint32)
    if N.similar(x, y, least) and a != b:
        own, other = (dict(zip(*(p.tolist() for p in N.placed_runs(z, COUNTS.astype(np.float32), least, None)), strict=True)) for z in (x, y))
        shared = [v for v in own if v in other and N.place_fits(own[v], other[v], len(a), len(b), least)]
        assert len(shared) > min(N.spare(len(a), least), N.spare(len(b), least))


def test_runs_at_far_places_make_no_pairs():
    # one passage at any place of texts as long: only two of them have it nearly at the same place
    n, word = np.full(6, 100), np.array([0, 30, 60, 90, 5, N.ANYWHERE])
    value, node, at = np.full(6, 9, np.uint32), np.arange(6), np.zeros(6, np.int64)
    found = [f for f in N._bucket_pairs(value, node, node, n, at, word, 0.8, 1000) if "b" in f]
    pairs = {(int(a), int(b)) for f in found for a, b in zip(f["a"], f["b"], strict=True)}
    assert pairs == {(4, 0)} | {(5, i) for i in range(5)}


def test_pairs_of_a_bucket_are_one_row(spark):
    rng = np.random.default_rng(12)
    base = rng.integers(0, 2**31, 60).tolist()
    frame = spark.createDataFrame([(i, i, [*base[:55], *rng.integers(0, 2**31, 5).tolist()]) for i in range(4)], "node long, class long, words array<int>")
    made = N.met_runs(N.shown_runs(frame, 0.8, 1, *N.run_ranks(frame, 0.8)), 0.8).collect()
    assert sorted((r.a, r.b) for r in made) == [(a, b) for a in range(4) for b in range(a)]
    assert all(r.times > 1 for r in made)


def test_rare_runs_in_full_classes_are_not_taken_for_common_ones(spark, monkeypatch):
    # 32 rare runs or so in each class, and one run that all texts hold
    monkeypatch.setattr(N, "RUN_COUNTERS", 2**8)
    rng = np.random.default_rng(13)
    rows = [(i, i, [7, 8, *rng.integers(0, 2**31, 80).tolist()]) for i in range(800)]
    _, common_runs = N.run_ranks(spark.createDataFrame(rows, "node long, class long, words array<int>"), 0.8)
    slot = int(N.shingles(np.array([7, 8], np.uint64), 2)[0] % np.uint64(2**8))
    assert common_runs[slot] > 5 and (common_runs > 0).sum() <= 5


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=60) | st.text("aZ_09 .,\x00\x0b\x1c\n-", max_size=60))
def test_words_and_their_hashes(text):
    words = N.WORD.findall(text.lower())
    lines = N.word_lines(text)
    assert lines == "".join(w + "\n" for w in words).encode()
    assert N.word_hashes(lines).tolist() == [N._Hashes()[w] for w in words]


def test_hashes_of_words_differ():
    words = [f"{a}{b}" for a in "abcdefghij" for b in range(10_000)] + ["a" * n for n in range(2, 5000, 7)] + ["a" * 4096 + "b" * 4096, "b" * 4096 + "a" * 4096]
    found = N.word_hashes("".join(w + "\n" for w in words).encode())
    assert len(set(found.tolist())) == len(words) and len(set((found % np.uint64(2**32)).tolist())) > len(words) - 10
    assert N.word_hashes(f"x\n{words[-1]}\ny\n".encode())[1] == found[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=120), st.sampled_from([0.5, 0.8, 0.9]), st.data())
def test_bags_of_similar_texts_fit(a, least, data):
    b = list(a)
    for _ in range(data.draw(st.integers(0, int(len(a) * (1 - least)) + 1))):
        at = data.draw(st.integers(0, len(b) - 1))
        b[at : at + 1] = data.draw(st.sampled_from([[b[at], 77], [88]] + ([[]] if len(b) > 1 else [])))
    x, y = np.array(a, np.uint32), np.array(b, np.uint32)
    bits = [np.frombuffer(N.bag(z), np.uint64)[None, :] for z in (x, y)]
    if N.similar(x, y, least):
        assert N.bags_fit(*bits, np.array([len(x)]), np.array([len(y)]), least).all()


@pytest.mark.parametrize("bucket", [10**6, 300])
def test_texts_that_share_many_common_runs_make_a_row_for_a_pair(spark, bucket):
    # a pair of words all over texts that are not alike, but for two
    rng = np.random.default_rng(14)
    texts = [[7, 8] * 50 + rng.integers(0, 2**31, 50).tolist() for _ in range(60)]
    texts[1] = [*texts[0][:145], 1, 2, 3, 4, 5]
    frame = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "node long, class long, words array<int>")
    made = N.met_runs(N.shown_runs(frame, 0.8, 3, *N.run_ranks(frame, 0.8)), 0.8, 8)
    large = made.where("b IS NULL").collect()
    runs = np.concatenate([np.frombuffer(r.runs, N.ENTRY) for r in large])
    assert len(large) <= 3 * 8 < len(runs) and {r.cells for r in large} == {8}
    want = set()
    for value in set(runs["value"].tolist()):
        nodes = sorted(set(runs["node"][runs["value"] == value].tolist()))
        want |= {(a, b) for a in nodes for b in nodes if a > b}
    plain = N.met_in_cells(made, frame, 0.8, bucket=bucket).collect()
    assert {(r.a, r.b) for r in plain} <= want and sum(r.times for r in plain) > len(want)
    if bucket == 10**6:
        assert len(plain) == len({(r.a, r.b) for r in plain})
    assert {(r.a, r.b) for r in N.met_in_cells(made, frame, 0.8, True, bucket).collect()} == {(1, 0)}
