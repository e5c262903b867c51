import zlib
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from evenkeel.llm import sharding


def slow_best_fit(sizes, capacity):
    rooms, out = [], [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        fits = [(room, b) for b, room in enumerate(rooms) if room >= sizes[k] and room > 0]
        if fits:
            b = min(fits)[1]
        else:
            b = len(rooms)
            rooms.append(capacity)
        rooms[b] = max(0, rooms[b] - sizes[k])
        out[k] = b
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 120), max_size=80), st.integers(20, 150))
def test_best_fit_as_by_brute_force(sizes, capacity):
    sharding.Rooms.WIDTH = 2
    try:
        assert sharding.best_fit_decreasing(sizes, capacity) == slow_best_fit(sizes, capacity)
    finally:
        sharding.Rooms.WIDTH = 256


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 500), min_size=1, max_size=100), st.integers(1, 9))
def test_into_bins(sizes, bins):
    found = sharding.into_bins(sizes, bins)
    loads = Counter()
    for b, n in zip(found, sizes):
        loads[b] += n
    assert max(found) < bins
    share = max(-(-sum(sizes) // bins), max(sizes))
    assert max(loads.values()) <= share + max(sizes)


def check(rows, texts, shards=8):
    size = {i: len((t or "").encode()) + 1 for i, t in texts}
    crc = {i: zlib.crc32((t or "").encode()) for i, t in texts}
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in texts)
    slots, where, loads = defaultdict(list), {}, Counter()
    text = dict(texts)
    for r in rows:
        assert (r.size, r.text_crc32) == (size[r.doc_id], crc[r.doc_id]) and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
        assert where.setdefault(text[r.doc_id] or "", r.shard) == r.shard
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return loads


def test_levels_give_even_shards(spark):
    texts = [(i, "x" * (i * 7919 % 400) + str(i - i % 3)) for i in range(6000)] + [(None, None), (-1, ""), (-2, "hot")]
    docs = spark.createDataFrame([(i, t, 0, "k") for i, t in texts], "doc_id long, text string, shard int, key string")
    # the fewer boxes are left for the last level, the coarser they are
    for last, uneven in ((50, 1.4), (500, 1.1), (20_000, 1.001)):
        loads = check(sharding.shard(docs, last=last, run=100).collect(), texts)
        assert max(loads.values()) <= uneven * sum(loads.values()) / 8


def test_hot_group_empty_and_repeated_rows(spark):
    texts = [(i, "hot" * 50) for i in range(100)] + [(i, str(i)) for i in range(100, 300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert max(check(sharding.shard(docs).collect(), texts).values()) == 100 * 151
    assert sharding.shard(docs.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.size) for r in sharding.shard(twice).collect()) == [(0, 2), (1, 2), (1, 2)]
