import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<double>, code string"


def by_hand(rows, every, positives=5, most=3, low=50, high=95):
    """All rows of the result, from sorted lists of Python numbers."""
    clip = lambda x: max(-(2**63), min(2**63 - 1, x))
    good = [(i, n, [math.floor(256 * x) for x in v]) for i, n, v in rows]
    out = []
    for a, (anchor, label, q) in enumerate(good):
        if anchor % every:
            continue
        others = [(clip(sum(x * y for x, y in zip(q, v, strict=True))), i, b, n) for b, (i, n, v) in enumerate(good) if b != a and len(v) == len(q)]
        others.sort(key=lambda x: (-x[0], x[1], x[2]))
        for score, positive, *_ in [x for x in others if x[3] == label][:positives]:
            fits = [x for x in others if x[3] != label and low * score <= 100 * x[0] <= high * score][:most]
            out += [(anchor, positive, rank, x[1], score, x[0]) for rank, x in enumerate(fits, 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def random_rows(seed, count, size, labels=4, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((labels, size))
    return [(i, int(n), (centres[n] * spread + rng.standard_normal(size)).tolist()) for i, n in enumerate(rng.integers(0, labels, count))]


@pytest.mark.parametrize(("size", "spread"), [(3, 0.0), (64, 3.0), (70, 0.5), (130, 8.0)])
def test_equals_brute_force(frame, size, spread):
    rows = random_rows(size, 400, size, spread=spread)
    rows += [(1000 + i, 0, rows[0][2]) for i in range(150)] + [(0, 1, rows[0][2]), (50, 3, rows[1][2])]
    docs = frame(SCHEMA, [(*r, "other") for r in rows])
    found = negatives.hard_negatives(docs, F.col("vec_id") % 10 == 0, anchor_rows=30, shard_rows=120)
    assert rows_of(found) == by_hand(rows, 10)


def test_labels_that_change_and_other_bounds(frame):
    rows = random_rows(5, 200, 8, labels=10)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    docs = frame(SCHEMA, [(*r, None) for r in rows])
    found = negatives.hard_negatives(docs, F.col("vec_id") % 10 == 0, 2, 4, 20, 80, label)
    changed = [(i, (n + 1) % 10 if i % 7 == 0 else n, v) for i, n, v in rows]
    assert rows_of(found) == by_hand(changed, 10, 2, 4, 20, 80)


def test_intervals_hold():
    rng = np.random.default_rng(8)
    for size in (1, 5, 64, 100):
        rows = negatives.whole(rng.standard_normal((300, size)) * np.exp(rng.uniform(-3, 3, (300, 1))))
        rows[:5] = 0
        anchors = np.concatenate([rows[:20], -rows[20:30], negatives.whole(rng.standard_normal((30, size)))])
        estimate, below, above = negatives.intervals(anchors, *negatives.coded(rows))
        scores = anchors @ rows.T
        assert (below <= scores).all() and (scores <= above).all() and (below <= estimate).all() and (estimate <= above).all()
    # the score of a near copy is a bar that leaves out nearly all other rows
    rows = negatives.whole(rng.standard_normal((1000, 64)))
    _, _, above = negatives.intervals(rows[:1], *negatives.coded(rows))
    assert (above[0] < 0.9 * (rows[0] @ rows[0])).mean() >= 0.9


def test_large_numbers(frame):
    rows = [(i, i % 2, [1e15 * (i + 1), 3e14 * i, 1.0 * i]) for i in range(30)] + [(40, 0, [1e300, 1.0, 1.0]), (41, 1, [-1e300, 2.0, 0.0])]
    found = negatives.hard_negatives(frame(SCHEMA, [(*r, None) for r in rows]), F.col("vec_id") % 10 == 0)
    assert rows_of(found) == by_hand(rows, 10)
    exact = np.array([2**63 - 1, -(2**63), 101, -101, 0, 99])
    assert negatives.hundredths(exact, 95, False).tolist() == [x * 95 // 100 for x in exact.tolist()]
    assert negatives.hundredths(exact, 50, True).tolist() == [-(-x * 50 // 100) for x in exact.tolist()]


def test_what_takes_no_part(frame):
    bad = [(0, None, [1.0, 1.0]), (None, 1, [1.0, 1.0]), (10, 1, None), (20, 1, [None, 1.0]), (30, 1, [float("nan"), 1.0]), (40, 1, [1e308, 1.0])]
    good = [(50, 1, [1.0, 1.0]), (51, 1, [2.0, 2.0]), (52, 2, [1.5, 1.0]), (53, 2, [-1.0, 0.0]), (60, 2, [1.0, 1.0, 1.0]), (70, 5, []), (71, 5, []), (72, 6, [])]
    docs = frame(SCHEMA, [(*r, None) for r in bad + good])
    assert rows_of(negatives.hard_negatives(docs, F.col("vec_id") % 10 == 0)) == by_hand(good, 10)
    assert rows_of(negatives.hard_negatives(frame(SCHEMA, []), F.col("vec_id") % 10 == 0)) == []
