import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.llm import topk


def brute(rows, k, every):
    ok = [
        (r, i, [math.floor(64 * float(x)) for x in v])
        for r, (i, v) in enumerate(rows)
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for r, i, v in ok:
        if i % every == 0:
            clamped = lambda n: max(-(2**63), min(2**63 - 1, n))
            scores = [(-clamped(sum(a * b for a, b in zip(v, w))), j) for s, j, w in ok if s != r and len(w) == len(v)]
            out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize("k", [1, 5, 100])
def test_against_brute_force(spark, k):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).round(1).tolist()) for i in range(150)]
    rows += [(i, [0.5] * 6) for i in range(200, 260)] + [(20, [0.5] * 6), (20, [0.5] * 6), (None, [1.0] * 6), (40, None)]
    rows += [(60, [1.0, None]), (80, [1.0, float("nan")]), (100, [float("inf")]), (120, []), (121, []), (140, [-1e-20, 2.0])]
    rows += [(141, [1.0, -1e-20]), (160, [1e12] * 3), (161, [1e12, -1e9, 3.0]), (162, [1e15, 0.5, 0.25])]
    vectors = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, score int")
    for query_rows, shard_rows in ((5, 7), (2048, 4096)):
        found = topk.top_k(vectors, F.col("vec_id") % 20 == 0, k, query_rows=query_rows, shard_rows=shard_rows)
        assert sorted(tuple(r) for r in found.collect()) == brute(rows, k, 20)


def test_empty_and_floats(spark):
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(vectors, F.col("vec_id") % 20 == 0).count() == 0
    vectors = spark.createDataFrame([(0, [0.1]), (1, [0.3])], "vec_id int, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(vectors, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 6 * 19)]
