import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.llm import ann

SCHEMA = "vec_id long, embedding array<double>, score string"


def by_hand(rows, every, k):
    """All lists by brute force: ``{query's place: [(vec_id, distance), ..]}``."""
    out = []
    for i, (query, q) in enumerate(rows):
        if query % every:
            continue
        best = sorted((float(np.sqrt(((np.array(v) - np.array(q)) ** 2).sum())), vec_id) for j, (vec_id, v) in enumerate(rows) if j != i)[:k]
        out.append((query, best))
    return out


def recall(found, rows, every, k=10):
    lists = {}
    for r in found:
        lists.setdefault(r.query_id, []).append(r)
    hits = wanted = 0
    for query, best in by_hand(rows, every, k):
        own = sorted(lists[query], key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, len(best) + 1))
        assert [(r.score, r.vec_id) for r in own] == sorted((r.score, r.vec_id) for r in own)
        hits += len({r.vec_id for r in own} & {vec_id for _, vec_id in best})
        wanted += len(best)
    return hits / wanted


def test_recall_on_the_given_vectors(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in vectors.collect()]
    found = ann.nearest(vectors, F.col("vec_id") % 20 == 0, shard_rows=700).collect()
    assert recall(found, rows, 20) >= 0.95
    by_id = dict(rows)
    for r in found:
        exact = np.sqrt(((np.array(by_id[r.vec_id]) - np.array(by_id[r.query_id])) ** 2).sum())
        assert r.score == pytest.approx(exact, rel=1e-12)


def test_recall_on_tight_clusters_and_copies():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((60, 16)) * 100
    points = np.concatenate([c + rng.standard_normal((60, 16)) * 0.01 for c in centres])[rng.permutation(3600)]
    graph = ann.Graph(points)
    found, _ = graph.search(graph.moved(points[:300]), ann.SEARCH)
    far = ((points[:300, None] - points[None]) ** 2).sum(axis=2)
    true = np.argsort(far, axis=1)[:, :10]
    assert np.mean([len({*a} & {*b[:64]}) / 10 for a, b in zip(true.tolist(), found.tolist(), strict=True)]) >= 0.95


def test_copies_ties_and_small_tables(frame):
    # a third of all rows is one vector, some ids repeat
    rows = [(i, [1.0, 2.0]) for i in range(100)] + [(200 + i, [float(i % 7), 1.0 + i % 5]) for i in range(200)]
    rows += [(200, [1.0, 2.0]), (0, [5.0, 5.0])]
    docs = frame(SCHEMA, [(*r, "other") for r in rows])
    found = ann.nearest(docs, F.col("vec_id") % 100 == 0, k=5, shard_rows=90).collect()
    own = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found)
    wanted = []
    for query, best in by_hand(rows, 100, 5):
        wanted += [(query, rank, vec_id, score) for rank, (score, vec_id) in enumerate(best, 1)]
    assert own == sorted(wanted)


def test_what_takes_no_part(frame):
    bad = [(100, None), (None, [1.0, 0.0]), (200, [None, 1.0]), (300, [float("nan"), 1.0]), (400, [float("inf"), 1.0]), (500, [0.0, -0.0]), (600, [])]
    good = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (700, [3.0, 0.0, 0.0]), (800, [1e300, 0.0]), (3, [-1e300, 0.0])]
    found = ann.nearest(frame(SCHEMA, [(*r, None) for r in bad + good]), F.col("vec_id") % 100 == 0).collect()
    lists = {q: [(r.vec_id, r.score) for r in sorted(found, key=lambda r: r.rank) if r.query_id == q] for q in {r.query_id for r in found}}
    # 700 is alone with its length
    assert lists == {0: [(1, 1.0), (3, 1e300), (800, 1e300)], 800: [(0, 1e300), (1, 1e300), (3, 2e300)]}
    assert ann.nearest(frame(SCHEMA, []), F.col("vec_id") % 100 == 0).collect() == []
    assert ann.nearest(frame(SCHEMA, [(1, [1.0], None)]), F.col("vec_id") % 100 == 0).collect() == []
