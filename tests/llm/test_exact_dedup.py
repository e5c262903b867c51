import hashlib
import re
from collections import defaultdict

import pytest

from evenkeel.llm import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(i)
    out = []
    for text, ids in groups.items():
        first = min(ids, key=lambda i: (i is None, i or 0))
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, first, len(ids), sha) for i in ids]
    return sorted(out, key=repr)


ROWS = [(5, "a  b"), (3, "a b"), (9, "a\t\nb"), (1, None), (2, ""), (4, " "), (None, "a b"), (7, "a b"), (8, "ß" * 50_000), (8, "ß" * 50_000), (None, "x")]


def got(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()), key=repr)


def test_groups_against_brute_force_with_and_without_winners(spark):
    docs = spark.createDataFrame(ROWS * 2, "doc_id long, text string")
    for tracked, most in ((100, 50), (8, 1)):
        found = exact_dedup.exact_groups(docs, tracked=tracked, most=most)
        assert got(found) == brute(ROWS * 2)
        assert found.where("kept").count() == len({r[3] for r in brute(ROWS)})


def test_hot_digest_is_a_winner(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE CAST(id AS string) END AS text")
    rows = exact_dedup.digests(docs).selectExpr("*", "monotonically_increasing_id() AS row")
    top = exact_dedup.winners(rows, tracked=1000, most=10).collect()
    assert [(r.group_size, r.first.doc_id) for r in top] == [(1000, 0)]


@pytest.mark.parametrize(("most", "broadcast_rows"), [(50, 1000), (1, 1000), (1, 0)])
def test_deduplicate_keeps_columns_and_the_first_row(spark, most, broadcast_rows):
    docs = spark.createDataFrame([(i, t, i, "x") for i, t in ROWS * 2], "doc_id long, text string, digest long, known string")
    kept = exact_dedup.deduplicate(docs, tracked=100, most=most, broadcast_rows=broadcast_rows)
    assert kept.columns == docs.columns
    first = {r[3]: r[1] for r in brute(ROWS)}
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(first.values(), key=repr)


def test_texts_stay_where_they_are_read(spark, tmp_path):
    texts = [(i, f"text {i // 3} " * 200) for i in range(300)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    kept = exact_dedup.deduplicate(spark.read.parquet(str(tmp_path / "docs")))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plan and "Exchange hashpartitioning" not in plan
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 300, 3))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_groups(docs).count() == 0
    assert exact_dedup.deduplicate(docs).count() == 0
