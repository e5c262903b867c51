import pytest
from conftest import only

from evenkeel.operators import keys, mapping
from evenkeel.operators.volume import check_volume


@pytest.mark.parametrize(
    ("source", "target", "tolerance", "expected"),
    [
        (5, 5, 0.0, "PASS"), (5, 4, 25.0, "PASS"), (5, 4, 0.0, "FAIL"), (4, 5, 0.0, "FAIL"),
        (1_000_000, 990_000, 2.0, "PASS"), (1_000_000, 950_000, 2.0, "FAIL"),
        (0, 3, 0.0, "WARN"), (0, 0, 0.0, "PASS"), (5, 0, 10.0, "FAIL"),
    ],
)
def test_volume(spark, source, target, tolerance, expected):
    row = only(check_volume(spark.range(source), spark.range(target), "t", tolerance))
    assert row["status"] == expected
    assert (row["metrics"]["src_rows"], row["metrics"]["tgt_rows"]) == (source, target)


@pytest.mark.parametrize(
    ("kind", "ratio", "target", "expected"),
    [("1:N", 3.0, 30, "PASS"), ("N:1", 0.5, 5, "PASS"), ("1:N", 2.57, 25, "PASS"), ("1:N", 3.0, 29, "FAIL"), ("N:M", 3.0, 10, "PASS")],
)
def test_volume_with_ratio(spark, kind, ratio, target, expected):
    assert only(check_volume(spark.range(10), spark.range(target), "t", 0.0, kind, ratio))["status"] == expected


@pytest.mark.parametrize(
    ("source", "target", "expected", "overlap"),
    [
        ([1, 2, 3, 4], [1, 2, 3, 4], "PASS", 100), ([1, 2, 3, 4], [1, 2], "WARN", 50), ([1, 2], [3, 4], "FAIL", 0),
        ([], [1], "FAIL", 0), ([1, 1, None], [1, None, None], "PASS", 100),
    ],
)
def test_identity(column, source, target, expected, overlap):
    row = only(keys.check_identity(column("long", source), column("long", target), "c", "t"))
    assert (row["status"], row["metrics"]["overlap_pct"]) == (expected, overlap)
    assert row["metrics"]["src_null_keys"] == source.count(None)


def test_identity_over_types(column):
    same = only(keys.check_identity(column("int", [1, 2]), column("long", [1, 2]), "c", "t"))
    assert same["status"] == "PASS"
    other = only(keys.check_identity(column("int", [1, 2]), column("string", ["1", "2"]), "c", "t"))
    assert other["status"] == "FAIL" and "types" in other["message"]


def test_identity_without_column_gives_no_row(column):
    assert keys.check_identity(column("long", [1]), column("long", [1]), "x", "t").count() == 0


@pytest.mark.parametrize(
    ("source", "target", "expected"),
    [([1, 2, 3], [1, 2, 2, 3, 3], "FAIL"), ([1, 2], [3, 4], "PASS"), ([None], [1], "WARN"), ([1, 2], [], "FAIL"), ([1, 1], [5], "PASS")],
)
def test_uniqueness(column, source, target, expected):
    assert only(keys.check_uniqueness(column("long", source), column("long", target), "c", "t"))["status"] == expected


def test_links(column):
    parent = column("long", [10, 20, 30])
    row = only(keys.check_links(column("long", [10, 20, 99, 99, None]), parent, "c", "c", "t"))
    assert row["status"] == "FAIL"
    assert (row["metrics"]["orphaned_count"], row["metrics"]["orphaned_keys"], row["metrics"]["null_count"]) == (2, 1, 1)
    assert only(keys.check_links(column("long", [10, 20]), parent, "c", "c", "t"))["status"] == "PASS"
    assert only(keys.check_links(column("long", []), parent, "c", "c", "t"))["status"] == "WARN"
    assert only(keys.check_links(parent, parent, "x", "c", "t"))["status"] == "FAIL"
    assert only(keys.check_links(parent, parent, "c", "x", "t"))["status"] == "FAIL"


def test_orphan_rows_and_keys(column):
    child, parent = column("long", [10, 20, 99, 99, None], key=True), column("long", [10, 20, 30])
    assert keys.orphan_keys(child, parent, "c", "c").collect() == [(99, 2)]
    assert sorted(r["id"] for r in mapping.orphan_rows(child, parent, "c", "c").collect()) == [3, 4]


def test_missing_keys(column):
    found = keys.missing_keys(column("long", [1, 2, 2]), column("long", [1, 7, None]), "c").collect()
    assert sorted(map(tuple, found)) == [(2, "source", 2), (7, "target", 1)]
