import math

import pytest
from conftest import only, statuses

from evenkeel.operators import aggregates as A


@pytest.mark.parametrize(
    ("kind", "source", "target", "tolerance", "expected"),
    [
        ("sum", [10, 20, 30], [10, 20, 30], 0.1, "PASS"),
        ("sum", [100, 200, 300], [100, 200, 299], 1.0, "WARN"),
        ("sum", [100, 200, 300], [100, 200, 200], 1.0, "FAIL"),
        ("sum", [0, 0, 0], [0, 1, 2], 1.0, "WARN"),
        ("sum", [0, 0], [0, 0], 0.1, "WARN"),
        ("sum", [-100, -200], [-100, -250], 1.0, "FAIL"),  # a negative sum is compared by its size
        ("sum", [100], [], 1.0, "FAIL"),
        ("avg", [100, 200], [100, 201], 1.0, "WARN"),
        ("avg", [10, 20], [10, 50], 1.0, "FAIL"),
        ("max", [10, 100], [10, 100], 1.0, "PASS"),
        ("max", [100.0], [100.5], 1.0, "WARN"),
        ("max", [100], [200], 1.0, "FAIL"),
        ("min", [100, 500], [50, 500], 1.0, "FAIL"),
        ("variance", [10.0, 20.0, 30.0, 40.0, 50.0], [10.0, 20.0, 30.0, 40.0, 50.3], 5.0, "WARN"),
        ("variance", [5, 5, 5], [5, 6, 7], 1.0, "WARN"),
        ("variance", [5], [5], 1.0, "WARN"),  # one row has no variance
    ],
)
def test_drift(column, kind, source, target, tolerance, expected):
    dtype = "double" if any(isinstance(v, float) for v in source + target) else "long"
    found = A.check_aggregate(column(dtype, source), column(dtype, target), "c", "t", tolerance, (kind,))
    assert only(found)["status"] == expected


def test_all_null_and_nan_side_warns(column):
    for values in ([None, None], [math.nan, math.nan]):
        found = A.check_aggregate(column("double", values), column("double", [1.0, 2.0]), "c", "t", 1.0)
        assert set(statuses(found).values()) == {"WARN"}


def test_nan_is_left_out(column):
    row = only(A.check_sum(column("double", [1.0, math.nan, 2.0]), column("double", [3.0]), "c", "t", 1.0))
    assert row["status"] == "PASS" and row["metrics"]["src_value"] == 3.0


def test_text_and_key_columns_give_no_rows(column):
    assert A.check_sum(column("string", ["1"]), column("string", ["1"]), "c", "t", 1).count() == 0
    for name, rows in (("user_id", 0), ("userId", 0), ("id", 0), ("paid", 1), ("bid", 1)):
        df = column("long", [1, 2], name)
        assert A.check_sum(df, df, name, "t", 1).count() == rows, name


def test_result_is_free_of_partitioning(spark):
    """Sums of doubles differ with the order of addition; the status must not."""
    df = spark.range(100_000).selectExpr("id AS k", "CAST(pmod(xxhash64(id), 100000000) AS DOUBLE) / 100 + 0.01 AS c")
    found = A.check_aggregate(df.repartition(13), df.repartition(3), "c", "t", 1.0)
    assert set(statuses(found).values()) == {"PASS"}


def test_small_difference_in_a_large_sum_is_seen(spark):
    df = spark.range(100_000).selectExpr("CAST(id AS DOUBLE) * 1000 + 0.25 AS c", "id")
    other = df.selectExpr("CASE WHEN id = 5 THEN c + 0.01 ELSE c END AS c")
    row = only(A.check_sum(df, other, "c", "t", 1.0))
    assert row["status"] == "WARN" and row["metrics"]["pct_difference"] > 0


def test_renamed_target_column(frame):
    s, t = frame("id long, a double", [(1, 5.0)]), frame("id long, b double", [(1, 6.0)])
    row = only(A.check_aggregate(s, t, "a", "t", 1.0, ("sum",), "b"))
    assert (row["column"], row["status"]) == ("a->b", "FAIL")


def test_junk_values(column):
    row = only(A.check_junk(column("string", ["1", " 2.5 ", "1e5", "12d", "x", None, "0x10", "1_000"]), "c", "t"))
    assert (row["status"], row["metrics"]["junk_rows"]) == ("FAIL", 4)
    assert row["samples"] == ["0x10", "x"]
    assert A.check_junk(column("double", [1.0]), "c", "t").count() == 0


@pytest.mark.parametrize(
    ("source", "target", "precision", "scale", "expected"),
    [
        ([10.505, 20.751], [10.50, 20.75], None, 2, "FAIL"),  # no precision was declared, and it shrank
        ([10.505, 20.751], [10.50, 20.75], 4, 2, "PASS"),
        ([10.505, 20.751], [10.50, 20.75], None, None, "FAIL"),
        ([10.505, 20.751], [10.50, 20.75], 5, 3, "FAIL"),
        ([1.25], [1.25], None, None, "PASS"),
        ([10.0], [1.5], None, None, "PASS"),  # trailing zeros are no digits
        ([None], [1.0], None, None, "WARN"),
        ([12345678.25], [12345678.2], None, None, "FAIL"),
        ([0.00012], [0.0001], None, None, "FAIL"),
    ],
)
def test_precision(column, source, target, precision, scale, expected):
    found = A.check_numeric_precision(column("double", source), column("double", target), "c", "t", precision, scale)
    assert only(found)["status"] == expected


def test_precision_counts_digits(column):
    row = only(A.check_numeric_precision(column("double", [0.1234, -12.5]), column("string", ["0.12", "7"]), "c", "t"))
    assert [row["metrics"][k] for k in ("src_max_scale", "src_max_precision", "tgt_max_scale", "tgt_max_precision")] == [4, 5, 2, 3]


def test_precision_missing_column(column):
    assert only(A.check_numeric_precision(column("double", [1.0]), column("double", [1.0]), "x", "t"))["status"] == "FAIL"
