"""Constraints, allowed values, sentinels, texts, enums, booleans."""

import pytest
from conftest import only, statuses

from evenkeel.operators import constraints as C
from evenkeel.operators import frequency as Q
from evenkeel.operators import strings as S


@pytest.mark.parametrize(
    ("kind", "values", "rules", "expected"),
    [
        ("string", ["a", None], ["not_null"], "FAIL"),
        ("string", ["a", "b"], ["not_null"], "PASS"),
        ("string", ["2024-01-15", "not-a-date"], ["date"], "FAIL"),
        ("string", ["2024-01-15", "01/15/2023", "2023-01-02 10:00:00", "Jan 5, 2024", "20240131"], ["date"], "PASS"),
        ("string", ["12:00"], ["date"], "FAIL"),
        ("string", ["2024-01-15", None], ["date"], "FAIL"),
        ("long", [20240101], ["date"], "FAIL"),
        ("long", [1, 2, None], ["positive"], "PASS"),
        ("long", [1, 0], ["positive"], "FAIL"),
        ("string", ["1", "x"], "positive", "FAIL"),
        ("double", [0.0, 150.0, None], ["between_0_150"], "PASS"),
        ("double", [-0.1], ["between_0_150"], "FAIL"),
        ("double", [-3.5], ["between_-5_-1"], "PASS"),
        ("long", [], ["not_null"], "WARN"),
        ("long", [1], [], "PASS"),
    ],
)
def test_constraint(column, kind, values, rules, expected):
    assert only(C.check_data_constraints(column(kind, values), {"c": rules}, "t"))["status"] == expected


def test_constraint_on_missing_column_is_an_error(column):
    assert only(C.check_data_constraints(column("long", [1]), {"x": ["not_null"]}, "t"))["status"] == "ERROR"


def test_unknown_constraint(column):
    with pytest.raises(ValueError, match="unknown constraint"):
        C.check_data_constraints(column("long", [1]), {"c": ["odd"]}, "t")


@pytest.mark.parametrize(
    ("kind", "values", "allowed", "expected", "bad"),
    [
        ("string", ["a", "b"], ["a", "b"], "PASS", 0),
        ("string", ["a", "z"], ["a", "b"], "FAIL", 1),
        ("string", ["a", None], ["a"], "FAIL", 1),  # NULL is not in the list
        ("long", [1, 2], ["1", "2"], "PASS", 0),
        ("string", [], ["a"], "WARN", 0),
    ],
)
def test_allowed_values(column, kind, values, allowed, expected, bad):
    row = only(C.check_allowed_values(column(kind, values), ["c"], allowed, "t"))
    assert (row["status"], row["metrics"]["invalid_rows"]) == (expected, bad)


def test_allowed_values_over_columns(frame):
    df = frame("a string, b string", [("x", "y"), ("x", "q")])
    row = only(C.check_allowed_values(df, ["a", "b", "absent"], ["x", "y"], "t"))
    assert row["status"] == "FAIL" and row["details"]["missing_columns"] == "absent"
    assert only(C.check_allowed_values(df, ["a", "absent"], ["x"], "t"))["status"] == "FAIL"
    assert C.invalid_values(df, ["a", "b"], ["x", "y"]).collect() == [("b", "q", 1)]


@pytest.mark.parametrize(
    ("kind", "source", "target", "sentinels", "expected"),
    [
        ("long", [1, 2, None], [1, 2, None], [0], "PASS"),
        ("long", [1, 0, 0], [1, None, None], [0], "WARN"),
        ("string", ["a", "N/A"], ["a", None], ["N/A"], "WARN"),
        ("string", ["a", ""], ["a", None], [""], "WARN"),
        ("long", [1, 2, 3], [1, None, None], [0], "FAIL"),
        ("string", ["a", "b"], ["a", "N/A"], ["N/A"], "WARN"),
        ("string", ["0", "a"], [None, "a"], [0], "FAIL"),  # the number 0 is not the text "0"
        ("boolean", [False, True], [None, True], [0], "FAIL"),
        ("long", [], [1], [0], "WARN"),
    ],
)
def test_null_sentinel(column, kind, source, target, sentinels, expected):
    found = C.check_null_sentinel_equivalence(column(kind, source), column(kind, target), "c", "t", sentinels)
    assert only(found)["status"] == expected


@pytest.mark.parametrize(
    ("source", "target", "limit", "expected", "over"),
    [
        (["x" * 300, "x" * 200, "x" * 5], ["x" * 255, "x" * 200, "x" * 5], 255, "FAIL", 1),
        (["x" * 300, "x" * 200], ["x" * 255, "x" * 200], None, "FAIL", 1),
        (["x" * 200], ["x" * 150], 255, "WARN", 0),
        (["abc"], ["abc"], None, "PASS", 0),
        ([None, None], ["a"], None, "WARN", 0),
        (["abc"], [None], None, "FAIL", 1),
        (["abc"], [], 10, "FAIL", 0),
        ([None, "abcdef", None], ["abc"], None, "FAIL", 1),
    ],
)
def test_truncation(column, source, target, limit, expected, over):
    row = only(Q.check_string_truncation(column("string", source), column("string", target), "c", "t", limit))
    assert (row["status"], row["metrics"]["rows_exceeding_limit"]) == (expected, over)


def test_truncation_of_numbers_and_missing_column(column):
    assert only(Q.check_string_truncation(column("long", [1234567]), column("long", [12345]), "c", "t", 5))["status"] == "FAIL"
    assert only(Q.check_string_truncation(column("string", ["a"]), column("string", ["a"]), "x", "t"))["status"] == "FAIL"


@pytest.mark.parametrize(
    ("source", "target", "expected"),
    [
        ([" a ", "b", " c"], ["a", "b", "c"], "WARN"),
        (["a", "b", "c"], [" a ", "b", " c"], "FAIL"),
        (["a\t"], ["a\n"], "PASS"),
        (["a"], ["a "], "FAIL"),
        (["a b"], ["a b"], "PASS"),
        ([None], ["a"], "WARN"),
    ],
)
def test_whitespace(column, source, target, expected):
    found = S.check_whitespace_corruption(column("string", source), column("string", target), "c", "t")
    assert only(found)["status"] == expected


@pytest.mark.parametrize(
    ("source", "target", "expected"),
    [
        (["café"], ["cafÃ©"], "FAIL"), (["cafÃ©"], ["café"], "WARN"), (["café"], ["café"], "PASS"),
        (["a"], ["a�"], "FAIL"), (["Ãb"], ["Ãb"], "PASS"), ([None], ["a"], "WARN"),
    ],
)
def test_encoding(column, source, target, expected):
    found = S.check_encoding_corruption(column("string", source), column("string", target), "c", "t")
    assert only(found)["status"] == expected


@pytest.mark.parametrize(
    ("source", "target", "mapping", "expected"),
    [
        (["a", "b"], ["b", "a", "a"], None, "PASS"),
        (["a", "b"], ["a"], None, "FAIL"),
        (["a"], ["a", "z"], None, "FAIL"),
        (["a", None], ["a"], None, "PASS"),
        ([], [], None, "PASS"),
        (["active", "idle"], ["A", "I"], {"active": "A", "idle": "I"}, "PASS"),
        (["active", "new"], ["A", "I"], {"active": "A", "idle": "I"}, "FAIL"),  # a source value without mapping
        (["active"], ["A"], {"active": "A", "idle": "I"}, "FAIL"),  # an expected target value never seen
        (["active", "idle"], ["A", "I", "Z"], {"active": "A", "idle": "I"}, "FAIL"),
    ],
)
def test_enum(column, source, target, mapping, expected):
    found = Q.check_enum_equivalence(column("string", source), column("string", target), "c", "t", mapping)
    assert only(found)["status"] == expected


def test_enum_counts_types_and_samples(column):
    row = only(Q.check_enum_equivalence(column("string", ["a", "b", "b"]), column("string", ["a", "q"]), "c", "t"))
    m = row["metrics"]
    assert (m["src_only_values"], m["src_only_rows"], m["tgt_only_values"], m["tgt_only_rows"]) == (1, 2, 1, 1)
    assert row["samples"] == ["source: b", "target: q"]
    assert only(Q.check_enum_equivalence(column("long", [1]), column("string", ["1"]), "c", "t"))["status"] == "FAIL"
    assert only(Q.check_enum_equivalence(column("long", [1]), column("double", [1.0]), "c", "t"))["status"] == "PASS"
    mapped = Q.check_enum_equivalence(column("long", [1, 2]), column("string", ["A", "B"]), "c", "t", {1: "A", 2: "B"})
    assert only(mapped)["status"] == "PASS"
    assert only(Q.check_enum_equivalence(column("long", [1]), column("long", [1]), "x", "t"))["status"] == "FAIL"


def test_enum_samples_are_bounded(spark):
    df = spark.range(1000).selectExpr("CAST(id AS STRING) AS c")
    row = only(Q.check_enum_equivalence(df, df.where("c = '1'"), "c", "t"))
    assert row["metrics"]["src_only_values"] == 999 and len(row["samples"]) == Q.SAMPLE_VALUES
    assert Q.value_differences(df, df.where("c = '1'"), "c").count() == 999


@pytest.mark.parametrize(
    ("source", "target", "tolerance", "expected", "category"),
    [
        (["a"] * 9 + ["b"], ["a"] * 5 + ["b"] * 5, 0.1, "WARN", "a"),
        (["a", "b"], ["a", "a", "b", "b"], 0.05, "PASS", "a"),
        (["a"], ["z"], 0.05, "WARN", "a"),
        ([None], ["a"], 0.05, "WARN", "a"),
    ],
)
def test_distribution(column, source, target, tolerance, expected, category):
    row = only(Q.check_categorical_distribution(column("string", source), column("string", target), "c", "t", tolerance))
    assert (row["status"], row["details"]["max_shift_value"]) == (expected, category)


@pytest.mark.parametrize(
    ("skind", "source", "tkind", "target", "expected"),
    [
        ("string", ["Y", "Y", "N", "N"], "boolean", [True, True, False, False], "PASS"),
        ("string", ["Y", "Y", "Y", "N"], "string", ["Y", "N", "N", "N"], "FAIL"),
        ("double", [1.0, 0.0, None], "string", [" yes ", "no"], "PASS"),
        ("string", ["Y", "maybe"], "string", ["Y"], "WARN"),
        ("string", [None], "string", ["Y"], "WARN"),
    ],
)
def test_boolean(column, skind, source, tkind, target, expected):
    found = S.check_boolean_normalization(column(skind, source), column(tkind, target), "c", "t")
    assert only(found)["status"] == expected


def test_missing_columns_fail(column):
    df = column("string", ["a"])
    for check in (S.check_whitespace_corruption, S.check_encoding_corruption, S.check_boolean_normalization):
        assert statuses(check(df, df, "x", "t")).popitem()[1] == "FAIL"
