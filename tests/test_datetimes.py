import random
import statistics

import numpy as np
import pytest
from conftest import only, statuses

from evenkeel.operators import datetimes as D


def test_parse_failures(column):
    found = D.check_timezone_consistency(
        column("string", ["not-a-date", "also-bad", "2023-01-01", None]), column("string", ["2023-01-01"]), "c", "t"
    )
    rows = {r["check"]: r for r in found.collect()}
    assert rows["datetime_parse"]["status"] == "FAIL"
    assert rows["datetime_parse"]["metrics"]["src_parse_failures"] == 2
    assert rows["datetime_parse"]["samples"] == ["also-bad", "not-a-date"]
    assert rows["tz_awareness"]["status"] == "PASS"


def test_nothing_parses(column):
    found = statuses(D.check_timezone_consistency(column("string", ["x"]), column("string", ["2023-01-01"]), "c", "t"))
    assert found == {"datetime_parse": "FAIL", "datetime": "WARN"}


def test_missing_column(column):
    assert only(D.check_timezone_consistency(column("date", []), column("date", []), "x", "t"))["status"] == "FAIL"


@pytest.mark.parametrize(
    ("source", "target", "expected_tz", "status", "zones"),
    [
        (["2023-01-01"], ["2023-01-02"], None, "PASS", ("naive", "naive")),
        (["2023-01-01 10:00:00Z"], ["2023-01-01 10:00:00"], None, "FAIL", ("UTC", "naive")),
        (["2023-01-01T10:00:00+05:30"], ["2023-01-01T10:00:00+0530"], None, "PASS", ("UTC+05:30", "UTC+05:30")),
        (["2023-01-01T10:00:00+00:00"], ["2023-01-01T10:00:00Z"], "UTC", "PASS", ("UTC", "UTC")),
        (["2023-01-01"], ["2023-01-01"], "UTC", "WARN", ("naive", "naive")),
        (["2023-01-01T10:00:00Z", "2023-01-01T10:00:00+01:00"], ["2023-01-01T10:00:00Z"], None, "FAIL", ("mixed", "UTC")),
        (["2023-01-01T10:00:00Z", "2023-01-01 10:00:00"], ["2023-01-01T10:00:00Z"], None, "FAIL", ("mixed", "UTC")),
    ],
)
def test_awareness(column, source, target, expected_tz, status, zones):
    row = only(D.check_timezone_consistency(column("string", source), column("string", target), "c", "t", expected_tz))
    assert row["status"] == status and (row["details"]["src_tz"], row["details"]["tgt_tz"]) == zones


def test_systematic_offset(column):
    s = column("string", ["2021-07-04T05:10:00Z", "2022-11-30T21:45:30Z", "2024-02-29T00:00:59Z"], key=True)
    t = column("string", ["2021-07-04T06:10:00Z", "2022-11-30T22:45:30Z", "2024-02-29T01:00:59Z"], key=True)
    rows = {r["check"]: r for r in D.check_timezone_consistency(s, t, "c", "t", pk_column="id").collect()}
    assert rows["tz_offset"]["status"] == "FAIL"
    assert rows["tz_offset"]["metrics"]["median_delta_hours"] == 1.0
    assert statuses(D.check_timezone_consistency(s, s, "c", "t", pk_column="id"))["tz_offset"] == "PASS"


def test_single_pair_is_never_systematic(column):
    s, t = column("string", ["2023-01-01 12:00:00"], key=True), column("string", ["2023-01-01 13:00:00"], key=True)
    assert only(D.check_tz_offset(s, t, ["c"], "id", "t"))["status"] == "WARN"


def test_no_common_key_gives_no_row(frame):
    s, t = frame("id long, c string", [(1, "2023-01-01")]), frame("id long, c string", [(2, "2023-01-01")])
    assert D.check_tz_offset(s, t, ["c"], "id", "t").count() == 0


def test_deltas_round_half_to_even(column):
    s = column("string", ["2023-01-01 00:00:00"] * 2, key=True)
    t = column("string", ["2023-01-01 00:00:30", "2023-01-01 00:01:30"], key=True)
    assert only(D.check_tz_offset(s, t, ["c"], "id", "t"))["metrics"]["median_delta_minutes"] == 1.0  # of 0 and 2


@pytest.mark.parametrize(
    ("rows", "split", "narrow"), [((150, 150), 5, 0), ((40, 300), 5, 8), ((300, 40), 5, 10**6), ((150, 151), 10**6, 10**6)]
)
def test_repeated_keys_equal_all_pairs(frame, monkeypatch, rows, split, narrow):
    """Several timestamps per key on both sides, one hot key: compared with every pair in plain Python.

    ``narrow`` says which keys are joined and which only counted.
    """
    monkeypatch.setattr(D, "ROWS_PER_SPLIT", split)
    monkeypatch.setattr(D, "NARROW", narrow)
    monkeypatch.setattr(D, "PROBES", 5)
    rng = random.Random(1)

    def side(n):
        rows = [(rng.choice([7, 7, rng.randrange(40)]), rng.randrange(5000) * 30) for _ in range(n)]
        return rows + [(None, 5), (3, None)]

    s, t = map(side, rows)
    pairs = [round((b - a) / 60) for k, a in s for j, b in t if k is not None and k == j and a is not None and b is not None]
    schema = "id long, sec long"
    make = lambda rows: frame(schema, rows).selectExpr("id", "timestamp_seconds(sec) AS c")
    m = only(D.check_tz_offset(make(s), make(t), ["c"], "id", "t"))["metrics"]
    assert m["rows_analysed"] == len(pairs)
    assert m["median_delta_minutes"] == statistics.median(pairs)
    assert m["std_delta_minutes"] == pytest.approx(statistics.stdev(pairs))


@pytest.mark.parametrize("weights", [[1], [1, 1], [2, 1, 1], [5, 1], [1, 5], [3, 3], [10**30, 10**30], [1, 10**30, 10**30 + 2]])
def test_median_of_counts(spark, weights):
    """Exact for counts beyond 64 bits, within a day and across days."""
    for step in (1, 700, 5000):
        rows = [("c", (i - 1) * step, w) for i, w in enumerate(weights)]
        df = spark.createDataFrame([(c, d, str(w)) for c, d, w in rows], "column string, delta long, pairs string")
        got = D.medians(df.withColumn("pairs", df.pairs.cast("decimal(38,0)"))).first()["median"]
        total, seen, places = sum(weights), 0, []
        for _, d, w in rows:
            places += [d for place in ((total - 1) // 2, total // 2) if seen <= place < seen + w]
            seen += w
        assert got == sum(places) / 2


def test_equal_rows_of_a_hot_key_need_no_join(spark):
    """A third of a million rows with one key and one timestamp: 1.1e11 pairs from one counted row per side."""
    df = spark.range(900_000).selectExpr("IF(id % 3 = 0, -1L, id) AS id", "IF(id % 3 = 0, timestamp_seconds(0), timestamp_seconds(id)) AS c")
    m = only(D.check_tz_offset(df, df, ["c"], "id", "t"))["metrics"]
    assert m["rows_analysed"] == 600_000 + 300_000**2 and m["std_delta_minutes"] == 0


def _most_rows(plan):
    """The largest number of rows that any operator of an executed plan gave."""
    kind = plan.getClass().getSimpleName()
    inner = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else []
    children = [plan.children().apply(i) for i in range(plan.children().size())]
    found = plan.metrics().get("numOutputRows")
    return max([found.get().value() if found.isDefined() else 0, *map(_most_rows, inner + children)])


def test_one_key_with_many_timestamps_on_both_sides(spark, monkeypatch):
    """10 000 distinct timestamps on each side of a key are 1e8 pairs; no operator gives more than a few rows for each."""
    n = 10_000
    rng = random.Random(3)
    stamps = [[(-1, rng.randrange(10**13), 1 + rng.randrange(3)) for _ in range(n)] for _ in range(2)]
    stamps[1] += [(7, 60_000_000 * i, 1) for i in range(40)]
    stamps[0] += [(7, 30_000_000 * (i - 20), 2) for i in range(40)]  # ties of half a minute, before 1970 too
    frames = [spark.createDataFrame(rows, "k long, ts long, n long").selectExpr("'c' AS column", "*") for rows in stamps]
    staged, largest, whole = [], [], D.stage

    def watched(df, name):
        staged.append(name)
        out = whole(df, name)
        largest.append(out.count())
        return out

    monkeypatch.setattr(D, "stage", watched)
    reduced = D.reduce_keys(*frames)
    deltas = D.key_deltas(reduced, *frames)
    assert deltas.wide.count() <= 2 * n + 80
    facts = D.offset_facts(deltas, ["c"])
    row = facts.first()["d0"]
    assert _most_rows(facts._jdf.queryExecution().executedPlan()) <= 60 * n
    assert "ranges" in staged and max(largest) <= 2 * (D.PROBES + 1) * (n + 40) + n

    # numpy over all pairs; rint also takes halves to the even number
    values, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for key in (-1, 7):
        (s, sn), (t, tn) = (np.array([(x[1], x[2]) for x in rows if x[0] == key]).T for rows in stamps)
        for i in range(0, len(t), 500):
            d = np.rint((t[i : i + 500, None] - s) / 60e6).astype(np.int64).ravel()
            v, at = np.unique(d, return_inverse=True)
            v, c = v, np.bincount(at, (tn[i : i + 500, None] * sn).ravel()).astype(np.int64)
            values, counts = np.append(values, v), np.append(counts, c)
    order = np.argsort(values, kind="stable")
    values, upto = values[order], np.cumsum(counts[order])
    total = int(upto[-1])
    assert row["rows"] == total
    assert row["median"] == sum(int(values[np.searchsorted(upto, rank, "right")]) for rank in ((total - 1) // 2, total // 2)) / 2
    mean = float((values * counts[order]).sum()) / total
    assert row["std"] == pytest.approx((float((counts[order] * (values - mean) ** 2).sum()) / (total - 1)) ** 0.5, rel=1e-9)


def test_the_median_of_many_timestamps_moves_few_rows(spark, monkeypatch):
    """Every round over all timestamps moves each source row once and each target row once for a difference that is tried."""
    n = 10_000
    rng = random.Random(4)
    frames = [
        spark.createDataFrame([(1, rng.randrange(3 * 10**13), 1) for _ in range(n)], "k long, ts long, n long").selectExpr("'c' AS column", "*")
        for _ in range(2)
    ]
    moved, whole = [], D.stage

    def watched(df, name):
        out = whole(df, name)
        if name == "ranges":
            moved.append(out.count())
        return out

    monkeypatch.setattr(D, "stage", watched)
    row = D.offset_facts(D.key_deltas(D.reduce_keys(*frames), *frames), ["c"]).first()["d0"]
    s, t = (np.array([r["ts"] for r in df.collect()]) for df in frames)
    d = np.sort(np.rint((t[:, None] - s).ravel() / 60e6).astype(np.int64))
    assert row["median"] == (int(d[(len(d) - 1) // 2]) + int(d[len(d) // 2])) / 2
    assert sum(x for x in moved if x > 8 * n) == 0 and sum(moved) <= 65 * n


def test_session_must_be_in_utc(spark, column):
    df = column("string", ["2023-01-01"])
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        with pytest.raises(ValueError, match="UTC"):
            D.check_timezone_consistency(df, df, "c", "t")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
