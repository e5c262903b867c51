"""The fused audit: invariances, extension, evidence, number of jobs, plan shape."""

from dataclasses import replace

import pytest
from conftest import by_check, order_rows
from pyspark.sql import functions as F

from evenkeel import results as R
from evenkeel.config import AuditConfig, TableConfig
from evenkeel.operators import facts as A
from evenkeel.operators import faults, keys, rollup
from evenkeel.plans import pair_audit, registry
from evenkeel.plans.evidence import failing_values
from evenkeel.plans.job import run_audit
from evenkeel.plans.pair_audit import PairPlan, Settings, audit_pair, isolate
from evenkeel.results import FAIL, PASS, Finding, case

TABLE = TableConfig(
    primary_key="id", aggregates=("amount",), enum_columns=({"column": "status", "check_distribution": True}, {"column": "category"}),
    string_columns=({"column": "name", "check_whitespace": True, "check_encoding": True, "max_length": 12},),
    datetime_columns=({"column": "created_at"},), unique_columns=("name", "id"), null_sentinels=({"column": "name", "sentinels": [""]},),
    numeric_precision_columns=({"column": "amount"},),
    mappings=({"columns": ["status"], "allowed_values": ["F", "O", "P"]},),
    data_constraints={"amount": ["positive", "between_0_5000"], "name": ["not_null"]},
)


@pytest.fixture(scope="module")
def base(spark):
    return order_rows(spark, 400)


def test_a_table_against_itself_is_go(base):
    found = audit_pair(base, base.repartition(7), TABLE, "t")
    assert rollup.final_verdict(found) == "GO", [r for r in found.collect() if r["status"] != "PASS"]


def test_partitioning_does_not_change_results(base):
    bad = faults.inject(base, "id", [{"type": "delete_row", "every": 7}, {"type": "negative", "column": "amount", "every": 5}])
    a = by_check(audit_pair(base, bad, TABLE, "t"))
    b = by_check(audit_pair(base.repartition(1), bad.repartition(9), TABLE, "t"))
    assert a.keys() == b.keys()
    for key in a:
        assert a[key]["status"] == b[key]["status"] and a[key]["metrics"] == pytest.approx(b[key]["metrics"], rel=1e-9)
    assert a[("sum", "amount")] == b[("sum", "amount")]  # sums are exactly equal


def test_splitting_the_metrics_changes_nothing(base, monkeypatch):
    whole = audit_pair(base, base, TABLE, "t").collect()
    monkeypatch.setattr(A, "METRICS_PER_SCAN", 4)
    assert sorted(audit_pair(base, base, TABLE, "t").collect()) == sorted(whole)


def test_keys_counted_with_timestamps_equal_keys_counted_alone(frame):
    def rows(*values):
        return frame("id long, a string, b string", list(values)).selectExpr("id", "CAST(a AS TIMESTAMP) AS a", "b")

    day = "2024-01-01"
    s = rows((1, day, "x"), (1, None, day), (2, None, None), (None, day, None), (3, "2024-01-02", None), (5, None, "y"))
    t = rows((1, day, None), (2, day, None), (None, None, None), (None, None, None), (4, None, day))
    alone = TableConfig(primary_key="id", unique_columns=("id",))
    stamped = TableConfig(primary_key="id", unique_columns=("id",), datetime_columns=({"column": "a"}, {"column": "b"}))
    want, got = (by_check(audit_pair(s, t, table, "t")) for table in (alone, stamped))
    for key in (("identity", "id"), ("uniqueness", "id")):
        assert got[key] == want[key]
    assert got[("tz_offset", "a")]["metrics"]["rows_analysed"] == 1


def test_missing_input(base):
    row = audit_pair(base, None, TABLE, "t").collect()[0]
    assert (row["check"], row["status"]) == ("input", "FAIL")


def test_custom_check(base):
    if "longest" not in registry.CHECKS:

        @registry.register("longest")
        def plan_longest(source, target, column, limit):
            longest = target.highest("longest", column, f"length({target.text(column)})")

            def decide(s, t):
                status = case((f"{t(longest)} <= {limit}", PASS), otherwise=FAIL)
                return [Finding("custom", "longest", column, status, "'length'", {"longest": t(longest)})]

            return A.ScalarCheck([], [longest], decide)

    table = TableConfig(primary_key="id", custom_checks=({"check": "longest", "column": "name", "limit": 9}, {"check": "absent"}))
    found = {r["check"]: r for r in audit_pair(base, base, table, "t").collect()}
    assert found["longest"]["status"] == "FAIL" and found["longest"]["metrics"]["longest"] == 10
    assert found["absent"]["status"] == "ERROR"
    with pytest.raises(ValueError, match="exists"):
        registry.register("volume")(lambda source, target: None)


def test_evidence_for_failed_checks(base):
    bad = faults.inject(base, "id", [
        {"type": "whitespace", "column": "name", "every": 50}, {"type": "modify_value", "column": "status", "every": 100, "value": "X"},
        {"type": "negative", "column": "amount", "every": 200},
    ])
    results = audit_pair(base, bad, TABLE, "t")
    rows = [tuple(r) for r in failing_values(base, bad, TABLE, results, 3).collect()]
    assert [r[3] for r in rows if r[0] == "whitespace"] == ["50", "100", "150"]
    assert [r[3:] for r in rows if r[0] == "allowed_values"] == [("100", "X"), ("200", "X"), ("300", "X")]
    assert [r[3] for r in rows if r[0] == "constraint"] == ["200", "400"]
    assert failing_values(base, base, TABLE, audit_pair(base, base, TABLE, "t")) is None


def test_scans_per_audit(spark, base, tmp_path):
    """Each shape reads a side once: metrics, values, and one for the key column that is not the primary
    key; the primary key is counted with the staged timestamps."""
    path = str(tmp_path / "t.parquet")
    base.write.parquet(path)
    results = audit_pair(spark.read.parquet(path), spark.read.parquet(path), TABLE, "t", Settings())
    results.collect()
    plan = results._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    for slow in ("SortMergeJoin", "CartesianProduct", "NestedLoop"):
        assert slow not in plan
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line and "t.parquet" in line]
    assert len(scans) == 2 * 3, plan


def test_six_key_columns_are_read_in_one_scan_per_side(spark, base, tmp_path):
    """Keys of three types and a foreign key: one scan of each side and of the parent, one shuffle of keys."""
    for name, where in (("s", "true"), ("t", "id % 10 <> 0"), ("p", "id % 7 <> 0")):
        base.where(where).write.parquet(str(tmp_path / name))
    s, t, parent = (spark.read.parquet(str(tmp_path / name)) for name in "stp")
    columns = ["id", "name", "amount", "category", "status", "created_at"]
    table = TableConfig(
        primary_key="id", unique_columns=tuple(columns[1:]),
        relationships=({"child": {"fk_column": "id"}, "parent": {"pk_column": "id", "target": "p"}},),
    )
    results = audit_pair(s, t, table, "t", parents={"p": parent}).where("check IN ('identity', 'uniqueness', 'foreign_key')")
    got = by_check(results)
    plan = results._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line and "ReadSchema: struct<>" not in line]
    # the rows of the volume check are counted without reading a column
    assert sorted(line.split("paths)[")[1].split("]")[0][-1] for line in scans) == ["p", "s", "t"], plan
    assert plan.count("Exchange hashpartitioning") == 2, plan  # the keys, and their sums per check
    want = R.union(spark, [
        keys.check_identity(s, t, "id", "t"), *[keys.check_uniqueness(s, t, c, "t") for c in columns[1:]],
        keys.check_links(t, parent, "id", "id", "t"),
    ])
    want = by_check(want)
    assert len(want) == 7 and {k: (r["status"], r["metrics"]) for k, r in got.items()} == {k: (r["status"], r["metrics"]) for k, r in want.items()}


def test_keys_of_empty_tables(base):
    table = TableConfig(primary_key="id", unique_columns=("name",))
    got = by_check(audit_pair(base.limit(0), base.limit(0), table, "t"))
    assert got[("identity", "id")]["status"] == "FAIL" and got[("uniqueness", "name")]["metrics"]["src_unique_count"] == 0


@pytest.mark.parametrize("bad", [{"c7"}, {"c0", "c19"}, set(), {f"c{i}" for i in range(20)}])
def test_failing_checks_are_found_by_halving(bad):
    runs = []

    def run(plan):
        names = [f.check for f in plan.fixed]
        runs.append(names)
        if bad & set(names):
            raise RuntimeError(names)
        return names

    blank = PairPlan([], [], [], {}, [], [])
    checks = [(f, replace(blank, fixed=[f])) for f in (Finding("x", f"c{i}", None, "", "") for i in range(20))]
    rows = isolate(checks, run, lambda finding, e: [f"error {finding.check}"])
    assert sorted(rows) == sorted(f"error c{i}" if f"c{i}" in bad else f"c{i}" for i in range(20))
    if len(bad) == 1:
        assert len(runs) <= 10  # of 20 checks


def test_one_unreadable_column_costs_few_scans(spark, base, monkeypatch):
    """Scans of the tables while one bad check of 20 is looked for."""
    bad = base.withColumn("amount", F.expr("IF(id = 5, raise_error('unreadable'), amount)"))
    rules = {"id": ["not_null", "positive"], "name": ["not_null"], "status": ["not_null"], "category": ["not_null"]}
    table = TableConfig(
        primary_key="id", source="s", target="t", data_constraints={**rules, "amount": ["positive"]},
        mappings=tuple({"columns": [c], "allowed_values": ["x"]} for c in ("status", "name", "category")),
        boolean_columns=tuple({"column": c} for c in ("status", "name", "category")),
        string_columns=tuple({"column": c, "check_whitespace": True, "check_encoding": True} for c in ("name", "status", "category")),
    )
    fused = []
    whole = pair_audit.pair_results
    monkeypatch.setattr(pair_audit, "pair_results", lambda *a: fused.append(a[2]) or whole(*a))
    found = run_audit(spark, AuditConfig({"t": table}), frames={"s": base, "t": bad}).results.collect()
    errors = [r for r in found if r["status"] == "ERROR"]
    assert [(r["check"], r["column"]) for r in errors] == [("constraint", "amount")] and "unreadable" in errors[0]["message"]
    assert len(found) >= 18 and len(fused) <= 1 + 2 * 5


def test_no_column_is_read_in_vain(spark, base, tmp_path):
    path = str(tmp_path / "t.parquet")
    base.write.parquet(path)
    df = spark.read.parquet(path)
    table = TableConfig(primary_key="id", aggregates=("amount",))
    plan = audit_pair(df, df, table, "t")._jdf.queryExecution().executedPlan().toString()
    read = {line.split("ReadSchema: ")[1].split(">")[0] + ">" for line in plan.splitlines() if "ReadSchema: " in line}
    assert read == {"struct<amount:double>", "struct<id:bigint>"}
