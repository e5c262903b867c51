"""End-to-end cases: a table pair (or several files) and the verdict it must get."""

import pytest
from conftest import DATA, order_rows

from evenkeel.config import AuditConfig
from evenkeel.operators import faults, mapping, rollup
from evenkeel.plans.job import run_audit
from evenkeel.sources import write

USERS = {"source": "src", "target": "tgt", "primary_key": "id", "aggregates": ["amount"]}


def run(spark, frames, table=None, **config):
    tables = table if table and "primary_key" not in table else {"users": table or USERS}
    settings = {"tolerances": {"volume_loss_pct": 1.0, "aggregate_pct_diff": 1.0}, **config}
    return run_audit(spark, AuditConfig.from_dict({"tables": tables, **settings}), frames=frames)


def specs(*names):
    return [{"path": n, "primary_key": "id"} for n in names]


@pytest.fixture(scope="module")
def base(spark):
    return order_rows(spark, 100)


# What the operators can get wrong: order, types, sums that hide a change, keys that only look alike.
CASES = {
    "other order and partitions": ("SELECT * FROM t ORDER BY id DESC", "GO"),
    "ids as double": ("SELECT CAST(id AS DOUBLE) AS id, * EXCEPT (id) FROM t", "GO"),
    "ids as text": ("SELECT CAST(id AS STRING) AS id, * EXCEPT (id) FROM t", "NO-GO"),
    "amounts as text": ("SELECT * EXCEPT (amount), CAST(amount AS STRING) AS amount FROM t", "GO"),
    "amounts as text with a unit": ("SELECT * EXCEPT (amount), concat(amount, ' EUR') AS amount FROM t", "NO-GO"),
    "one cent more in one row": ("SELECT * EXCEPT (amount), amount + IF(id = 3, 0.01D, 0D) AS amount FROM t", "GO WITH WARNINGS"),
    "every tenth row is gone": ("SELECT * FROM t WHERE id % 10 <> 0", "NO-GO"),
    "half of the rows twice, the others gone": ("SELECT * FROM t WHERE id % 2 = 0 UNION ALL SELECT * FROM t WHERE id % 2 = 0", "NO-GO"),
    "other ids, equal sums": ("SELECT id + 100000 AS id, * EXCEPT (id) FROM t", "NO-GO"),
    "signs turned": ("SELECT * EXCEPT (amount), -amount AS amount FROM t", "NO-GO"),
    "amounts without value": ("SELECT * EXCEPT (amount), IF(id % 9 = 0, NULL, amount) AS amount FROM t", "NO-GO"),
    "no amounts": ("SELECT * EXCEPT (amount) FROM t", "NO-GO"),
    "no rows": ("SELECT * FROM t WHERE false", "NO-GO"),
}


@pytest.mark.parametrize("name", CASES)
def test_verdict(spark, base, name):
    sql, expected = CASES[name]
    assert run(spark, {"src": base, "tgt": spark.sql(sql.replace("FROM t", "FROM {t}"), t=base).repartition(3)}).verdict() == expected


def test_empty_source(spark, base, frame):
    audit = run(spark, {"src": frame("id string, name string, amount string", []), "tgt": base})
    found = {r["check"]: r["status"] for r in audit.results.collect()}
    assert found["volume"] == "WARN" and found["identity"] == "FAIL" and "sum" not in found
    assert audit.verdict() == "NO-GO"


def test_missing_target_is_an_error_and_does_not_stop_the_run(spark, base):
    tables = {"users": {**USERS, "target": "/nowhere/users.csv"}, "again": USERS}
    audit = run(spark, {"src": base, "tgt": base}, tables)
    by_table = {r["table_name"]: r["n_error"] for r in rollup.table_summary(audit.results).collect()}
    assert by_table == {"users": 1, "again": 0} and audit.verdict() == "ERROR"


def test_a_failing_job_is_an_error_row(spark, base):
    broken = base.selectExpr("id", "IF(id = 7, raise_error('boom'), amount) AS amount")
    tables = {"users": {**USERS, "source": "bad"}, "again": USERS}
    audit = run(spark, {"bad": broken, "src": base, "tgt": base}, tables)
    found = audit.materialize()
    errors = [r for r in found.collect() if r["status"] == "ERROR"]
    assert {(r["table_name"], r["column"]) for r in errors} == {("users", "amount")} and "boom" in errors[0]["message"]
    fine = {(r["check"], r["status"]) for r in found.collect() if r["table_name"] == "users"}
    assert fine >= {("volume", "PASS"), ("identity", "PASS")}
    assert {r["table_name"] for r in found.collect()} == {"users", "again"}
    assert rollup.final_verdict(found) == "ERROR"


def test_results_are_computed_once(spark, base, tmp_path):
    """Verdict, document and report read the kept rows: no table is scanned again."""
    seen = spark.sparkContext.accumulator(0)

    def count(rows):
        for row in rows:
            seen.add(1)
            yield row

    counted = base.mapInPandas(count, base.schema)
    audit = run(spark, {"src": counted, "tgt": counted})
    audit.results.collect()
    before = seen.value
    assert before > 0
    assert audit.verdict() == "GO" == write.ci_document(audit.results)["verdict"]
    write.write_report(audit.results, str(tmp_path / "report"))
    assert seen.value == before


def test_unusual_column_names(spark, base):
    df = base.withColumnsRenamed({"amount": "the amount", "status": "a.b", "name": "x%`y", "created_at": "größe'"})
    table = {
        "source": "src", "target": "tgt", "primary_key": "id", "aggregates": ["the amount"], "unique_columns": ["x%`y"],
        "enum_columns": [{"column": "a.b", "check_distribution": True}], "datetime_columns": [{"column": "größe'"}],
        "string_columns": [{"column": "x%`y", "check_whitespace": True, "check_encoding": True}],
        "mappings": [{"columns": ["a.b", "x%`y"], "allowed_values": ["it's", "F"]}],
        "data_constraints": {"the amount": ["positive"], "x%`y": ["not_null"]},
    }
    found = run(spark, {"src": df, "tgt": df}, table, ignore=1)
    bad = {(r["check"], r["status"]) for r in found.results.collect() if r["status"] != "PASS"}
    assert bad == {("allowed_values", "FAIL")}
    valid = run_audit(spark, AuditConfig.from_dict({"tables": {"t": table}}), frames={"src": df, "tgt": df}, ignore_invalid_rows=True)
    assert valid.results.count() > 0


def test_larger_pair(spark):
    df = order_rows(spark, 15_000, "sf0.01")
    assert run(spark, {"src": df, "tgt": df.repartition(5)}).verdict() == "GO"


@pytest.mark.parametrize(
    ("kind", "sources", "targets"),
    [("N:1", 3, 1), ("1:N", 1, 2), ("N:M", 2, 3)],
)
def test_horizontal_shards(spark, base, kind, sources, targets):
    frames = {f"s{i}": df for i, df in enumerate(mapping.split_horizontally(base, "id", sources))}
    frames |= {f"t{i}": df for i, df in enumerate(mapping.split_horizontally(base, "id", targets))}
    table = {
        "primary_key": "id", "aggregates": ["amount"],
        "complex_mapping": {
            "mapping_type": kind, "sources": specs(*[f"s{i}" for i in range(sources)]),
            "targets": specs(*[f"t{i}" for i in range(targets)]),
        },
    }
    assert run(spark, frames, table).verdict() == "GO"


def test_vertical_split(spark, base):
    flat = base.drop("created_at")
    table = {
        "primary_key": "id", "aggregates": ["amount"],
        "complex_mapping": {
            "mapping_type": "1:N", "split_strategy": "join", "sources": specs("flat"), "targets": specs("a", "b"),
        },
    }
    frames = {"flat": flat, "a": flat.select("id", "name", "amount"), "b": flat.select("id", "category", "status")}
    assert run(spark, frames, table).verdict() == "GO"


def test_copies_are_compared_one_by_one(spark, base):
    table = {
        "primary_key": "id", "aggregates": ["amount"],
        "complex_mapping": {
            "mapping_type": "1:N", "split_strategy": "copy", "sources": specs("s"), "targets": specs("a", "b"),
        },
    }
    audit = run(spark, {"s": base, "a": base, "b": faults.lose_rows(base, "id", 4)}, table)
    worst = {r["table_name"]: r["n_fail"] for r in rollup.table_summary(audit.results).collect()}
    assert worst["users[1]"] == 0 and worst["users[2]"] > 0


def test_mapping_violation(spark, base):
    table = {**USERS, "mappings": [{"columns": ["status"], "allowed_values": ["F", "O", "P"]}]}
    assert run(spark, {"src": base, "tgt": base}, table).verdict() == "GO"
    bad = faults.set_value(base, "status", "id", 100, "BANNED")
    assert run(spark, {"src": base, "tgt": bad}, table).verdict() == "NO-GO"


def test_relationship_violation(spark):
    users = spark.read.parquet(f"{DATA}/sf0.001/customer.parquet").selectExpr("c_custkey AS id", "c_name AS name")
    orders = spark.read.parquet(f"{DATA}/sf0.001/orders.parquet").selectExpr("o_orderkey AS id", "o_custkey AS user_id")
    table = {
        "source": "orders_src", "target": "orders_tgt", "primary_key": "id",
        "relationships": [{"child": {"fk_column": "user_id"}, "parent": {"target": "users", "pk_column": "id"}}],
    }
    frames = {"users": users, "orders_src": orders, "orders_tgt": orders}
    assert run(spark, frames, table).verdict() == "GO"
    assert run(spark, {**frames, "orders_tgt": faults.add_to(orders, "user_id", "id", 100, 9999)}, table).verdict() == "NO-GO"
    lost = run(spark, {k: v for k, v in frames.items() if k != "users"}, {**table, "relationships": [
        {"child": {"fk_column": "user_id"}, "parent": {"target": "/nowhere.csv", "pk_column": "id"}}]})
    assert lost.verdict() == "ERROR"


def test_strict_schema(spark, base):
    wider = base.selectExpr("*", "1 AS extra")
    assert run(spark, {"src": base, "tgt": wider}).verdict() == "GO"
    assert run(spark, {"src": base, "tgt": wider}, strict_schema=True).verdict() == "NO-GO"


def test_column_mapping_and_table_tolerances(spark, base):
    source = base.withColumnRenamed("amount", "old_amount")
    table = {**USERS, "column_mapping": {"old_amount": "amount"}, "volume_tolerance": 20, "aggregate_tolerance": 50, "identity_overlap_threshold": 80}
    assert run(spark, {"src": source, "tgt": faults.lose_rows(base, "id", 10)}, table).verdict() == "GO WITH WARNINGS"


def test_table_choice_dry_run_and_unknown_table(spark, base):
    config = AuditConfig.from_dict({"tables": {"a": USERS, "b": USERS}})
    frames = {"src": base, "tgt": base}
    only_b = run_audit(spark, config, tables=["b", "nothing"], frames=frames).results
    assert {r["table_name"] for r in only_b.select("table_name").collect()} == {"b"}
    assert run_audit(spark, config, dry_run=True, frames=frames).results.count() == 0


LINES = {
    "source": "s", "target": "t", "primary_key": "line", "aggregates": ["l_extendedprice", "l_quantity"],
    "enum_columns": [{"column": "l_returnflag", "check_distribution": True}, {"column": "l_linestatus", "mapping": {"O": "O", "F": "F"}}],
    "string_columns": [{"column": "note", "check_whitespace": True, "check_encoding": True, "max_length": 30}],
    "boolean_columns": [{"column": "cheap"}], "datetime_columns": [{"column": "l_shipdate"}],
    "null_sentinels": [{"column": "note", "sentinels": ["none"]}], "numeric_precision_columns": [{"column": "l_tax"}],
    "unique_columns": ["line"], "mappings": [{"columns": ["l_linestatus"], "allowed_values": ["O", "F"]}],
    "data_constraints": {"l_quantity": ["positive"], "l_tax": ["between_0_1"], "l_partkey": ["not_null"]},
    "relationships": [{"child": {"fk_column": "l_partkey"}, "parent": {"target": "part", "pk_column": "p_partkey"}}],
}

# One change to the target at a time: the changed columns, and the only checks that may fail or warn.
CHANGES = {
    "nothing": ({}, set()),
    "padded": ({"note": "concat(note, ' ')"}, {("whitespace", "note")}),
    "mojibake": ({"note": "IF(line % 7 = 0, concat(note, 'Ã©'), note)"}, {("encoding", "note")}),
    "cut": ({"note": "left(note, 4)"}, {("truncation", "note")}),
    "sentinel": ({"note": "IF(line % 2 = 0, 'none', note)"}, {("null_sentinel", "note"), ("truncation", "note")}),
    "one flag for all": ({"cheap": "'N'"}, {("boolean", "cheap")}),
    "an hour late": ({"l_shipdate": "l_shipdate + INTERVAL '60' MINUTE"}, {("tz_offset", "l_shipdate")}),
    "rounded": ({"l_tax": "round(l_tax, 1)"}, {("numeric_precision", "l_tax")}),
    "foreign status": ({"l_linestatus": "IF(line % 50 = 0, 'X', l_linestatus)"}, {("allowed_values", "l_linestatus"), ("enum_mapped", "l_linestatus")}),
    "unknown part": ({"l_partkey": "IF(line % 90 = 0, 10000000, l_partkey)"}, {("foreign_key", "l_partkey")}),
    "no part": ({"l_partkey": "IF(line % 90 = 0, NULL, l_partkey)"}, {("constraint", "l_partkey"), ("foreign_key", "l_partkey")}),
    "negative": ({"l_quantity": "IF(line % 500 = 0, -l_quantity, l_quantity)"}, {("constraint", "l_quantity"), *((k, "l_quantity") for k in ("sum", "avg", "min", "variance"))}),
}


@pytest.fixture(scope="module")
def lines(spark):
    part = spark.read.parquet(f"{DATA}/sf0.001/part.parquet")
    df = spark.read.parquet(f"{DATA}/sf0.001/lineitem.parquet").where("l_orderkey < 400")
    df = df.selectExpr(
        "row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS line", "*",
        "concat('order ', l_orderkey, ' of ', l_partkey) AS note", "IF(l_extendedprice < 50000, 'Y', 'N') AS cheap",
    ).drop("l_orderkey", "l_linenumber")
    return df, part


@pytest.mark.parametrize("name", CHANGES)
def test_a_change_shows_in_its_checks_alone(spark, lines, name):
    df, part = lines
    changed, expected = CHANGES[name]
    target = df.selectExpr(*[f"{changed[c]} AS {c}" if c in changed else c for c in df.columns])
    found = run(spark, {"s": df, "t": target, "part": part}, LINES).results.collect()
    bad = {(r["check"], r["column"]) for r in found if r["status"] != "PASS"}
    assert bad <= expected and (not expected or bad), (bad, expected)
