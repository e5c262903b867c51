import json

import pytest
from conftest import order_rows
from pyspark.sql import functions as F

from evenkeel.config import AuditConfig, ConfigError, TableConfig, load_config
from evenkeel.operators import faults, rollup
from evenkeel.plans.job import run_audit
from evenkeel.results import RESULT_SCHEMA
from evenkeel.sources import read, write


@pytest.fixture
def csv(tmp_path):
    def make(text, name="t.csv", encoding="utf-8"):
        path = tmp_path / name
        path.write_bytes(text.encode(encoding))
        return str(path)

    return make


def test_types_come_from_all_values(spark, csv):
    df = read.read_csv(spark, csv("id,price,flag,day,mixed,nothing\n1,1.5,True,2024-01-01,1,\n2,NA,False,,x,\n3, 2 ,true,2024-01-02,3,\n"))
    assert dict(df.dtypes) == {"id": "bigint", "price": "double", "flag": "boolean", "day": "string", "mixed": "string", "nothing": "double"}
    assert [tuple(r) for r in df.collect()][1] == (2, None, False, None, "x", None)


def test_na_tokens(spark, csv):
    path = csv("a,b\nN/A,null\n-,NO DATA\nx,NaN\n")
    assert [tuple(r) for r in read.read_csv(spark, path).collect()] == [(None, None), ("-", "NO DATA"), ("x", None)]
    raw = read.read_csv(spark, path, na_values=())
    assert [tuple(r) for r in raw.collect()] == [("N/A", "null"), ("-", "NO DATA"), ("x", "NaN")]


def test_header_only_and_empty_file(spark, csv):
    df = read.read_csv(spark, csv("id,name\n"))
    assert dict(df.dtypes) == {"id": "string", "name": "string"} and df.count() == 0
    assert read.read_csv(spark, csv("", "e.csv")).columns == []


def test_delimiter_encoding_and_quotes(spark, csv):
    df = read.read_csv(spark, csv("a;b\n1;café\n2;\"x;y\"\n3;\"say \"\"hi\"\"\"\n", encoding="iso-8859-1"), delimiter=";", encoding="iso-8859-1")
    assert [r["b"] for r in df.collect()] == ["café", "x;y", 'say "hi"']


def test_line_breaks_inside_quotes(spark, csv):
    path = csv('id,name\n1,"two\nlines"\n2,"a,b"\n')
    df = read.read_csv(spark, path, multiline=True)
    assert read.bad_lines(spark, path, multiline=True).first() == (0, 0)
    assert read.bad_lines(spark, path).first() == (0, 2)
    assert [tuple(r) for r in df.collect()] == [(1, "two\nlines"), (2, "a,b")]


def test_long_and_short_lines(spark, csv):
    path = csv("a,b\n1,2\n1,2,3\n4\n")
    assert [tuple(r) for r in read.read_csv(spark, path).collect()] == [(1, 2), (4, None)]
    assert read.bad_lines(spark, path).first() == (1, 0)


def test_a_profile_is_found_in_one_pass(spark, csv):
    path = csv("id,price,flag,mixed,nothing,note\n1,1.5,True,1,,a\n2,NA,False,x,,\"\n3, 2 ,true,true,NULL,c,long\n4,7,,2.5,,d\n")
    found = read.profile_csv(spark, path)
    assert found.names == ("id", "price", "flag", "mixed", "nothing", "note") and found.rows == 3
    assert {n: k.simpleString() for n, k in found.kinds.items()} == {"id": "bigint", "price": "double", "flag": "boolean", "nothing": "double"}
    assert found.missing["price"] == 1 and found.missing["nothing"] == 3 and found.missing["flag"] == 1
    assert (found.long_lines, found.stray_quotes) == (1, 1) == tuple(read.bad_lines(spark, path).first())


@pytest.mark.parametrize("columns", [3, 60])
def test_wide_tables_are_profiled_as_narrow_ones(spark, csv, columns):
    kinds = {0: "bigint", 1: "double", 2: "boolean", 3: "string", 4: "double"}
    values = {0: ("1", "22"), 1: ("1", "2.5"), 2: ("true", "NA"), 3: ("1", "false"), 4: ("", "NA")}
    lines = [",".join(f"c{i}" for i in range(columns))] + [",".join(values[i % 5][r] for i in range(columns)) for r in range(2)]
    path = csv("\n".join([*lines, ",".join("9" * (columns + 1))]) + "\n")
    assert [t for _, t in read.read_csv(spark, path).dtypes] == [kinds[i % 5] for i in range(columns)]
    found = read.profile_csv(spark, path)
    assert found.rows == 2 and found.long_lines == 1 and found.missing["c2"] == 1


def test_text_is_parsed_twice(spark, csv, monkeypatch):
    """Once for types and damaged lines, once for the data; the report of damaged lines parses nothing."""
    path = csv("id,amount\n" + "".join(f"{i},{i}.5\n" for i in range(50)) + "7,8,9\n")
    parsed, whole = [], read._raw_csv
    monkeypatch.setattr(read, "_raw_csv", lambda *a: parsed.append(a[1]) or whole(*a))
    config = AuditConfig.from_dict({"tables": {"t": {"source": path, "target": path, "primary_key": "id"}}})
    found = {r["check"]: r for r in run_audit(spark, config).results.collect()}
    assert found["csv_lines"]["metrics"]["long_lines"] == 1 and found["identity"]["status"] == "PASS"
    assert len(parsed) == 2  # a frame for each side, used for its profile and its data


def test_a_stray_quote_costs_no_other_row(spark, csv):
    path = csv('a,b\n1,"x\n2,y\n3,z\n4,"w"\n')
    assert [r["a"] for r in read.read_csv(spark, path).collect()] == [1, 2, 3, 4]
    assert read.bad_lines(spark, path).first() == (0, 1)


@pytest.mark.parametrize(("status", "verdict"), [("ERROR", "ERROR"), ("WARN", "GO WITH WARNINGS")])
def test_an_audit_of_a_damaged_file_is_not_go(spark, csv, status, verdict):
    good = "id,amount\n" + "".join(f"{i},{i}\n" for i in range(1, 6))
    bad = good + "".join(f"{i},{i},{i}\n" for i in range(6, 106))
    table = {"source": csv(good, "s.csv"), "target": csv(bad, "t.csv"), "primary_key": "id", "aggregates": ["amount"]}
    config = AuditConfig.from_dict({"tables": {"t": table}, "bad_lines": status})
    audit = run_audit(spark, config)
    lines = [r for r in audit.results.collect() if r["check"] == "csv_lines"]
    assert [(r["status"], r["metrics"]["long_lines"]) for r in lines] == [(status, 100)] and audit.verdict() == verdict


def test_reader_options_of_a_table(spark, csv, monkeypatch):
    path = csv("a|b\n1|caf\u00e9\n2|x\n", "l.csv", "iso-8859-1")
    options = {"delimiter": "|", "encoding": "iso-8859-1", "schema": "a double, b string"}
    table = {"source": path, "target": path, "primary_key": "a", "aggregates": ["a"], "source_options": options, "target_options": options}
    assert run_audit(spark, AuditConfig.from_dict({"tables": {"t": table}})).verdict() == "GO"
    with pytest.raises(ConfigError, match="unknown reader options: color"):
        TableConfig(primary_key="a", source_options={"color": 1})
    seen = {}
    monkeypatch.setattr(read, "read_jdbc", lambda spark, uri, **k: seen.update(uri=uri, **k) or spark.range(3))
    ranges = {"column": "id", "lower": 0, "upper": 9, "partitions": 3}
    table = {"source": "mysql://h/db", "target": "jdbc:mysql://h/db", "primary_key": "id", "source_options": {"table": "s", "partitioning": ranges}, "target_options": {"table": "t"}}
    assert run_audit(spark, AuditConfig.from_dict({"tables": {"t": table}})).verdict() == "GO"
    assert seen["table"] in ("s", "t")
    df = read.read_table(spark, "mysql://h/db", table="s", partitioning=ranges)
    assert df.count() == 3 and seen["partitioning"] == read.JdbcPartitioning("id", 0, 9, 3)
    monkeypatch.undo()
    with pytest.raises(read.DataLoadError, match="missing"):
        read.read_table(spark, "jdbc:mysql://h/db")


def test_declared_schema(spark, csv):
    df = read.read_csv(spark, csv("a,b\n1,2024-01-01\nx,bad\n"), schema=spark.range(0).selectExpr("id AS a", "now() AS b", "1 AS c").schema)
    assert df.dtypes == [("a", "bigint"), ("b", "timestamp"), ("c", "int")]
    assert [r["a"] for r in df.collect()] == [1, None]


def test_dispatch(spark, csv, tmp_path):
    with pytest.raises(FileNotFoundError):
        read.read_table(spark, "/nowhere/x.csv")
    with pytest.raises(FileNotFoundError):
        read.read_table(spark, "/nowhere/x.parquet")
    spark.range(3).write.parquet(str(tmp_path / "p.parquet"))
    assert read.read_table(spark, str(tmp_path / "p.parquet"), column_mapping={"id": "k"}).columns == ["k"]
    assert read.schema_of(read.read_table(spark, csv("a\n1\n"))) == {"a": "bigint"}
    assert read.can_read(spark, csv("a\n1\n")) and not read.can_read(spark, "/nowhere.csv")


@pytest.mark.parametrize(
    ("uri", "args", "expected"),
    [
        ("postgresql://u:p%40w@h:5432/db/orders", {}, {"url": "jdbc:postgresql://h:5432/db", "dbtable": "orders", "user": "u", "password": "p@w"}),
        ("postgres://h/db", {"table": "t"}, {"url": "jdbc:postgresql://h/db", "dbtable": "t"}),
        ("mysql+pymysql://h/db/t", {"query": "SELECT 1"}, {"url": "jdbc:mysql://h/db", "query": "SELECT 1"}),
        ("mssql://h:1433/db/t", {}, {"url": "jdbc:sqlserver://h:1433;databaseName=db", "dbtable": "t"}),
        ("oracle://u:p@h:1521/svc/t", {}, {"url": "jdbc:oracle:thin:@//h:1521/svc", "dbtable": "t"}),
        ("sqlite:////data/a.db/users", {}, {"url": "jdbc:sqlite:/data/a.db", "dbtable": "users"}),
        ("sqlite:///rel/a.db", {"table": "users"}, {"url": "jdbc:sqlite:rel/a.db", "dbtable": "users"}),
    ],
)
def test_jdbc_options(uri, args, expected):
    options = read.jdbc_options(uri, **args)
    assert {k: options[k] for k in expected} == expected
    assert ("dbtable" in options) != ("query" in options)


def test_jdbc_ranges_and_errors(spark):
    ranges = read.JdbcPartitioning("id", 0, 1000, 8)
    options = read.jdbc_options("mysql://h/db", query="SELECT * FROM t", partitioning=ranges)
    assert options["dbtable"] == "(SELECT * FROM t) q" and options["numPartitions"] == "8"
    with pytest.raises(ValueError, match="table"):
        read.jdbc_options("mysql://h/db")
    with pytest.raises(ValueError, match="no database"):
        read.jdbc_options("ftp://h/db")
    with pytest.raises(read.DataLoadError) as e:  # no driver jar here
        read.read_table(spark, "mysql://u:topsecret@h/db/t")
    assert "topsecret" not in str(e.value)


# --- configuration ---------------------------------------------------------------------------


def test_configuration_from_yaml_and_json(tmp_path):
    data = {
        "tables": {"t": {
            "source": "a.csv", "target": "b.csv", "primary_key": "id", "unknown": 1,
            "enum_columns": [{"column": "s", "mapping": {"A": "B"}}], "boolean_columns": [{"column": "b", "true_values": [True, 1, "Y"]}],
        }},
        "tolerances": {"volume_loss_pct": 2}, "logging": {"level": "DEBUG"},
    }
    (tmp_path / "c.json").write_text(json.dumps(data))
    (tmp_path / "c.yaml").write_text("tables:\n  t: {source: a.csv, target: b.csv, primary_key: id}\n")
    config = load_config(str(tmp_path / "c.json"))
    table = config.tables["t"]
    assert (config.volume_tolerance(table), config.aggregate_tolerance(table)) == (2, 1.0)
    assert table.boolean_columns[0].true_values == ("True", "1", "Y") and table.enum_columns[0].mapping == {"A": "B"}
    plain = load_config(str(tmp_path / "c.yaml"))
    assert (plain.tolerances.volume_loss_pct, plain.large_file_threshold_mb, plain.chunk_size, plain.strict_schema) == (0.1, 50.0, None, False)


def test_configuration_errors():
    with pytest.raises(ConfigError):
        AuditConfig.from_dict({"tables": {}, "tolerances": {"volume_loss_pct": -1}})
    with pytest.raises(ConfigError):
        AuditConfig.from_dict({"tables": {"t": {"source": "a"}}})
    with pytest.raises(ConfigError):
        TableConfig(primary_key="id", complex_mapping={"sources": [{"path": "a"}], "targets": [{"path": "b"}], "mapping_type": "2:2"})


def test_list_of_sources_is_a_mapping():
    table = TableConfig(primary_key="id", source=[{"path": "a"}, {"path": "b"}], target="c")
    assert table.complex_mapping.mapping_type == "N:1" and table.source_paths() == ["a", "b"] and table.target_paths() == ["c"]


def test_aggregate_mapping_reads_both_ways():
    for mapping in ({"old": "new"}, {"new": "old"}):
        assert TableConfig(primary_key="id", aggregate_column_mapping=mapping).aggregate_pair("new") == ("old", "new")


# --- files to verdict, and reports ---------------------------------------------------------------


@pytest.fixture(scope="module")
def audit(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("audit")
    df = order_rows(spark, 60).withColumn("created_at", F.expr("CAST(created_at AS STRING)"))
    df.write.option("header", "true").csv(str(folder / "src"))
    bad = faults.set_value(faults.duplicate_rows(df, "id", 20), "status", "id", 15, "BANNED")
    bad.write.option("header", "true").csv(str(folder / "tgt"))
    config = AuditConfig.from_dict({"tables": {"users": {
        "source": str(folder / "src"), "target": str(folder / "tgt"), "primary_key": "id", "aggregates": ["amount"],
        "mappings": [{"columns": ["status"], "allowed_values": ["F", "O", "P"]}], "order_by": ["name"],
        "data_constraints": {"created_at": ["not_null", "date"]},
    }}})
    return spark, config, folder


def test_csv_audit_and_reports(audit):
    spark, config, folder = audit
    run = run_audit(spark, config, run_id="r1")
    assert run.results.schema.simpleString() == RESULT_SCHEMA.simpleString()
    document = write.write_ci_report(run.results, str(folder / "ci.json"), "2024-01-01T00:00:00+00:00")
    assert document["verdict"] == "NO-GO" == run.verdict() and document["total_checks"] == len(document["checks"])
    assert sum(document["summary"].values()) == document["total_checks"]
    assert json.loads((folder / "ci.json").read_text(encoding="utf-8")) == document
    summary = write.write_report(run.results, str(folder / "report"), client="me")
    assert summary["verdict"] == "NO-GO" and len(summary["content_hash"]) == 64 and summary["client"] == "me"
    assert spark.read.json(str(folder / "report" / "sections")).count() >= 4
    write.write_results(run.results, str(folder / "results"))
    assert spark.read.parquet(str(folder / "results")).where("run_id = 'r1'").count() == document["total_checks"]


def test_quarantine_in_the_audit(audit):
    spark, config, folder = audit
    path = str(folder / "invalid")
    run = run_audit(spark, config, ignore_invalid_rows=True, quarantine_path=path)
    statuses = {r["check"]: r["status"] for r in run.results.collect()}
    assert statuses["allowed_values"] == "PASS"
    stored = spark.read.parquet(f"{path}/users")
    assert {"_row_index", "_validation_errors", "table_name", "side"} <= set(stored.columns)
    assert stored.where("side = 'target'").count() == stored.count() > 0
    write.write_quarantine(run.quarantined["users"][1], str(folder / "invalid-csv"), "csv")
    assert spark.read.option("header", "true").csv(str(folder / "invalid-csv")).count() == stored.count()


def test_content_hash_ignores_order(audit):
    spark, config, _ = audit
    results = run_audit(spark, config).results
    a = write.content_hash(results).first()
    assert a == write.content_hash(results.orderBy("message").repartition(3)).first()


@pytest.mark.parametrize(
    ("found", "verdict", "allowed"),
    [
        ([], "NO-GO", False), (["PASS"], "GO", True), (["PASS", "WARN"], "GO WITH WARNINGS", True),
        (["WARN", "FAIL"], "NO-GO", False), (["ERROR", "FAIL", "PASS"], "ERROR", False),
    ],
)
def test_verdict(spark, found, verdict, allowed):
    rank = {"PASS": 0, "WARN": 1, "FAIL": 2, "ERROR": 3}
    rows = [("", "t", "volume", "volume", None, s, rank[s], "", {}, {}, []) for s in found]
    results = spark.createDataFrame(rows, RESULT_SCHEMA)
    row = rollup.verdict(results).first()
    assert (row["verdict"], row["allowed"]) == (verdict, allowed) and rollup.is_migration_allowed(verdict) == allowed
    assert write.exit_code(verdict) == int(not allowed)
    if found:
        section = rollup.section_verdicts(results).first()
        assert section["section"] == "Data Volume Checks" and section["section_verdict"] == max(found, key=rank.get)
        assert rollup.table_summary(results).first()["checks"] == len(found)
    assert write.exit_code("GO WITH WARNINGS", fail_on_warnings=True) == 1
