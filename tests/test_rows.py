"""Quarantine, reassembly, lookups under skew, masking, faults."""

import random
from collections import Counter

import pytest
from conftest import order_rows
from pyspark.sql import functions as F

from evenkeel.config import TableConfig
from evenkeel.functions import masking
from evenkeel.sources.read import read_csv
from evenkeel.operators import faults, lookup, mapping, quarantine, samples
from evenkeel.operators.suggest import suggest_config

RULES = TableConfig(
    primary_key="id",
    data_constraints={"name": ["not_null"], "day": ["date"], "absent": ["not_null"]},
    mappings=({"columns": ["status"], "allowed_values": ["a", "b"]},),
)
ROWS = [
    (1, "x", "2024-01-01", "a"), (2, "", "nope", "z"), (2, "y", "", None), (3, None, None, "b"), (None, "n", "2024-02-30", "a"),
    (None, "m", "2024-01-02", "a"),
]
SCHEMA = "id long, name string, day string, status string"


def test_rows_of_the_target(frame):
    valid, bad = quarantine.split(frame(SCHEMA, ROWS).coalesce(1), RULES, is_source=False)
    assert sorted(valid.collect(), key=str) == sorted([(1, "x", "2024-01-01", "a"), (None, "m", "2024-01-02", "a")], key=str)
    reasons = {(r["id"], r["name"]): r["_validation_errors"] for r in bad.collect()}
    assert reasons == {
        (2, ""): "name is null; day is no date: nope; status has a value that is not allowed: z",
        (2, "y"): "duplicate key in id: 2",
        (3, None): "name is null",
        (None, "n"): "day is no date: 2024-02-30",
    }


def test_rows_of_the_source_ignore_target_rules(frame):
    valid, bad = quarantine.split(frame(SCHEMA, ROWS), RULES, is_source=True)
    assert valid.count() == 3 and bad.count() == 3


def test_first_of_a_key_follows_the_declared_order(frame):
    df = frame("id long, v long", [(1, 5), (1, 3), (1, 4), (2, 9)])
    marked = quarantine.mark_duplicates(df, "id", ["v"]).collect()
    assert sorted((r["v"], r["_duplicate"]) for r in marked) == [(3, False), (4, True), (5, True), (9, False)]


def test_equal_rows_keep_exactly_one(spark):
    df = spark.range(3000).selectExpr("id % 10 AS id", "1 AS v").repartition(7)
    counts = quarantine.mark_duplicates(df, "id").groupBy("id").agg({"_duplicate": "count"}).count()
    kept = quarantine.mark_duplicates(df, "id").where("NOT _duplicate").count()
    assert (counts, kept) == (10, 10)


@pytest.mark.parametrize(("share", "key_bytes"), [(1, 4096), (2, 4096), (100_000, 4096), (2_000, 0)])
def test_duplicates_of_a_hot_key(spark, monkeypatch, share, key_bytes):
    """A third of the rows share a key; the same result whichever keys are taken for hot."""
    monkeypatch.setattr(lookup.attach, "__defaults__", (share,))
    monkeypatch.setattr(lookup, "KEY_BYTES", key_bytes)
    rng = random.Random(3)
    rows = [(rng.choice([0, rng.randrange(60), rng.randrange(500)]), i) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, pos long").repartition(5)
    got = sorted(r["pos"] for r in quarantine.mark_duplicates(df, "id", ["pos"]).where("_duplicate").collect())
    seen, want = set(), []
    for key, pos in rows:
        want += [pos] if key in seen else []
        seen.add(key)
    assert got == want


@pytest.mark.parametrize("share", [1, 3, 10**9])
def test_attach_keeps_every_row(spark, share):
    rows = spark.createDataFrame([(k % 7 if k % 7 < 6 else None, k) for k in range(100)], "k long, v long")
    table = spark.createDataFrame([(i, i * 10, f"n{i}") for i in range(5)], "k long, w long, name string")
    got = lookup.attach(rows, table, "k", "w", share)
    assert got.columns == ["k", "v", "w", "name"]
    want = [(k, v, *((k * 10, f"n{k}") if k is not None and k < 5 else (None, None))) for k, v in map(tuple, rows.collect())]
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_rows_of_a_hot_key_are_spread(spark):
    """Of rows with one key, no task of the join may get all."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(9000).selectExpr("IF(id % 3 = 0, -1L, id) AS k", "id AS v")
        table = spark.range(-1, 9000).selectExpr("id AS k", "IF(id = -1, 3000L, 1L) AS w")
        for joined in (lookup.attach(rows, table, "k", "w", 20), lookup.skewed_left_join(rows, table, "k", 20)):
            sizes = [r["n"] for r in joined.groupBy(F.spark_partition_id()).agg(F.count("w").alias("n")).collect()]
            assert sum(sizes) == 9000 and max(sizes) < 3600, sizes
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_summaries(frame):
    _, bad = quarantine.quarantine(frame(SCHEMA, ROWS).coalesce(1), RULES, "t", is_source=False, path="f.csv")
    assert {"_row_index", "table_name", "side", "path"} <= set(bad.columns)
    assert quarantine.quarantine_summary(bad).collect() == [("t", "target", 4)]
    rules = {r["rule"]: r["rows"] for r in quarantine.rule_summary(bad).collect()}
    assert rules == {"name:not_null": 2, "day:date": 2, "status:allowed": 1, "id:duplicate": 1}


@pytest.mark.parametrize("kind", ["parquet", "csv"])
def test_positions_do_not_depend_on_the_split(spark, tmp_path, kind):
    """The file and the place of a row, whether a file is read by one task or by dozens."""
    path = str(tmp_path / f"t.{kind}")
    ids = spark.range(0, 30_000, 1, 1).selectExpr("id", "IF(id % 1000 = 7, NULL, concat('name ', id)) AS name", "id % 7500 AS k")
    if kind == "parquet":
        ids.write.option("parquet.block.size", 64_000).option("parquet.page.size", 8_000).parquet(path)
    else:
        ids.write.option("header", "true").csv(path)
    read = lambda: spark.read.parquet(path) if kind == "parquet" else read_csv(spark, path)
    rules = TableConfig(primary_key="k", data_constraints={"name": ["not_null"]})
    found, tasks = [], []
    for size in ("100m", "16k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        try:
            table = read()
            tasks.append(table.rdd.getNumPartitions())
            valid, bad = quarantine.quarantine(table, rules, "t", is_source=False)
            found.append(sorted((r["_row_index"], r["id"], r["_row_file"].rpartition("/")[2]) for r in bad.collect()))
            assert sorted(valid.columns) == sorted(table.columns) and valid.where("id >= 7500").count() == 0
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
    assert tasks[0] <= 4 and tasks[1] >= 10
    assert found[0] == found[1] and len(found[0]) == 22_500 + 8
    assert all(i == place for place, i, _ in found[0]) and len({f for *_, f in found[0]}) == 1


def test_rows_of_frames_without_files_are_numbered(frame):
    _, bad = quarantine.quarantine(frame(SCHEMA, ROWS).coalesce(1), RULES, "t", is_source=False)
    places = [r["_row_index"] for r in bad.collect()]
    assert len(set(places)) == len(places) and all(r["_row_file"] is None for r in bad.collect())


# --- reassembly --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def parts(frame):
    a = frame("id long, amount double, tag string", [(1, 1.0, "a1"), (2, 2.0, None), (3, None, "a3")])
    b = frame("id long, amount double, tag string, more long", [(2, 20.0, "b2", 1), (3, 30.0, "b3", 1), (4, 40.0, "b4", 1), (None, 9.0, "bn", 1)])
    return [a, b]


def test_merge(parts):
    got = mapping.merge_sources(parts, "N:1", "merge", "id")
    assert got.columns == ["id", "amount", "tag", "more"] and got.count() == 7


def test_merge_of_text_and_number(frame):
    got = mapping.concat([frame("a long", [(1,)]), frame("a string", [("x",)])])
    assert sorted(r["a"] for r in got.collect()) == ["1", "x"]


def test_sum(parts):
    got = {r["id"]: (r["amount"], r["tag"]) for r in mapping.merge_sources(parts, "N:1", "sum", "id").collect()}
    assert got == {1: (1.0, "a1"), 2: (22.0, None), 3: (30.0, "a3"), 4: (40.0, "b4"), None: (9.0, "bn")}


def test_count_first_last(parts):
    assert {r["id"]: r["count"] for r in mapping.merge_sources(parts, "N:1", "count", "id").collect()} == {1: 1, 2: 2, 3: 2, 4: 1}
    first = {r["id"]: r["tag"] for r in mapping.merge_sources(parts, "N:1", "first", "id").collect()}
    last = {r["id"]: r["tag"] for r in mapping.merge_sources(parts, "N:1", "last", "id").collect()}
    assert first == {1: "a1", 2: None, 3: "a3", 4: "b4", None: "bn"}
    assert last == {1: "a1", 2: "b2", 3: "b3", 4: "b4", None: "bn"}
    with pytest.raises(ValueError, match="primary key"):
        mapping.merge_sources(parts, "N:1", "sum", None)


@pytest.mark.parametrize("share", [1, 2, 10**9])
def test_join_parts(frame, monkeypatch, share):
    monkeypatch.setattr(lookup.skewed_left_join, "__defaults__", (share,))
    a = frame("id long, x long", [(1, 10), (2, 20), (2, 21), (None, 0)])
    b = frame("id long, x long, y long", [(2, 0, 200), (2, 0, 201), (3, 0, 300), (None, 0, 1)])
    got = mapping.merge_targets([a, b], "1:N", "join", ["id", "id"])
    want = [(1, 10, None), (2, 20, 200), (2, 20, 201), (2, 21, 200), (2, 21, 201), (3, None, 300), (None, 0, None), (None, None, 1)]
    assert got.columns == ["id", "x", "y"] and Counter(map(tuple, got.collect())) == Counter(want)


# --- masking, faults, samples, suggestion -----------------------------------------------------


def test_join_of_many_parts_moves_rows_once(spark, frame, monkeypatch):
    """Four parts with unique keys: one exchange, which all parts share; a part without further columns tells keys only."""
    parts = [
        frame("id long, a string", [(1, "a1"), (2, "a2"), (None, "an")]), frame("id long, b struct<x:int>", [(2, (5,)), (3, None)]),
        frame("id long, a string, c long", [(3, "lost", 33), (4, "lost", None)]), frame("id long", [(5,), (1,)]),
    ]
    plans, whole = [], mapping.stage
    monkeypatch.setattr(mapping, "stage", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or whole(df, name))
    out = mapping.join_parts(parts, ["id"] * 4)
    assert len(plans) == 1 and plans[0].count("Exchange hashpartitioning") == 1 and "Join" not in plans[0]
    assert out.columns == ["id", "a", "b", "c"]
    rows = {tuple(r) for r in out.collect()}
    assert rows == {(1, "a1", None, None), (2, "a2", (5,), None), (3, None, None, 33), (4, None, None, None), (5, None, None, None), (None, "an", None, None)}


@pytest.mark.parametrize("keys", [["id"] * 3, ["id", "id", "b"]])
def test_join_of_parts_with_repeated_keys_equals_sql(spark, keys):
    import duckdb

    parts = [
        spark.range(60).selectExpr("id % 40 AS id", "id AS a"), spark.range(90).selectExpr("id % 45 AS id", "id % 7 AS b"),
        spark.range(50).selectExpr("id % 25 AS id", "id % 9 AS b", "id AS c"),
    ]
    db = duckdb.connect()
    for name, part in zip("pqr", parts):
        db.register(name, part.toPandas())
    on = "q.id IS NOT DISTINCT FROM r.id" if keys[2] == "id" else None
    got = mapping.join_parts(parts, keys)
    if on:
        want = db.sql("SELECT id, a, q.b, c FROM p FULL JOIN q USING (id) FULL JOIN (SELECT id, c FROM r) r USING (id)").fetchall()
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    else:
        assert got.columns == ["id", "a", "b", "c"] and got.count() > 100


def test_masking(frame):
    df = frame("a string, b long, c string", [("x", 1, "secret"), (None, 2, "s")])
    rows = masking.mask_columns(df, ["a", "b"], ["c"]).collect()
    assert rows[0]["a"] == "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881" and rows[1]["a"] is None
    assert rows[0].asDict().keys() == {"a", "b"} and rows[0]["b"] != rows[1]["b"]


def test_redaction(frame):
    texts = ["password=abc123 rest", "my Token: 'xyz' end", "API_KEY = \"q\"", "nothing here", None]
    got = [r["a"] for r in masking.redact_columns(frame("a string", [(t,) for t in texts]), ["a"]).collect()]
    assert got == ["password: [REDACTED] rest", "my Token: [REDACTED] end", "API_KEY: [REDACTED]", "nothing here", None]


def test_faults_do_not_depend_on_partitioning(spark):
    df = order_rows(spark, 200)
    plan = [{"type": "delete_row", "every": 9}, {"type": "special_chars", "column": "name", "every": 4, "text": "ß,\"☂"}, {"type": "garbage", "column": "amount", "every": 5}]
    a, b = faults.inject(df, "id", plan), faults.inject(df.repartition(6), "id", plan)
    assert Counter(map(tuple, a.collect())) == Counter(map(tuple, b.collect())) and a.count() == 178


def test_samples(spark):
    df = spark.range(1000).selectExpr("id", "id % 3 AS v")
    assert samples.offending_values(df.repartition(4), "v = 2", "v", "id", 3).collect() == [(2, 2), (5, 2), (8, 2)]
    share = samples.sample_rows(df, "id", 0.2)
    assert 140 < share.count() < 260
    assert Counter(share.collect()) == Counter(samples.sample_rows(df.repartition(3), "id", 0.2).collect())


def test_exact_samples_merge(spark):
    df = spark.range(1000).selectExpr("IF(id % 50 = 0, NULL, id % 300) AS id", "id AS v", "CAST(id AS STRING) AS t")
    whole = {tuple(r) for r in samples.smallest_rows(df, "id", 40).collect()}
    assert len(whole) == 40
    for n in (1, 7):
        assert {tuple(r) for r in samples.smallest_rows(df.repartition(n), "id", 40).collect()} == whole
    parts = [samples.smallest_rows(df.where(f"v % 3 = {i}"), "id", 40) for i in range(3)]
    assert {tuple(r) for r in samples.smallest_rows(mapping.concat(parts), "id", 40).collect()} == whole
    assert {tuple(r) for r in samples.smallest_rows(df, "id", 40, seed=1).collect()} != whole
    assert samples.smallest_rows(df, "id", 5000).count() == 1000 and samples.smallest_rows(df.limit(0), "id", 5).count() == 0


def test_suggested_configuration(spark):
    from pyspark.sql import types as T

    schema = T.StructType([
        T.StructField("id", T.LongType(), False), T.StructField("user_id", T.LongType()), T.StructField("total", T.DoubleType()),
        T.StructField("born", T.DateType(), False), T.StructField("name", T.StringType(), False),
    ])
    found = suggest_config(schema, "a", "b")
    assert found["primary_key"] == "id" and found["aggregates"] == ["total"]
    assert found["data_constraints"] == {"id": ["not_null"], "born": ["not_null", "date"], "name": ["not_null"]}
    assert TableConfig(**found).datetime_columns[0].column == "born"
