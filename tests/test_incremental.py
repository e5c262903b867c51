import pytest
from conftest import order_rows
from pyspark.sql import functions as F

from evenkeel.config import TableConfig
from evenkeel.operators import faults, sketch
from evenkeel.plans.pair_audit import audit_pair
from evenkeel.streaming import incremental
from evenkeel.streaming.incremental import Held, IncrementalAudit

TABLE = TableConfig(
    primary_key="id", aggregates=("amount",), enum_columns=({"column": "status", "check_distribution": True},),
    string_columns=({"column": "name", "check_whitespace": True},), datetime_columns=({"column": "created_at"},),
    unique_columns=("name",), data_constraints={"amount": ["positive"]},
    relationships=({"child": {"fk_column": "id"}, "parent": {"pk_column": "id"}},),
)


@pytest.fixture(scope="module")
def pair(spark):
    source = order_rows(spark, 300)
    plan = [
        {"type": "delete_row", "every": 50}, {"type": "negative", "column": "amount", "every": 30},
        {"type": "whitespace", "column": "name", "every": 20}, {"type": "duplicate_ids", "every": 25},
        {"type": "shift_time", "column": "created_at", "every": 1, "minutes": 60},
    ]
    return source, faults.inject(source, "id", plan)


def outcome(results):
    """Everything but floating-point noise of the variance."""
    return [
        (r["check"], r["column"], r["status"], {k: pytest.approx(v, rel=1e-9, nan_ok=True) for k, v in r["metrics"].items()}, r["samples"])
        for r in sorted(results.collect(), key=lambda r: (r["check"], r["column"] or ""))
    ]


def test_batches_equal_one_pass(spark, pair, tmp_path):
    source, target = pair
    audit = IncrementalAudit(spark, "users", TABLE, source.schema, target.schema, str(tmp_path))
    for side, df in (("source", source), ("target", target)):
        for i in range(3):
            audit.add_batch(side, df.where(f"id % 3 = {i}"), i)
    audit.add_batch("source", source.where("id % 3 = 1"), 1)  # a batch that ran twice counts once
    assert outcome(audit.finalize()) == outcome(audit_pair(source, target, TABLE, "users"))


def test_streams(spark, pair, tmp_path):
    source, target = pair
    audit = IncrementalAudit(spark, "users", TABLE, source.schema, target.schema, str(tmp_path / "state"))
    for side, df in (("source", source), ("target", target)):
        df.repartition(2).write.parquet(str(tmp_path / side))
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / side))
        audit.process(side, stream, str(tmp_path / f"checkpoint-{side}")).awaitTermination()
    assert outcome(audit.finalize()) == outcome(audit_pair(source, target, TABLE, "users"))


def test_a_new_checkpoint_takes_nothing_away(spark, pair, tmp_path):
    """Two streams that both number their batches from 0."""
    source, target = pair
    audit = IncrementalAudit(spark, "users", TABLE, source.schema, target.schema, str(tmp_path / "state"))
    audit.add_batch("target", target, 0)
    for name, rows in (("old", "id <= 200"), ("new", "id > 200")):
        source.where(rows).write.parquet(str(tmp_path / name))
        stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / name))
        audit.process("source", stream, str(tmp_path / f"checkpoint-{name}")).awaitTermination()
    assert outcome(audit.finalize()) == outcome(audit_pair(source, target, TABLE, "users"))


def test_many_small_batches_leave_few_files(spark, pair, tmp_path):
    source, target = pair
    audit = IncrementalAudit(spark, "users", TABLE, source.schema, target.schema, str(tmp_path), compact_every=4)
    audit.add_batch("target", target, 0)
    for i in range(11):
        audit.add_batch("source", source.where(f"id % 11 = {i}"), i)
    assert outcome(audit.finalize()) == outcome(audit_pair(source, target, TABLE, "users"))
    folders = list(tmp_path.glob("users/values/side=source/*/batch_id=*"))
    assert len(folders) <= 4
    audit.add_batch("source", source.where("id % 11 = 2"), 2)  # a late second attempt of a batch that is merged already
    assert outcome(audit.finalize()) == outcome(audit_pair(source, target, TABLE, "users"))


def test_the_marker_does_not_grow_with_the_batches():
    held, folders = Held(), [f"stream=a b/batch_id={i}" for i in range(10_000)]
    for at in range(0, 10_000, 50):
        held = Held.of(held.add(folders[at : at + 50]).lines())
    held.add(["stream=late/batch_id=7", "stream=late/batch_id=9", "stream=late/batch_id=0", "stream=late/batch_id=-1"])
    held = Held.of(held.lines())
    assert held.lines() == ["9999  a b", "0 -1,7,9 late"]
    assert folders[0] in held and folders[9_999] in held and "stream=a b/batch_id=10000" not in held
    assert "stream=late/batch_id=9" in held and "stream=late/batch_id=8" not in held and "stream=other/batch_id=0" not in held
    assert Held.of(held.add(f"stream=late/batch_id={i}" for i in range(1, 7)).lines()).lines() == ["9999  a b", "7 -1,9 late"]


def test_a_failure_between_merge_and_delete(spark, pair, tmp_path, monkeypatch):
    source, target = pair
    audit = IncrementalAudit(spark, "users", TABLE, source.schema, target.schema, str(tmp_path), compact_every=3)
    audit.add_batch("target", target, 0)
    monkeypatch.setattr(IncrementalAudit, "_delete", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    for i in range(2):
        audit.add_batch("source", source.where(f"id % 3 = {i}"), i)
    with pytest.raises(OSError):
        audit.add_batch("source", source.where("id % 3 = 2"), 2)
    again = IncrementalAudit(spark, "users", TABLE, source.schema, target.schema, str(tmp_path))
    assert len(list(tmp_path.glob("users/values/side=source/stream=batches/batch_id=*"))) == 3  # left behind
    assert outcome(again.finalize()) == outcome(audit_pair(source, target, TABLE, "users"))


def test_sketched_keys(spark, tmp_path):
    """More distinct keys than a sketch holds: the estimate lies within its stated error; small tables are exact."""
    for n, folder in ((300_000, "large"), (300, "small")):
        source, target = spark.range(n).selectExpr("id"), spark.range(n // 3, n + n // 2).selectExpr("id")
        audit = IncrementalAudit(
            spark, "t", TableConfig(primary_key="id"), source.schema, target.schema, str(tmp_path / folder), sketched=("id",), compact_every=2
        )
        for i in range(3):
            audit.add_batch("source", source.where(f"id % 3 = {i}"), i)
        audit.add_batch("target", target, 0)
        row = {r["check"]: r for r in audit.finalize().collect()}["identity"]
        assert row["status"] == "WARN" and abs(row["metrics"]["overlap_pct"] - 200 / 3) <= row["metrics"]["error_pct"] + 1e-9
        assert (row["metrics"]["error_pct"] == 0) == (n == 300) and row["metrics"]["error_pct"] < 5
        assert not list((tmp_path / folder).glob("t/keys-*"))


def test_a_side_without_batches_is_empty(spark, pair, tmp_path):
    source, target = pair
    audit = IncrementalAudit(spark, "users", TABLE, source.schema, target.schema, str(tmp_path))
    audit.add_batch("source", source, 0)
    found = {r["check"]: r["status"] for r in audit.finalize().collect()}
    assert found["volume"] == "FAIL" and found["identity"] == "FAIL"
    with pytest.raises(ValueError, match="side"):
        audit.add_batch("both", source, 0)


def test_sketches_merge(spark):
    source, target = spark.range(1000).selectExpr("id AS k"), spark.range(500, 1500).selectExpr("id AS k")
    parts = sketch.key_sketch(source.where("k < 400"), "k").unionByName(sketch.key_sketch(source.where("k >= 300"), "k"))
    row = sketch.approximate_overlap(sketch.merge_sketches(parts), sketch.key_sketch(target, "k")).first()
    assert (row["src_keys"], row["tgt_keys"], row["common_keys"], row["overlap_pct"]) == (1000, 1000, 500, 50.0)


def test_a_batch_of_one_large_part_is_dealt_out(spark, pair, tmp_path, monkeypatch):
    source, _ = pair
    whole, seen = IncrementalAudit._parts, []

    def watched(self, side, df):
        seen.append([r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()])
        return whole(self, side, df)

    monkeypatch.setattr(incremental, "ROWS_PER_TASK", 50)
    monkeypatch.setattr(IncrementalAudit, "_parts", watched)
    audit = IncrementalAudit(spark, "users", TABLE, source.schema, source.schema, str(tmp_path), compact_every=1000)
    audit.add_batch("source", source.coalesce(1), 0)
    assert sum(seen[0]) == source.count() and max(seen[0]) <= 100
    assert sorted(map(str, incremental.spread(source.coalesce(1), 50).collect())) == sorted(map(str, source.collect()))
