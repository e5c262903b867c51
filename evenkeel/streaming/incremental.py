"""Audits of growing tables: every micro-batch adds its part to a stored state.

The state holds, per side, one row of metrics per batch, value counts, key counts and timestamp counts.
All of it merges by addition (or minimum, maximum, see :mod:`evenkeel.operators.facts`), so the final
status comes from the very plan the batch audit uses, over the state instead of the tables.

A batch always writes to the folder named after its stream and its id and replaces what is there. A batch that a
failure makes Spark run again therefore counts once, and a stream with a new checkpoint, which numbers its batches
anew, takes nothing away from what another has stored.

Every ``compact_every`` batches the folders of a side are merged into one. A marker that is put in place by a rename
names the merged folder and what it holds, so a reader sees either the folders or their sum: for each stream the id up
to which it holds every batch, and the ids above. Streams number their batches from 0 without a gap, so the marker stays as
small as the number of streams, however many batches there were. A batch that is delivered again after it was merged, or
whose folder a failure left behind, is known by its id and does not count twice.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from evenkeel import results as R
from evenkeel.config import TableConfig
from evenkeel.operators import datetimes, frequency, keys, sketch
from evenkeel.operators import facts as A
from evenkeel.plans.pair_audit import Settings, TableInputs, pair_results, plan_pair

SIDES = ("source", "target")
WRITERS = 4
#: Rows of a batch that one task reads; a larger part is dealt out. A file of one row group cannot be split by its reader.
ROWS_PER_TASK = 250_000
#: Parts that are dealt out without sorting or holding rows (``spark.shuffle.sort.bypassMergeThreshold``).
MOST_PARTS = 200


@dataclass
class Held:
    """The batches that a merged folder holds, by stream: ``upto`` is the highest id of those without a gap from 0."""

    upto: dict[str, int] = field(default_factory=dict)
    above: dict[str, set[int]] = field(default_factory=dict)

    def __contains__(self, folder: str) -> bool:
        stream, batch = self._read(folder)
        return batch is not None and (0 <= batch <= self.upto.get(stream, -1) or batch in self.above.get(stream, ()))

    @staticmethod
    def _read(folder: str) -> tuple[str, int | None]:
        stream, _, batch = folder.partition("/")
        number = batch.removeprefix("batch_id=")
        return stream.removeprefix("stream="), int(number) if number.lstrip("-").isdigit() else None

    def add(self, folders: Iterable[str]) -> Held:
        for folder in folders:
            stream, batch = self._read(folder)
            self.above.setdefault(stream, set()).add(batch)
        for stream, some in self.above.items():
            at = self.upto.get(stream, -1)
            while at + 1 in some:
                at += 1
            if at >= 0:
                self.upto[stream] = at
            self.above[stream] = {b for b in some if b > at or b < 0}
        return self

    def lines(self) -> list[str]:
        """One line per stream: the id up to which all are held, the ids above, the stream."""
        streams = sorted({*self.upto, *(s for s, some in self.above.items() if some)})
        return [f"{self.upto.get(s, -1)} {','.join(map(str, sorted(self.above.get(s, ()))))} {s}" for s in streams]

    @classmethod
    def of(cls, lines: Iterable[str]) -> Held:
        held = cls()
        for line in lines:
            upto, above, stream = line.split(" ", 2)
            held.upto[stream] = int(upto)
            held.above[stream] = {int(b) for b in above.split(",") if b}
        return held


class IncrementalAudit:
    """Add batches or streams of both sides, then :meth:`finalize`."""

    def __init__(
        self,
        spark: SparkSession,
        name: str,
        table: TableConfig,
        source_schema: T.StructType,
        target_schema: T.StructType,
        state_dir: str,
        settings: Settings = Settings(),
        parents: Mapping[str, DataFrame | Exception] | None = None,
        compact_every: int = 50,
        sketched: Sequence[str] = (),
    ):
        """``sketched``: key columns whose state would be too large. Of them a sketch of fixed size is kept per batch instead of the
        counts of all keys; the overlap of keys is then an estimate with a stated error, and uniqueness is not checked."""
        self.compact_every = compact_every
        self.spark, self.name, self.state_dir, self.settings = spark, name, state_dir, settings
        self.schemas = {"source": source_schema, "target": target_schema}
        self.plan = plan_pair(A.Side(source_schema), A.Side(target_schema), table, settings, parents)
        self.sketched = {c: read for c, (read, _) in self.plan.keyed.items() if c in sketched}
        for c in self.sketched:
            del self.plan.keyed[c]
        self.overlap_threshold = table.identity_overlap_threshold
        self._blank: dict[str, dict[str, tuple[DataFrame, T.StructType]]] = {}

    # --- what is stored --------------------------------------------------------------------

    def _parts(self, side: str, df: DataFrame) -> dict[str, DataFrame]:
        """The state a frame of one side contributes, by name of its folder."""
        plan, inputs = self.plan, TableInputs(df, df)
        parts: dict[str, DataFrame] = {}
        for i, batch in enumerate(A.batches(plan.scalar)):
            metrics = _of_side(batch, side)
            if metrics:
                parts[f"metrics-{i}"] = inputs.metrics(side, metrics)
        if plan.values:
            parts["values"] = frequency.compact(inputs.values(side, plan.counted()))
        for i, (column, read) in enumerate(self._key_columns(side)):
            parts[f"keys-{i}"] = keys.compact(keys.key_rows(df, column, read))
        for i, (column, read) in enumerate(self.sketched.items()):
            k = f"CAST({read(A.Side.of(df), column)} AS STRING)"
            parts[f"sketch-{i}"] = sketch.key_text_sketch(df, k)
        if plan.stamps:
            parts["stamps"] = datetimes.compact(inputs.stamps(side, plan.stamp_key, plan.stamps, plan.stamp_read))
        return parts

    def _key_columns(self, side: str) -> list[tuple[str, keys.KeyReader]]:
        columns = [(c, read) for c, (read, _) in self.plan.keyed.items()]
        if side == "target":
            for link in self.plan.links:
                columns.append((link.check.source_column, link.read))
                if link.parent is None:
                    columns.append((link.check.target_column, link.read))
        return columns

    def _path(self, side: str, part: str) -> str:
        return os.path.join(self.state_dir, self.name, part, f"side={side}")

    def add_batch(self, side: str, df: DataFrame, batch_id: int, stream: str = "batches") -> None:
        """Store the contribution of one batch; the same id of the same stream replaces an earlier attempt."""
        if side not in SIDES:
            raise ValueError(f"side must be one of {SIDES}")
        folder = f"stream={stream}/batch_id={batch_id}"

        def write(item: tuple[str, DataFrame]) -> None:
            part, rows = item
            rows.write.mode("overwrite").parquet(os.path.join(self._path(side, part), folder))

        df = spread(df, ROWS_PER_TASK).persist()  # the parts are independent jobs over few columns each; together they fill the cluster
        try:
            with ThreadPoolExecutor(max_workers=WRITERS) as pool:
                list(pool.map(write, self._parts(side, df).items()))
        finally:
            df.unpersist()
        if len(self._folders(side)) >= self.compact_every:
            self.compact(side)

    def process(self, side: str, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Start a query that stores every micro-batch; by default it stops at the end of the input."""

        def store(df: DataFrame, batch_id: int) -> None:
            query = df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
            self.add_batch(side, df, batch_id, query)

        return (
            stream.writeStream.foreachBatch(store)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )

    # --- folders of batches ----------------------------------------------------------------

    def _files(self):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self.state_dir).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        fs, folder = self._files(), self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return sorted(f.getPath().getName() for f in fs.listStatus(folder)) if fs.exists(folder) else []

    def _marker(self, side: str) -> str:
        return os.path.join(self.state_dir, self.name, f"compacted-{side}")

    def _compacted(self, side: str) -> tuple[str | None, Held]:
        """The merged folder, and the batches it holds."""
        found = [n for n in self._names(self._marker(side)) if not n.startswith((".", "_"))]
        if not found:
            return None, Held()
        newest = max(found, key=int)
        lines = self.spark.read.text(os.path.join(self._marker(side), newest)).collect()  # one for each stream
        return f"stream=compacted/batch_id={newest}", Held.of(r["value"] for r in lines)

    def _folders(self, side: str, part: str | None = None) -> list[str]:
        """Folders of batches that no merged folder holds, of one part."""
        part = part or next(iter(self._stored(side)), None)
        if part is None:
            return []
        _, held = self._compacted(side)
        here = self._path(side, part)
        streams = [s for s in self._names(here) if s.startswith("stream=") and s != "stream=compacted"]
        found = [f"{stream}/{batch}" for stream in streams for batch in self._names(f"{here}/{stream}")]
        return [f for f in found if f not in held]

    def compact(self, side: str) -> None:
        """Merge all stored batches of a side into one folder per part."""
        folders = self._folders(side)
        merged, held = self._compacted(side)
        number = int(merged.rpartition("=")[2]) + 1 if merged else 0
        for part in self._stored(side):
            rows = self._merged(side, part)
            rows.write.mode("overwrite").parquet(os.path.join(self._path(side, part), f"stream=compacted/batch_id={number}"))
        path, fs = self.spark._jvm.org.apache.hadoop.fs.Path, self._files()
        draft = path(os.path.join(self._marker(side), f"_{number}"))
        out = fs.create(draft, True)
        out.write(bytearray("\n".join(held.add(folders).lines()).encode()))
        out.close()
        fs.rename(draft, path(os.path.join(self._marker(side), str(number))))
        self._delete(side, [*folders, *([merged] if merged else [])])
        for old in self._names(self._marker(side)):
            if old.isdigit() and int(old) < number:
                fs.delete(path(os.path.join(self._marker(side), old)), True)

    def _delete(self, side: str, folders: Iterable[str]) -> None:
        path, fs = self.spark._jvm.org.apache.hadoop.fs.Path, self._files()
        for part in self._stored(side):
            for folder in folders:
                fs.delete(path(os.path.join(self._path(side, part), folder)), True)

    def _merged(self, side: str, part: str) -> DataFrame:
        """The stored rows of a part as one batch over all data would have left them."""
        rows, columns = self.state(side, part), self._stored(side)[part][0].columns
        if part.startswith("metrics-"):
            batch = A.batches(self.plan.scalar)[int(part.rpartition("-")[2])]
            return A.merge(rows, _of_side(batch, side)).select([f"`{c}`" for c in columns])
        if part.startswith("sketch-"):
            return sketch.merge_sketches(rows).select(columns)
        if part == "values":
            return frequency.compact(rows).select(columns)
        return (datetimes.compact(rows) if part == "stamps" else keys.compact(rows)).select(columns)

    # --- the result ------------------------------------------------------------------------

    def state(self, side: str, part: str) -> DataFrame:
        """Stored rows of a part; a side without batches is an empty table."""
        blank, schema = self._stored(side)[part]
        merged, _ = self._compacted(side)
        folders = [*self._folders(side, part), *([merged] if merged else [])]
        if not folders:
            return blank
        return self.spark.read.schema(schema).parquet(*[os.path.join(self._path(side, part), f) for f in folders])

    def _stored(self, side: str) -> dict[str, tuple[DataFrame, T.StructType]]:
        """The parts of a side, as they are without rows, and their schemas."""
        if side not in self._blank:
            nothing = self.spark.createDataFrame([], self.schemas[side])
            self._blank[side] = {name: (rows, rows.schema) for name, rows in self._parts(side, nothing).items()}
        return self._blank[side]

    def finalize(self) -> DataFrame:
        """Result rows over everything stored so far. The state stays and can grow further."""
        parts = [pair_results(self.spark, StateInputs(self), self.plan, self.name, self.settings.run_id)]
        for i, column in enumerate(self.sketched):
            sides = [sketch.merge_sketches(self.state(side, f"sketch-{i}")) for side in SIDES]
            parts.append(sketch.overlap_rows(*sides, column, self.name, self.overlap_threshold, self.settings.run_id))
        return R.union(self.spark, parts)


def spread(df: DataFrame, rows_per_task: int) -> DataFrame:
    """The same rows in parts of about ``rows_per_task`` rows, if a part is larger. Equal rows stay together; they are counted as one."""
    plain = ["`" + f.name.replace("`", "``") + "`" for f in df.schema if not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType, T.VariantType))]
    sizes = df.groupBy(F.spark_partition_id().alias("part")).count().agg(F.max("count"), F.sum("count")).first()
    if not plain or (sizes[0] or 0) <= rows_per_task:
        return df
    return df.repartition(min(MOST_PARTS, -(-sizes[1] // rows_per_task)), F.xxhash64(*plain))


def _of_side(checks: Sequence[A.ScalarCheck], side: str) -> list[A.Metric]:
    return A.unique([m for c in checks for m in (c.source if side == "source" else c.target)])


class StateInputs:
    """Shape inputs read from the state of an incremental audit."""

    def __init__(self, audit: IncrementalAudit):
        self.audit = audit

    def metrics(self, side: str, metrics: Sequence[A.Metric]) -> DataFrame:
        names = [m.name for m in metrics]
        for i, batch in enumerate(A.batches(self.audit.plan.scalar)):
            if [m.name for m in _of_side(batch, side)] == names:
                return A.merge(self.audit.state(side, f"metrics-{i}"), metrics)
        raise KeyError(f"no stored metrics {names}")

    def values(self, side: str, counted: Sequence[frequency.Counted]) -> DataFrame:
        return self.audit.state(side, "values")

    def keys(self, side: str, column: str, read: keys.KeyReader) -> keys.KeyColumn:
        index = self.audit._key_columns(side).index((column, read))
        return keys.KeyColumn(self.audit.state(side, f"keys-{index}"), "k", "n")

    def stamps(self, side: str, key: str, columns: Sequence[str], read: keys.KeyReader) -> DataFrame:
        return self.audit.state(side, "stamps")
