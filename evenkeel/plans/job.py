"""The audit of a whole configuration: load, reassemble, quarantine, check, roll up."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import cached_property, partial

from pyspark.sql import DataFrame, SparkSession

from evenkeel import results as R
from evenkeel.config import AuditConfig, TableConfig, TableSpec
from evenkeel.functions.values import quote
from evenkeel.operators import mapping as M
from evenkeel.operators import quarantine as Q
from evenkeel.operators import rollup
from evenkeel.plans.pair_audit import PairAudit, Settings, audit_pair
from evenkeel.results import ERROR, fixed_finding
from evenkeel.sources.read import CsvProfile, DataLoadError, bad_lines, hide_password, is_database, is_parquet, read_table, rename
from evenkeel.sources.write import write_quarantine


@dataclass
class Part:
    """Result rows of one audited pair, not yet computed; ``planned`` finds the checks that fail if the whole does."""

    label: str
    rows: Callable[[], DataFrame]
    planned: Callable[[], PairAudit] | None = None


@dataclass
class Audit:
    """Results of a run. The checks run once, when :attr:`results` is first asked for."""

    spark: SparkSession
    parts: list[Part] = field(default_factory=list)
    quarantined: dict[str, list[DataFrame]] = field(default_factory=dict)
    run_id: str = ""
    parallel: int = 4

    @cached_property
    def results(self) -> DataFrame:
        """All result rows, one per check: pairs run a few at a time, and rows are kept.

        If the jobs of a pair fail, its checks run in halves and halves of these, until those that fail are alone; each
        of them gives one ERROR row.
        """
        with ThreadPoolExecutor(max_workers=self.parallel) as pool:
            found = [row for part in pool.map(self._rows, self.parts) for row in part]
        return self.spark.createDataFrame(found, R.RESULT_SCHEMA)

    def _rows(self, part: Part) -> list:
        try:
            return part.rows().collect()
        except Exception as e:
            try:
                audit = part.planned() if part.planned else None
            except Exception:  # not even a plan
                audit = None
            if audit is None:
                return self._error(part.label, R.Finding("audit", "audit", None, "", ""), e)
        return audit.isolated(partial(self._error, part.label))

    def _error(self, label: str, check: R.Finding, e: Exception) -> list:
        message = hide_password(f"{type(e).__name__}: {e}")
        found = fixed_finding(check.category, check.check, check.column, ERROR, message)
        return R.fixed(self.spark, [found], label, self.run_id).collect()

    def materialize(self) -> DataFrame:
        """The same as :attr:`results`."""
        return self.results

    def verdict(self) -> str:
        return rollup.final_verdict(self.results)


class Loader:
    """Reads the tables of a configuration; ``tables`` may hold frames for names used as paths."""

    def __init__(self, spark: SparkSession, config: AuditConfig, tables: Mapping[str, DataFrame] | None = None):
        self.spark, self.config, self.tables = spark, config, tables or {}

    def read(self, path: str, query: str | None = None, options: Mapping | None = None, texts: dict | None = None) -> DataFrame:
        """``texts`` gets the text files that were read, with their reader options and what the pass for types found."""
        if path in self.tables:
            return self.tables[path]
        settings = {"na_values": self.config.na_values, **(options or {})}
        if is_database(path) or is_parquet(path):
            return read_table(self.spark, path, query=query, **settings)
        profiles: list = []
        if texts is not None:
            texts[path] = settings, profiles
        return read_table(self.spark, path, query=query, profiles=profiles, **settings)

    def parents(self, table: TableConfig, texts: dict | None = None) -> dict[str, DataFrame | Exception]:
        out: dict[str, DataFrame | Exception] = {}
        for rel in table.relationships:
            path = rel.parent.get("target")
            if path and path not in out:
                try:
                    out[path] = self.read(path, options=rel.parent.get("options"), texts=texts)
                except (FileNotFoundError, DataLoadError) as e:
                    out[path] = e
        return out


@dataclass
class Pair:
    source: DataFrame
    target: DataFrame
    label: str


def load_pairs(
    loader: Loader,
    name: str,
    table: TableConfig,
    ignore_invalid_rows: bool,
    quarantined: list[DataFrame],
    texts: dict | None = None,
) -> list[Pair]:
    """The pairs to audit: one, or one per target where every target is a full copy."""

    def one(spec: TableSpec, is_source: bool, mapping: Mapping[str, str]) -> DataFrame:
        df = loader.read(spec.path, spec.query, spec.options, texts)
        if not table.complex_mapping:
            df = rename(df, mapping)  # a simple mapping renames before rows are validated
        if ignore_invalid_rows:
            df, bad = Q.quarantine(df, table, name, is_source, spec.path)
            quarantined.append(bad)
        return rename(df, mapping) if table.complex_mapping else df

    cm = table.complex_mapping
    if cm is None:
        if not isinstance(table.source, str) or not isinstance(table.target, str):
            raise DataLoadError("source or target is not configured")
        source = one(TableSpec(table.source, query=table.source_query, options=table.source_options), True, table.column_mapping)
        target = one(TableSpec(table.target, query=table.target_query, options=table.target_options), False, {})
        return [Pair(source, target, name)]
    sources = [one(s, True, s.column_mapping) for s in cm.sources]
    targets = [one(t, False, t.column_mapping) for t in cm.targets]
    first = cm.sources[0]
    key = first.column_mapping.get(first.primary_key, first.primary_key) if first.primary_key else table.primary_key
    source = M.merge_sources(sources, cm.mapping_type, cm.aggregation_strategy, key)
    if cm.mapping_type == "1:N" and cm.split_strategy == "copy" and len(targets) > 1:
        return [Pair(source, t, f"{name}[{i + 1}]") for i, t in enumerate(targets)]
    keys = [t.primary_key or table.primary_key for t in cm.targets]
    return [Pair(source, M.merge_targets(targets, cm.mapping_type, cm.split_strategy, keys), name)]


def bad_line_rows(
    spark: SparkSession, path: str, options: Mapping, status: str, label: str, run_id: str = "", profiles: Sequence[CsvProfile] = ()
) -> DataFrame:
    """A result row if lines of a text file could not be read as they stand; none otherwise. A profile saves the pass."""
    counts = {"long_lines": "long_lines", "stray_quotes": "stray_quotes"}
    found = R.Finding(
        "load", "csv_lines", None, quote(status),
        R.text("%d lines with more fields than the header are left out, %d lines or files with a stray quote", *counts.values()),
        counts, {"path": quote(path)}, when="long_lines + stray_quotes > 0",
    )
    if profiles:
        facts = R.one_row(spark).selectExpr(f"{profiles[0].long_lines}L AS long_lines", f"{profiles[0].stray_quotes}L AS stray_quotes")
    else:
        facts = bad_lines(spark, path, **{k: options[k] for k in ("delimiter", "encoding", "multiline") if k in options})
    return R.rows(facts, [found], label, run_id)


def run_audit(
    spark: SparkSession,
    config: AuditConfig,
    tables: Sequence[str] | None = None,
    dry_run: bool = False,
    ignore_invalid_rows: bool = False,
    frames: Mapping[str, DataFrame] | None = None,
    run_id: str = "",
    quarantine_path: str | None = None,
    parallel: int = 4,
) -> Audit:
    """Audit the chosen tables of a configuration.

    A table that cannot be loaded or whose checks cannot be planned gives one ERROR row; the others go
    on. ``dry_run`` only loads. ``frames`` supplies tables under the names that the configuration uses
    as paths. With ``quarantine_path`` invalid rows are written there. ``parallel`` tables are prepared at
    a time (type inference, staged keys).
    """
    loader = Loader(spark, config, frames)
    audit = Audit(spark, run_id=run_id, parallel=parallel)

    def error(check: str, label: str, e: Exception) -> Part:
        message = hide_password(f"{type(e).__name__}: {e}")
        found = fixed_finding(check, check, None, ERROR, message)
        return Part(label, partial(R.fixed, spark, [found], label, run_id))

    def one(name: str) -> tuple[list[Part], list[DataFrame]]:
        table = config.tables[name]
        bad: list[DataFrame] = []
        texts: dict = {}
        try:
            pairs = load_pairs(loader, name, table, ignore_invalid_rows, bad, texts)
            if quarantine_path:
                for rows in bad:
                    write_quarantine(rows, f"{quarantine_path}/{name}")
        except Exception as e:  # one bad table must not end the run
            return [error("load", name, e)], bad
        if dry_run:
            return [], bad
        settings = Settings(
            config.volume_tolerance(table), config.aggregate_tolerance(table), config.strict_schema, run_id
        )
        parts = []
        for pair in pairs:
            what = pair.source, pair.target, table, pair.label, settings, loader.parents(table, texts)
            parts.append(Part(pair.label, partial(audit_pair, *what), partial(PairAudit.of, *what)))
        for path, (options, profiles) in texts.items():
            parts.append(Part(name, partial(bad_line_rows, spark, path, options, config.bad_lines, name, run_id, profiles)))
        return parts, bad

    names = [n for n in tables or config.tables if n in config.tables]
    with ThreadPoolExecutor(max_workers=parallel) as pool:
        for name, (parts, bad) in zip(names, pool.map(one, names)):
            audit.parts += parts
            if bad:
                audit.quarantined[name] = bad
    return audit
