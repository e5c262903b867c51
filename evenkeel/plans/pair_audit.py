"""All checks of one table pair as a few fused jobs.

The configuration is turned into checks of four shapes, and each shape reads the data once:

1. scalar metrics    one aggregate per side, no shuffle of rows
2. value counts      one shuffle for all enum, distribution and length checks
3. key counts        one shuffle for all key columns (identity, uniqueness, foreign keys)
4. timestamp pairs   one shuffle for all datetime columns

The inputs of a shape are small functions, so the same plan runs over tables (:class:`TableInputs`) and
over the stored state of an incremental audit.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from evenkeel import results as R
from evenkeel.config import TableConfig
from evenkeel.operators import aggregates, constraints, datetimes, frequency, keys, strings, volume
from evenkeel.operators import facts as A
from evenkeel.operators.run import scalar_parts
from evenkeel.plans import registry
from evenkeel.results import ERROR, FAIL, Finding, fixed_finding
from evenkeel.session import require_utc


@dataclass(frozen=True)
class Settings:
    """What applies to a table beside its own configuration."""

    volume_tolerance: float = 0.1
    aggregate_tolerance: float = 1.0
    strict_schema: bool = False
    run_id: str = ""


@dataclass(frozen=True)
class ForeignKey:
    check: keys.KeyCheck
    read: keys.KeyReader
    parent: DataFrame | None  # None: the target itself


@dataclass
class PairPlan:
    """Checks of one table pair by shape."""

    fixed: list[Finding]
    scalar: list[A.ScalarCheck]
    values: list[frequency.ValueCheck]
    keyed: dict[str, tuple[keys.KeyReader, list[keys.KeyCheck]]]
    links: list[ForeignKey]
    stamps: list[str]
    stamp_key: str | None = None
    stamp_read: keys.KeyReader = A.Side.col

    def counted(self) -> list[frequency.Counted]:
        return list(dict.fromkeys(c.counted for c in self.values))

    def single(self) -> list[tuple[Finding, PairPlan]]:
        """A plan for each check, with a finding that names it."""
        blank = PairPlan([], [], [], {}, [], [], self.stamp_key, self.stamp_read)
        scope = R.Scope()
        get, sides = A.Facts("", scope), (A.Facts("s", scope), A.Facts("t", scope))
        out = [([f], replace(blank, fixed=[f])) for f in self.fixed]
        out += [(c.decide(*sides), replace(blank, scalar=[c])) for c in self.scalar]
        out += [(c.decide(get), replace(blank, values=[c])) for c in self.values]
        out += [(c.decide(get), replace(blank, keyed={k: (read, [c])})) for k, (read, cs) in self.keyed.items() for c in cs]
        out += [(link.check.decide(get), replace(blank, links=[link])) for link in self.links]
        out += [(datetimes.offset_findings([c]), replace(blank, stamps=[c])) for c in self.stamps]
        return [(found[0], plan) for found, plan in out if found]


def schema_findings(source: Sequence[str], target: Sequence[str], strict: bool) -> list[Finding]:
    """Columns the target lacks and, in strict mode, columns only the target has."""
    lost = [c for c in source if c not in target]
    extra = [c for c in target if c not in source]
    out = []
    if lost:
        out.append(fixed_finding("schema", "schema_missing_columns", ",".join(lost), FAIL, f"the target lacks: {', '.join(lost)}"))
    if strict and extra:
        out.append(
            fixed_finding("schema", "schema_unexpected_columns", ",".join(extra), FAIL, f"only the target has: {', '.join(extra)}")
        )
    return out


def plan_pair(
    source: A.Side,
    target: A.Side,
    table: TableConfig,
    settings: Settings = Settings(),
    parents: Mapping[str, DataFrame | Exception] | None = None,
) -> PairPlan:
    """Turn the configuration of a table into checks, in the order the results are listed."""
    parents = parents or {}
    plan = PairPlan(schema_findings(source.columns, target.columns, settings.strict_schema), [], [], {}, [], [])
    mapping = table.complex_mapping

    plan.scalar.append(
        volume.plan_volume(
            source, target, settings.volume_tolerance,
            mapping.mapping_type if mapping else None, mapping.expected_ratio if mapping else None,
        )
    )

    def keyed(column: str, make) -> None:
        read, same_type = keys.key_reader(source.dtype(column), target.dtype(column))
        plan.keyed.setdefault(column, (read, []))[1].append(make(same_type))

    pk = table.primary_key
    has_key = pk in source and pk in target
    if has_key:
        keyed(pk, lambda same: keys.plan_identity(pk, table.identity_overlap_threshold, same))

    for column in table.aggregates:
        src_col, tgt_col = table.aggregate_pair(column)
        plan.scalar += aggregates.plan_aggregates(source, target, src_col, settings.aggregate_tolerance, tgt_col)

    for rule in table.mappings:
        plan.scalar.append(constraints.plan_allowed_values(target, rule.columns, rule.allowed_values))

    for rel in table.relationships:
        fk, parent_pk, name = rel.child["fk_column"], rel.parent["pk_column"], rel.parent.get("target") or ""
        parent = parents.get(name) if name else None
        if name and not isinstance(parent, DataFrame):
            reason = f"the parent table '{name}' cannot be read: {parent}"
            plan.fixed.append(fixed_finding("relationships", "foreign_key", fk, ERROR, reason))
            continue
        parent_schema = parent.schema if parent is not None else target.schema
        if fk not in target:
            plan.fixed.append(fixed_finding("relationships", "foreign_key", fk, FAIL, f"column '{fk}' is missing from the child table"))
        elif parent_pk not in parent_schema.names:
            plan.fixed.append(fixed_finding("relationships", "foreign_key", fk, FAIL, f"column '{parent_pk}' is missing from the parent table"))
        else:
            read, _ = keys.key_reader(target.dtype(fk), parent_schema[parent_pk].dataType)
            plan.links.append(ForeignKey(keys.plan_foreign_key(fk, parent_pk), read, parent))

    for column, rules in table.data_constraints.items():
        try:
            plan.scalar.append(constraints.plan_constraints(target, column, rules))
        except ValueError as e:
            plan.fixed.append(fixed_finding("data_constraints", "constraint", column, ERROR, str(e)))

    def value_check(column: str, category: str, check: str, make) -> None:
        absent = frequency.missing_columns(source.columns, target.columns, column, category, check)
        if absent:
            plan.fixed.append(absent)
        else:
            plan.values.append(make())

    for c in table.string_columns:
        value_check(c.column, "string", "truncation", lambda c=c: frequency.plan_truncation(c.column, c.max_length))
        if c.check_whitespace:
            plan.scalar.append(strings.plan_whitespace(source, target, c.column))
        if c.check_encoding:
            plan.scalar.append(strings.plan_encoding(source, target, c.column))

    for c in table.enum_columns:
        name = "enum_mapped" if c.mapping else "enum"
        value_check(c.column, "enum", name, lambda c=c: frequency.plan_enum(c.column, c.mapping))
        if c.check_distribution:
            value_check(
                c.column, "enum", "distribution",
                lambda c=c: frequency.plan_distribution(c.column, c.distribution_tolerance_pct, c.mapping),
            )

    for c in table.datetime_columns:
        plan.scalar.append(datetimes.plan_datetime(source, target, c.column, c.expected_tz))
        if has_key and c.column in source and c.column in target:
            plan.stamps.append(c.column)
    if plan.stamps:
        plan.stamp_key = pk
        plan.stamp_read, _ = keys.key_reader(source.dtype(pk), target.dtype(pk))

    for c in table.null_sentinels:
        plan.scalar.append(constraints.plan_null_sentinel(source, target, c.column, c.sentinels))
    for c in table.numeric_precision_columns:
        plan.scalar.append(
            aggregates.plan_precision(source, target, c.column, c.expected_precision, c.expected_scale)
        )
    for c in table.boolean_columns:
        plan.scalar.append(strings.plan_boolean(source, target, c.column, c.true_values, c.false_values))
    for column in table.unique_columns:
        if column in source and column in target:
            keyed(column, lambda same, column=column: keys.plan_uniqueness(column))
        else:
            message = f"column '{column}' is missing from source or target"
            plan.fixed.append(fixed_finding("data_constraints", "uniqueness", column, FAIL, message))
    for spec in table.custom_checks:
        try:
            plan.scalar += registry.plan_custom(source, target, spec)
        except Exception as e:  # a check that cannot be planned must not stop the others
            name = str(spec.get("check"))
            plan.fixed.append(fixed_finding("custom", name, None, ERROR, f"{type(e).__name__}: {e}"[:500]))
    return plan


class TableInputs:
    """Shape inputs read straight from the two tables."""

    def __init__(self, source: DataFrame, target: DataFrame):
        self.frames = {"source": source, "target": target}

    def metrics(self, side: str, metrics: Sequence[A.Metric]) -> DataFrame:
        return A.measure(self.frames[side], metrics)

    def values(self, side: str, counted: Sequence[frequency.Counted]) -> DataFrame:
        return frequency.value_rows(self.frames[side], counted)

    def keys(self, side: str, column: str, read: keys.KeyReader) -> keys.KeyColumn:
        return keys.read_column(self.frames[side], column, read)

    def stamps(self, side: str, key: str, columns: Sequence[str], read: keys.KeyReader) -> DataFrame:
        return datetimes.stamp_rows(self.frames[side], key, columns, read)

    def all_stamps(self, side: str, key: str, columns: Sequence[str], read: keys.KeyReader) -> DataFrame:
        """Also the rows without a pair, so that the keys can be counted in the same pass."""
        return datetimes.stamp_rows(self.frames[side], key, columns, read, keep_all=True)


def pair_results(spark: SparkSession, inputs, plan: PairPlan, table: str, run_id: str = "") -> DataFrame:
    """Result rows of a plan over its inputs."""
    parts = []
    if plan.fixed:
        parts.append(R.fixed(spark, plan.fixed, table, run_id))
    parts += scalar_parts(spark, inputs.metrics, plan.scalar, table, run_id)
    if plan.values:
        pairs = frequency.paired(
            inputs.values("source", plan.counted()), inputs.values("target", plan.counted())
        )
        parts.append(frequency.value_check_rows(pairs, plan.values, table, run_id))
    # where timestamps are paired by the key anyway, its counts come from the same shuffle
    shared = bool(plan.stamps) and plan.stamp_key in plan.keyed and hasattr(inputs, "all_stamps")
    compared, checks = [], []
    for column, (read, some) in plan.keyed.items():
        if not (shared and column == plan.stamp_key):
            compared.append((inputs.keys("source", column, read), inputs.keys("target", column, read)))
            checks.append(some)
    for link in plan.links:
        child, parent = link.check.source_column, link.check.target_column
        of_parent = inputs.keys("target", parent, link.read) if link.parent is None else keys.read_column(link.parent, parent, link.read)
        compared.append((inputs.keys("target", child, link.read), of_parent))
        checks.append([link.check])
    if compared:
        parts.append(keys.compared_rows(compared, checks, table, run_id))
    if plan.stamps:
        require_utc(spark)
        stamps = inputs.all_stamps if shared else inputs.stamps
        source, target = (stamps(side, plan.stamp_key, plan.stamps, plan.stamp_read) for side in ("source", "target"))
        reduced = datetimes.reduce_keys(source, target)
        deltas = datetimes.key_deltas(reduced, source, target)
        parts.append(datetimes.delta_rows(deltas, plan.stamps, table, run_id))
        if shared:
            of_key = plan.keyed[plan.stamp_key][1]
            parts.append(keys.fact_rows(datetimes.key_facts(reduced, plan.stamps[0]), of_key, table, run_id))
    return R.union(spark, parts)


def audit_pair(
    source: DataFrame | None,
    target: DataFrame | None,
    table: TableConfig,
    name: str,
    settings: Settings = Settings(),
    parents: Mapping[str, DataFrame | Exception] | None = None,
) -> DataFrame:
    """Every configured check of a source and a target as result rows."""
    absent = [w for w, df in (("source", source), ("target", target)) if not isinstance(df, DataFrame)]
    if absent:
        present = source if isinstance(source, DataFrame) else target
        spark = present.sparkSession if isinstance(present, DataFrame) else SparkSession.getActiveSession()
        message = f"no checks run: the {' and '.join(absent)} is no table"
        return R.fixed(spark, [fixed_finding("input", "input", None, FAIL, message)], name, settings.run_id)
    plan = plan_pair(A.Side.of(source), A.Side.of(target), table, settings, parents)
    return pair_results(source.sparkSession, TableInputs(source, target), plan, name, settings.run_id)


def merged(plans: Sequence[PairPlan]) -> PairPlan:
    """One plan with the checks of all of them, which belong to one pair."""
    out = replace(plans[0], fixed=[], scalar=[], values=[], keyed={}, links=[], stamps=[])
    for plan in plans:
        for name in ("fixed", "scalar", "values", "links", "stamps"):
            getattr(out, name).extend(getattr(plan, name))
        for column, (read, checks) in plan.keyed.items():
            out.keyed.setdefault(column, (read, []))[1].extend(checks)
    return out


def isolate(checks: Sequence[tuple[Finding, PairPlan]], run: Callable[[PairPlan], list], failed: Callable[[Finding, Exception], list]) -> list:
    """What ``run`` gives for checks that failed together, and ``failed`` for each that fails on its own.

    Halves run fused, and only those that fail are halved again: one bad check of n costs about 2 log2(n) fused runs.
    """
    rows = []
    middle = (len(checks) + 1) // 2
    for half in (checks[:middle], checks[middle:]):
        if not half:
            continue
        try:
            rows += run(merged([plan for _, plan in half]))
        except Exception as e:
            rows += failed(half[0][0], e) if len(half) == 1 else isolate(half, run, failed)
    return rows


@dataclass(frozen=True)
class PairAudit:
    """The planned audit of a pair. ``checks`` are its checks one by one, each a plan with a finding that names it."""

    spark: SparkSession
    inputs: TableInputs
    plan: PairPlan
    name: str
    run_id: str

    @classmethod
    def of(
        cls,
        source: DataFrame,
        target: DataFrame,
        table: TableConfig,
        name: str,
        settings: Settings = Settings(),
        parents: Mapping[str, DataFrame | Exception] | None = None,
    ) -> PairAudit:
        plan = plan_pair(A.Side.of(source), A.Side.of(target), table, settings, parents)
        return cls(source.sparkSession, TableInputs(source, target), plan, name, settings.run_id)

    def rows(self, plan: PairPlan | None = None) -> DataFrame:
        return pair_results(self.spark, self.inputs, plan or self.plan, self.name, self.run_id)

    def isolated(self, failed: Callable[[Finding, Exception], list]) -> list:
        """All result rows, after the fused audit has failed."""
        return isolate(self.plan.single(), lambda plan: self.rows(plan).collect(), failed)
