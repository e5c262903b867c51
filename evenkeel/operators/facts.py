"""Shape 1: every scalar metric of one side in a single aggregate.

A ``Metric`` knows how to compute itself over rows and how to merge with itself, so the same
definition serves the one-pass batch audit and the incremental audit that stores one row per batch.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions import values as V
from evenkeel.results import Finding, Scope

# Metrics per scan. Beyond about 100 fields Spark leaves whole-stage codegen, and far below that the
# generated method gets too large for the JIT compiler, so a wide
# audit is split; with a columnar source each part reads only its own columns.
METRICS_PER_SCAN = 48


@dataclass(frozen=True)
class Metric:
    """``update`` is an aggregate in SQL text; ``merge`` names how stored values combine."""

    name: str
    update: str
    merge: str  # sum | try_sum | min | max | m2
    parts: tuple[str, str] | None = None  # for m2: names of the count and the sum


def _name(kind: str, column: str = "", *params) -> str:
    """A name that is also a valid parquet column name."""
    clean = "".join(ch if ch.isascii() and ch.isalnum() else "_" for ch in column)
    if clean != column or params:
        clean += "_" + hashlib.sha256(repr((column, params)).encode()).hexdigest()[:8]
    return f"{kind}__{clean}" if column else kind


# Derived columns by name. The name is a hash of the expression, so equal expressions share a column.
_DERIVED: dict[str, str] = {}
_DERIVED_NAME = re.compile(r"\b_d[0-9a-f]{12}\b")


def derived(sql: str) -> str:
    """The name of a column computed once per row before the aggregate, for costly expressions that
    several metrics use."""
    name = "_d" + hashlib.sha256(sql.encode()).hexdigest()[:12]
    _DERIVED[name] = sql
    return name


class Side:
    """Expressions of one side of a pair, folded so that NaN is NULL."""

    def __init__(self, schema: T.StructType):
        self.schema = schema
        self.columns = schema.names

    @classmethod
    def of(cls, df: DataFrame) -> "Side":
        return cls(df.schema)

    def __contains__(self, name: str) -> bool:
        return name in self.columns

    def dtype(self, name: str) -> T.DataType:
        return self.schema[name].dataType

    def col(self, name: str) -> str:
        return V.fold_nan(V.ident(name), self.dtype(name))

    def text(self, name: str) -> str:
        return V.to_text(self.col(name), self.dtype(name))

    def number(self, name: str) -> str:
        return V.to_number(V.ident(name), self.dtype(name))

    def shared_number(self, name: str) -> str:
        """The number for use in several metrics: text is parsed once per row."""
        number = self.number(name)
        return derived(number) if isinstance(self.dtype(name), T.StringType) else number

    # --- metrics -------------------------------------------------------------------------

    def rows(self) -> Metric:
        return Metric("rows", "count(1)", "sum")

    def nonnull(self, name: str) -> Metric:
        return Metric(_name("nonnull", name), f"count({self.col(name)})", "sum")

    def count_where(self, kind: str, name: str, predicate: str, *params) -> Metric:
        return Metric(_name(kind, name, *params), f"count_if({predicate})", "sum")

    def numbers(self, name: str) -> dict[str, Metric]:
        """Count, sum, min, max and squared deviation of the numeric values.

        Sums of doubles depend on the order of addition, so two equal tables that are partitioned
        differently would differ in the last bits. Beside the double sum the whole part and the
        millionths of every value are summed as integers, which is order-free and says whether
        the two sums are really equal.
        """
        x, dtype = self.shared_number(name), self.dtype(name)
        if V.is_integer_type(dtype):
            number = f"CAST({V.ident(name)} AS INT)" if isinstance(dtype, T.BooleanType) else V.ident(name)
            whole, micro = f"CAST({number} AS BIGINT)", f"CASE WHEN {number} IS NOT NULL THEN 0L END"
        else:
            whole = f"floor({x})"
            micro = f"floor(({x} - CAST(floor({x}) AS DOUBLE)) * 1e6D + 0.5D)"
        return {
            "n": Metric(_name("n", name), f"count({x})", "sum"),
            "sum": Metric(_name("sum", name), f"sum({x})", "sum"),
            "whole": Metric(_name("whole", name), f"try_sum({whole})", "try_sum"),
            "micro": Metric(_name("micro", name), f"try_sum({micro})", "try_sum"),
            "min": Metric(_name("min", name), f"min({x})", "min"),
            "max": Metric(_name("max", name), f"max({x})", "max"),
            "m2": Metric(
                _name("m2", name), f"var_pop({x}) * count({x})", "m2", (_name("n", name), _name("sum", name))
            ),
        }

    def digits(self, name: str) -> dict[str, Metric]:
        """Most digits after the point and most digits at all, of the plain decimal form."""
        dtype = self.dtype(name)
        if isinstance(dtype, (T.DoubleType, T.FloatType, T.StringType)):
            x = self.shared_number(name)
            text = V.plain_number(x, T.DoubleType())
            scale = derived(f"CASE WHEN abs({x}) < 1e9D THEN {_short_scale(x)} END")
            present = x
            whole_digits = f"length(CAST(CAST(abs({x}) AS BIGINT) AS STRING))"
            scale_of = f"CASE WHEN {scale} IS NOT NULL THEN {scale} ELSE {_text_scale(text)} END"
            digits = f"CASE WHEN {scale} IS NOT NULL THEN {scale} + {whole_digits} ELSE {_text_digits(text)} END"
        else:
            present = self.col(name)
            text = V.plain_number(present, dtype)
            scale_of, digits = _text_scale(text), _text_digits(text)
        return {
            "n": Metric(_name("digits_n", name), f"count({present})", "sum"),
            "scale": Metric(_name("scale", name), f"max({scale_of})", "max"),
            "precision": Metric(_name("precision", name), f"max({digits})", "max"),
        }

    def lowest(self, kind: str, name: str, value: str, *params) -> Metric:
        return Metric(_name(kind, name, *params), f"min({value})", "min")

    def highest(self, kind: str, name: str, value: str, *params) -> Metric:
        return Metric(_name(kind, name, *params), f"max({value})", "max")


def _short_scale(x: str) -> str:
    """Digits after the point if at most six, found without printing the number.

    ``n / 10^s`` is the double nearest to that decimal, so it equals ``x`` exactly if ``x`` prints with
    at most ``s`` digits; below 1e9 all integers here are exact.
    """
    tests = " ".join(f"WHEN rint({x} * 1e{s}D) / 1e{s}D = {x} THEN {s}" for s in range(1, 7))
    return f"CASE WHEN rint({x}) = {x} THEN 0 {tests} END"


def _text_scale(text: str) -> str:
    return (
        f"CASE WHEN contains({text}, '.') THEN length(substring_index({text}, '.', -1))"
        f" WHEN {text} IS NOT NULL THEN 0 END"
    )


def _text_digits(text: str) -> str:
    return f"length(translate({text}, '.-', ''))"


class Facts:
    """Access to the metrics of one side inside a rule."""

    def __init__(self, struct: str, scope: Scope):
        self.struct, self.scope = struct, scope

    def __call__(self, metric: Metric | str) -> str:
        name = metric.name if isinstance(metric, Metric) else metric
        return f"{self.struct}.{V.ident(name)}" if self.struct else V.ident(name)

    def let(self, sql: str) -> str:
        return self.scope.let(sql)


@dataclass(frozen=True)
class ScalarCheck:
    """Metrics of both sides and the rule that turns them into findings."""

    source: Sequence[Metric]
    target: Sequence[Metric]
    decide: Callable[[Facts, Facts], Sequence[Finding]]


def unique(metrics: Sequence[Metric]) -> list[Metric]:
    return list({m.name: m for m in metrics}.values())


def measure(df: DataFrame, metrics: Sequence[Metric]) -> DataFrame:
    """One row of metrics for a side: a partial aggregate per task, then one small merge."""
    # derived columns may build on others: the innermost come first
    levels: list[list[str]] = []
    texts = [m.update for m in unique(metrics)]
    while names := list(dict.fromkeys(n for text in texts for n in _DERIVED_NAME.findall(text))):
        levels.insert(0, names)
        texts = [_DERIVED[n] for n in names]
    known: set[str] = set()
    for names in levels:
        df = df.selectExpr("*", *[f"{_DERIVED[n]} AS {n}" for n in names if n not in known])
        known |= set(names)
    return df.selectExpr(*[f"{m.update} AS {V.ident(m.name)}" for m in unique(metrics)])


def merge(state: DataFrame, metrics: Sequence[Metric]) -> DataFrame:
    """Merge stored rows (one per batch) into one row equal to :func:`measure` over all batches.

    Squared deviations merge around the grand mean: the first aggregate gives the means, the second
    adds ``n * (mean - grand mean)^2`` of every batch. Both run over one row per batch.
    """
    metrics = unique(metrics)
    spreads = [m for m in metrics if m.merge == "m2"]
    if spreads:
        means = state.groupBy(F.lit(1).alias("_one")).agg(
            *[
                F.expr(f"try_divide(sum({m.parts[1]}), sum({m.parts[0]}))").alias(f"_mean_{i}")
                for i, m in enumerate(spreads)
            ]
        )
        state = state.withColumn("_one", F.lit(1)).join(F.broadcast(means), "_one")  # one row
    out = []
    for m in metrics:
        if m.merge == "m2":
            n, total = m.parts
            gap = f"(try_divide({total}, {n}) - _mean_{spreads.index(m)})"
            out.append(f"sum({m.name} + {n} * {gap} * {gap}) AS {m.name}")
        else:
            out.append(f"{m.merge}({m.name}) AS {m.name}")
    return state.selectExpr(*out)


def pair(source_row: DataFrame, target_row: DataFrame) -> DataFrame:
    """Bring the two one-row frames together as one row with structs ``s`` and ``t``."""
    s = source_row.selectExpr("struct(*) AS s")
    t = target_row.selectExpr("struct(*) AS t")
    return s.unionByName(t, allowMissingColumns=True).selectExpr("first(s, true) AS s", "first(t, true) AS t")


def batches(checks: Sequence[ScalarCheck]) -> list[list[ScalarCheck]]:
    """Split checks so that no aggregate grows past the codegen limit."""
    out: list[list[ScalarCheck]] = []
    names: set[str] = set()
    for check in checks:
        more = {m.name for m in (*check.source, *check.target)}
        if not out or len(names | more) > METRICS_PER_SCAN:
            out.append([])
            names = set()
        out[-1].append(check)
        names |= more
    return out


def findings(checks: Sequence[ScalarCheck], scope: Scope) -> list[Finding]:
    s, t = Facts("s", scope), Facts("t", scope)
    return [f for check in checks for f in check.decide(s, t)]
