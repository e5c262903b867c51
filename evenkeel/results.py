"""Result rows: one row per check outcome."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from evenkeel.functions.values import quote

PASS, WARN, FAIL, ERROR = "PASS", "WARN", "FAIL", "ERROR"
SEVERITY = {PASS: 0, WARN: 1, FAIL: 2, ERROR: 3}

RESULT_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("table_name", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("check", T.StringType()),
        T.StructField("column", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("severity", T.IntegerType()),
        T.StructField("message", T.StringType()),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("details", T.MapType(T.StringType(), T.StringType())),
        T.StructField("samples", T.ArrayType(T.StringType())),
    ]
)

_LET = re.compile(r"\b_x(\d+)\b")


class Scope:
    """Names for intermediate values, so that a rule is computed once and not copied into its uses."""

    def __init__(self) -> None:
        self.levels: list[dict[str, str]] = []
        self._level: dict[str, int] = {}

    def let(self, sql: str) -> str:
        for values in self.levels:
            for name, known in values.items():
                if known == sql:
                    return name
        level = max((self._level[f"_x{n}"] + 1 for n in _LET.findall(sql)), default=0)
        name = f"_x{len(self._level)}"
        self._level[name] = level
        while len(self.levels) <= level:
            self.levels.append({})
        self.levels[level][name] = sql
        return name


def case(*branches: tuple[str, str], otherwise: str) -> str:
    """``CASE WHEN`` over (condition, status) pairs, tested in order."""
    whens = " ".join(f"WHEN {condition} THEN {quote(status)}" for condition, status in branches)
    return f"CASE {whens} ELSE {quote(otherwise)} END"


def text(template: str, *values: str) -> str:
    """A message built by ``format_string``."""
    return f"format_string({', '.join([quote(template), *values])})"


def literal(name: str) -> str:
    """A name as part of a message template."""
    return name.replace("%", "%%")


@dataclass(frozen=True)
class Finding:
    """One result row, as SQL expressions over a one-row frame of facts."""

    category: str
    check: str
    column: str | None
    status: str
    message: str
    metrics: Mapping[str, str] = field(default_factory=dict)
    details: Mapping[str, str] = field(default_factory=dict)
    samples: str = "array()"
    when: str = "true"  # the row exists only where this holds


def fixed_finding(category: str, check: str, column: str | None, status: str, message: str) -> Finding:
    """A finding that is known without looking at data."""
    return Finding(category, check, column, quote(status), quote(message))


def _map(items: Mapping[str, str], type_name: str) -> str:
    if not items:
        return f"map_from_arrays(CAST(array() AS array<string>), CAST(array() AS array<{type_name}>))"
    return "map(" + ", ".join(f"{quote(k)}, CAST({v} AS {type_name})" for k, v in items.items()) + ")"


def _struct(f: Finding) -> str:
    return (
        f"named_struct('category', {quote(f.category)}, 'check', {quote(f.check)},"
        f" 'column', CAST({quote(f.column)} AS STRING), 'status', {f.status}, 'message', {f.message},"
        f" 'metrics', {_map(f.metrics, 'double')}, 'details', {_map(f.details, 'string')},"
        f" 'samples', CAST({f.samples} AS array<string>), '_emit', coalesce({f.when}, false))"
    )


def rows(
    facts: DataFrame, findings: Iterable[Finding], table: str, run_id: str = "", scope: Scope | None = None
) -> DataFrame:
    """Turn a one-row frame of facts into result rows.

    The structs are built inside a lambda, which Spark interprets. For a single row that is far
    cheaper than compiling the decision rules of a wide audit to Java.
    """
    for values in scope.levels if scope else ():
        facts = facts.selectExpr("*", *[f"{sql} AS {name}" for name, sql in values.items()])
    structs = ", ".join(_struct(f) for f in findings)
    ranks = " ".join(f"WHEN '{name}' THEN {rank}" for name, rank in SEVERITY.items())
    return (
        facts.selectExpr(f"inline(flatten(transform(array(0), _i -> array({structs}))))")
        .where("_emit")
        .selectExpr(
            f"{quote(run_id)} AS run_id", f"{quote(table)} AS table_name", "category", "check", "column", "status",
            f"CASE status {ranks} END AS severity", "message", "metrics", "details", "samples",
        )
    )


def one_row(spark: SparkSession) -> DataFrame:
    return spark.range(0, 1, 1, 1)  # one partition: by default there is a task per core of the cluster


def fixed(spark: SparkSession, findings: Iterable[Finding], table: str, run_id: str = "") -> DataFrame:
    """Rows whose outcome is known without reading data (missing column, load failure)."""
    return rows(one_row(spark), findings, table, run_id)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RESULT_SCHEMA)


def union(spark: SparkSession, parts: Iterable[DataFrame]) -> DataFrame:
    parts = list(parts)
    return reduce(DataFrame.unionByName, parts) if parts else empty(spark)


def flat(
    results: DataFrame, counts: Iterable[str] = (), numbers: Iterable[str] = (), texts: Iterable[str] = ()
) -> DataFrame:
    """Named metrics and details as plain columns."""
    return results.selectExpr(
        "table_name", "check", "column", "status",
        *[f"CAST(metrics[{quote(n)}] AS BIGINT) AS {n}" for n in counts],
        *[f"round(metrics[{quote(n)}], 4) AS {n}" for n in numbers],
        *[f"details[{quote(n)}] AS {n}" for n in texts],
    )
