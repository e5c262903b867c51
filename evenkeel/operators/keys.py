"""Shape 3: keys and their row counts on both sides.

One union and one aggregate answer key overlap, uniqueness and referential integrity. Rows of a hot
key are summed before the shuffle; no join is needed and no key is collected. The keys of all checks of a pair
are read in one scan per table, told apart by the number of their check, and reduced in one shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel import results as R
from evenkeel.functions import values as V
from evenkeel.functions.values import quote
from evenkeel.operators.facts import Facts, Side
from evenkeel.results import FAIL, PASS, WARN, Finding, case, fixed_finding, text

# What one key ``(k, src_n, tgt_n)`` adds to the numbers every key check needs.
PER_KEY = {
    "src_rows": "src_n",
    "tgt_rows": "tgt_n",
    "src_nulls": "IF(k IS NULL, src_n, 0L)",
    "tgt_nulls": "IF(k IS NULL, tgt_n, 0L)",
    "src_distinct": "IF(k IS NOT NULL AND src_n > 0, 1L, 0L)",
    "tgt_distinct": "IF(k IS NOT NULL AND tgt_n > 0, 1L, 0L)",
    "common": "IF(k IS NOT NULL AND src_n > 0 AND tgt_n > 0, 1L, 0L)",
    "src_unmatched_keys": "IF(k IS NOT NULL AND src_n > 0 AND tgt_n = 0, 1L, 0L)",
    "src_unmatched_rows": "IF(k IS NOT NULL AND tgt_n = 0, src_n, 0L)",
}

KeyReader = Callable[[Side, str], str]


def key_reader(source: T.DataType, target: T.DataType) -> tuple[KeyReader, bool]:
    """How to read a key so that both sides have one type; False where the type families differ."""
    families = V.type_family(source), V.type_family(target)
    if families[0] != families[1]:
        # values of different families never match; no implicit cast
        def tagged(side: Side, name: str) -> str:
            return f"concat({quote(V.type_family(side.dtype(name)) + ':')}, {side.text(name)})"

        return tagged, False
    if families[0] == "number" and source != target:
        binary = [isinstance(t, (T.DoubleType, T.FloatType)) for t in (source, target)]
        integral = [isinstance(t, T.IntegralType) for t in (source, target)]
        if not all(binary) and not all(integral):
            # a common type would round: BIGINT and DOUBLE meet as DOUBLE
            return lambda side, name: V.exact_number(side.col(name), side.dtype(name)), True
    if families[0] == "time":
        return lambda side, name: f"CAST({side.col(name)} AS TIMESTAMP)", True
    return Side.col, True


def key_rows(df: DataFrame, column: str, read: KeyReader = Side.col) -> DataFrame:
    """``(k, n)``, one row per row, not yet aggregated; NULL keys stay."""
    return df.selectExpr(f"{read(Side.of(df), column)} AS k", "1L AS n")


def compact(rows: DataFrame) -> DataFrame:
    return rows.groupBy("k").agg(F.sum("n").alias("n"))


def paired(source_rows: DataFrame, target_rows: DataFrame) -> DataFrame:
    """``(k, src_n, tgt_n)``."""
    s = source_rows.selectExpr("k", "n AS src_n", "0L AS tgt_n")
    t = target_rows.selectExpr("k", "0L AS src_n", "n AS tgt_n")
    return s.unionByName(t).groupBy("k").agg(F.sum("src_n").alias("src_n"), F.sum("tgt_n").alias("tgt_n"))


def facts(pairs: DataFrame) -> DataFrame:
    """One row with the numbers every key check needs."""
    return pairs.selectExpr(*[f"coalesce(sum({sql}), 0L) AS {name}" for name, sql in PER_KEY.items()])


@dataclass(frozen=True)
class KeyColumn:
    """A key column of a frame: an expression for the key, and one for the number of rows a row stands for."""

    frame: DataFrame
    key: str
    weight: str = "1L"


def read_column(df: DataFrame, column: str, read: KeyReader = Side.col) -> KeyColumn:
    return KeyColumn(df, read(Side.of(df), column))


def tagged(compared: Sequence[tuple[KeyColumn, KeyColumn]]) -> tuple[DataFrame, list[str]]:
    """The keys of several comparisons ``(source, target)`` in one table, and the names of its key columns.

    ``check`` is the place of the comparison. Keys of one type share a column; the others are NULL. A frame that takes part in
    several comparisons is read once.
    """
    kinds = [
        s.frame.selectExpr(f"{s.key} AS k").union(t.frame.selectExpr(f"{t.key} AS k")).schema["k"].dataType.simpleString()
        for s, t in compared
    ]
    slots = {kind: f"k{i}" for i, kind in enumerate(dict.fromkeys(kinds))}
    by_frame: dict[int, tuple[DataFrame, list[str]]] = {}
    for i, (pair, kind) in enumerate(zip(compared, kinds)):
        for side, column in zip(("src_n", "tgt_n"), pair):
            named = [f"CAST({column.key if k == kind else 'NULL'} AS {k}) AS {slot}" for k, slot in slots.items()]
            counts = [f"{column.weight if n == side else '0L'} AS {n}" for n in ("src_n", "tgt_n")]
            structs = by_frame.setdefault(id(column.frame), (column.frame, []))[1]
            structs.append(f"struct({', '.join([f'{i} AS check', *named, *counts])})")
    rows = [df.selectExpr(f"inline(array({', '.join(structs)}))") for df, structs in by_frame.values()]
    return reduce(DataFrame.unionByName, rows), list(slots.values())


def compared_facts(compared: Sequence[tuple[KeyColumn, KeyColumn]]) -> DataFrame:
    """One row with a struct ``c<i>`` per comparison, which holds what :func:`facts` gives."""
    rows, slots = tagged(compared)
    pairs = rows.groupBy("check", *slots).agg(F.sum("src_n").alias("src_n"), F.sum("tgt_n").alias("tgt_n"))
    pairs = pairs.selectExpr("check", f"coalesce({', '.join(f'{s} IS NOT NULL OR NULL' for s in slots)}) AS k", "src_n", "tgt_n")
    sums = pairs.groupBy("check").agg(*[F.expr(f"sum({sql})").alias(name) for name, sql in PER_KEY.items()])
    zeros = ", ".join(f"0L AS {name}" for name in PER_KEY)
    return sums.selectExpr(*[
        f"coalesce(first(IF(check = {i}, struct({', '.join(PER_KEY)}), NULL), true), struct({zeros})) AS c{i}"
        for i in range(len(compared))
    ])


@dataclass(frozen=True)
class KeyCheck:
    """A rule over the facts of one key column pair."""

    source_column: str
    target_column: str
    decide: Callable[[Facts], Sequence[Finding]]


def key_check_rows(pairs: DataFrame, checks: Sequence[KeyCheck], table: str, run_id: str = "") -> DataFrame:
    """``checks`` all look at the same key columns."""
    return fact_rows(facts(pairs), checks, table, run_id)


def compared_rows(
    compared: Sequence[tuple[KeyColumn, KeyColumn]], checks: Sequence[Sequence[KeyCheck]], table: str, run_id: str = ""
) -> DataFrame:
    """Result rows of the ``checks`` of each comparison."""
    scope = R.Scope()
    found = [f for i, some in enumerate(checks) for c in some for f in c.decide(Facts(f"c{i}", scope))]
    return R.rows(compared_facts(compared), found, table, run_id, scope)


def fact_rows(row: DataFrame, checks: Sequence[KeyCheck], table: str, run_id: str = "") -> DataFrame:
    """Result rows from the one-row result of :func:`facts`."""
    scope = R.Scope()
    found = [f for c in checks for f in c.decide(Facts("", scope))]
    return R.rows(row, found, table, run_id, scope)


def plan_identity(column: str, threshold: float = 95.0, same_type: bool = True) -> KeyCheck:
    def decide(get):
        overlap = get.let(f"coalesce(try_divide({get('common')}, {get('src_distinct')}) * 100, 0D)")
        src_nulls, tgt_nulls = get("src_nulls"), get("tgt_nulls")
        status = case((f"{overlap} >= {quote(float(threshold))}", PASS), (f"{overlap} > 0", WARN), otherwise=FAIL)
        message = (
            f"concat({text('%.2f %% of the source keys are in the target', overlap)},"
            f" CASE WHEN {src_nulls} > 0 OR {tgt_nulls} > 0 THEN"
            f" {text('; null keys: source %d, target %d', src_nulls, tgt_nulls)} ELSE '' END,"
            f" {quote('' if same_type else '; the key types of the two sides differ')})"
        )
        metrics = {
            "overlap_pct": overlap, "common_keys": get("common"), "src_keys": get("src_distinct"),
            "tgt_keys": get("tgt_distinct"), "src_null_keys": src_nulls, "tgt_null_keys": tgt_nulls,
        }
        return [Finding("identity", "identity", column, status, message, metrics)]

    return KeyCheck(column, column, decide)


def plan_uniqueness(column: str) -> KeyCheck:
    def decide(get):
        src_count = f"({get('src_rows')} - {get('src_nulls')})"
        tgt_count = f"({get('tgt_rows')} - {get('tgt_nulls')})"
        src_ratio = get.let(f"try_divide({get('src_distinct')}, {src_count})")
        tgt_ratio = get.let(f"coalesce(try_divide({get('tgt_distinct')}, {tgt_count}), 0D)")
        status = case((f"{src_count} = 0", WARN), (f"{tgt_ratio} < {src_ratio} - 0.001D", FAIL), otherwise=PASS)
        message = (
            f"CASE WHEN {src_count} = 0 THEN 'the source holds no value' ELSE"
            f" {text('distinct values per value: source %.5f, target %.5f', src_ratio, tgt_ratio)} END"
        )
        metrics = {
            "src_unique_ratio": src_ratio, "tgt_unique_ratio": tgt_ratio,
            "src_unique_count": get("src_distinct"), "tgt_unique_count": get("tgt_distinct"),
        }
        return [Finding("data_constraints", "uniqueness", column, status, message, metrics)]

    return KeyCheck(column, column, decide)


def plan_foreign_key(fk_column: str, pk_column: str) -> KeyCheck:
    """Source of the pair is the child, target the parent."""

    def decide(get):
        rows, orphans, keys, nulls = (get(n) for n in ("src_rows", "src_unmatched_rows", "src_unmatched_keys", "src_nulls"))
        status = case((f"{rows} = 0", WARN), (f"{orphans} = 0 AND {nulls} = 0", PASS), otherwise=FAIL)
        message = (
            f"CASE WHEN {rows} = 0 THEN 'the child table is empty' ELSE"
            f" {text('%d rows without a parent (%d keys), %d null keys', orphans, keys, nulls)} END"
        )
        metrics = {"orphaned_count": orphans, "orphaned_keys": keys, "null_count": nulls, "child_rows": rows}
        return [Finding("relationships", "foreign_key", fk_column, status, message, metrics)]

    return KeyCheck(fk_column, pk_column, decide)


def pair_columns(source: DataFrame, target: DataFrame, source_column: str, target_column: str) -> tuple[DataFrame, bool]:
    read, same_type = key_reader(source.schema[source_column].dataType, target.schema[target_column].dataType)
    return paired(key_rows(source, source_column, read), key_rows(target, target_column, read)), same_type


def check_identity(source: DataFrame, target: DataFrame, key: str, table: str, threshold: float = 95.0) -> DataFrame:
    """Share of distinct source keys that the target holds. No row if a side lacks the column."""
    if key not in source.columns or key not in target.columns:
        return R.empty(source.sparkSession)
    pairs, same_type = pair_columns(source, target, key, key)
    return key_check_rows(pairs, [plan_identity(key, threshold, same_type)], table)


def check_uniqueness(source: DataFrame, target: DataFrame, column: str, table: str) -> DataFrame:
    """FAIL where values of the target repeat more than those of the source."""
    if column not in source.columns or column not in target.columns:
        message = f"column '{column}' is missing from source or target"
        return R.fixed(
            source.sparkSession, [fixed_finding("data_constraints", "uniqueness", column, FAIL, message)], table
        )
    pairs, _ = pair_columns(source, target, column, column)
    return key_check_rows(pairs, [plan_uniqueness(column)], table)


def check_links(child: DataFrame, parent: DataFrame, fk_column: str, pk_column: str, table: str) -> DataFrame:
    """Every foreign key of the child needs a parent key; NULL keys are counted apart."""
    for df, name, where in ((child, fk_column, "child"), (parent, pk_column, "parent")):
        if name not in df.columns:
            message = f"column '{name}' is missing from the {where} table"
            return R.fixed(
                child.sparkSession, [fixed_finding("relationships", "foreign_key", fk_column, FAIL, message)], table
            )
    pairs, _ = pair_columns(child, parent, fk_column, pk_column)
    return key_check_rows(pairs, [plan_foreign_key(fk_column, pk_column)], table)


def orphan_keys(child: DataFrame, parent: DataFrame, fk_column: str, pk_column: str) -> DataFrame:
    """Foreign keys without a parent and their rows: ``(key, rows)``."""
    pairs, _ = pair_columns(child, parent, fk_column, pk_column)
    return pairs.where("k IS NOT NULL AND src_n > 0 AND tgt_n = 0").selectExpr("k AS key", "src_n AS rows")


def missing_keys(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Keys found on one side only: ``(key, side, rows)``."""
    pairs, _ = pair_columns(source, target, key, key)
    return pairs.where("k IS NOT NULL AND (src_n = 0 OR tgt_n = 0)").selectExpr(
        "k AS key", "CASE WHEN tgt_n = 0 THEN 'source' ELSE 'target' END AS side", "src_n + tgt_n AS rows"
    )
