"""Reassembly of split or merged tables before the checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions.values import ident
from evenkeel.operators.lookup import attach, skewed_left_join
from evenkeel.staging import stage


def concat(tables: Sequence[DataFrame]) -> DataFrame:
    """All rows of all tables; a column that a table lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), _align(tables))


def _align(tables: Sequence[DataFrame]) -> list[DataFrame]:
    """A column that is text in one table and something else in another is text in all."""
    kinds: dict[str, set[str]] = {}
    for t in tables:
        for f in t.schema:
            kinds.setdefault(f.name, set()).add("text" if isinstance(f.dataType, T.StringType) else "other")
    mixed = [n for n, k in kinds.items() if len(k) == 2]
    return [t.withColumns({n: F.col(ident(n)).cast("string") for n in mixed if n in t.columns}) for t in tables]


def _ordinal(tables: Sequence[DataFrame]) -> DataFrame:
    """All rows with ``_ordinal``, the position of their table."""
    return concat([t.withColumn("_ordinal", F.lit(i)) for i, t in enumerate(tables)])


def _without_key(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows without a key match nothing and stay as they are."""
    return rows.where(f"{ident(key)} IS NULL").select([ident(c) for c in columns])


def sum_by_key(tables: Sequence[DataFrame], key: str) -> DataFrame:
    """One row per key with the columns of the first table: numbers added over all tables, other
    columns from the first table that has the key. One aggregate, no join."""
    first = tables[0]
    numbers = [f.name for f in first.schema if f.name != key and isinstance(f.dataType, T.NumericType)]
    others = [f.name for f in first.schema if f.name != key and f.name not in numbers]
    rows = _ordinal([t.select([c for c in t.columns if c in first.columns]) for t in tables])
    aggs = [F.expr(f"coalesce(sum({ident(n)}), 0)").alias(n) for n in numbers]
    if others:
        aggs.append(F.min(F.struct("_ordinal", *map(ident, others))).alias("_rest"))
    out = rows.where(f"{ident(key)} IS NOT NULL").groupBy(key).agg(*aggs)
    merged = out.selectExpr(*[f"_rest.{ident(c)} AS {ident(c)}" if c in others else ident(c) for c in first.columns])
    return merged.unionByName(_without_key(rows, key, first.columns))


def count_by_key(tables: Sequence[DataFrame], key: str) -> DataFrame:
    """Rows per key over all tables; without the key column the rows themselves."""
    rows = concat(tables)
    if key not in rows.columns:
        return rows
    return rows.where(f"{ident(key)} IS NOT NULL").groupBy(key).count()


def pick_by_key(tables: Sequence[DataFrame], key: str, last: bool = False) -> DataFrame:
    """One row per key, from the first (or last) table that has it.

    An aggregate keeps the smallest row instead of ranking all rows of a key in a window, so rows of a
    repeated key are reduced before the shuffle. Rows of one table with one key are ordered by value.
    """
    rows = _ordinal(tables)
    rest = [c for c in rows.columns if c not in (key, "_ordinal")]
    pick = (F.max if last else F.min)(F.struct("_ordinal", *map(ident, rest)))
    out = rows.where(f"{ident(key)} IS NOT NULL").groupBy(key).agg(pick.alias("_row"))
    columns = [c for c in rows.columns if c != "_ordinal"]
    picked = out.select([F.col(ident(key)) if c == key else F.col(f"_row.{ident(c)}").alias(c) for c in columns])
    return picked.unionByName(_without_key(rows, key, columns))


def join_parts(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full join of vertical parts on their key; a column the left side already has is dropped.

    Where all parts share the key, rows of all parts are stacked and brought together in one shuffle, however many parts
    there are: per key one aggregate counts the rows of each part and keeps one of them, so a key takes up one row of
    each part at most. Keys that no part repeats are put together by that. Rows of repeated keys, which make every
    combination, are joined part by part, as are parts with different keys.
    """
    if len(set(keys)) > 1 or len(tables) < 2:
        return _join_in_turn(tables, keys)
    key, known, fresh = keys[0], set(tables[0].columns), [list(tables[0].columns)]
    for t in tables[1:]:
        fresh.append([c for c in t.columns if c not in known])
        known.update(fresh[-1])
    fresh[0].remove(key)
    columns = [*tables[0].columns, *(c for some in fresh[1:] for c in some)]
    parts = [t.select(ident(key), *map(ident, some)) for t, some in zip(tables, fresh)]
    no_key = f"{ident(key)} IS NULL"
    rows = [t.where(f"NOT {no_key}").select(ident(key), F.lit(i).alias("_part"), _struct(some).alias(f"_p{i}")) for i, (t, some) in enumerate(zip(parts, fresh))]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    counts = [F.count_if(F.col("_part") == i).alias(f"_n{i}") for i in range(len(parts))]
    kept = [F.first(f"_p{i}", ignorenulls=True).alias(f"_p{i}") for i in range(len(parts))]
    together = stage(stacked.groupBy(key).agg(*counts, *kept), "parts")
    most = "greatest(" + ", ".join(f"_n{i}" for i in range(len(parts))) + ")"
    placed = {c: F.col(f"_p{i}").getField(c).alias(c) for i, some in enumerate(fresh) for c in some}
    out = together.where(f"{most} = 1").select(*[placed.get(c, F.col(ident(c))) for c in columns])
    repeated = together.where(f"{most} > 1").select(ident(key))
    if not repeated.isEmpty():
        several = [_rows_of(t, repeated, key) for t in parts]
        out = out.unionByName(_join_in_turn(several, keys).select([ident(c) for c in columns]))
    apart = [t.where(no_key) for t in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), apart, out)


def _struct(columns: Sequence[str]):
    """A struct that is never NULL, also without columns."""
    return F.struct(F.lit(True).alias("_there"), *map(ident, columns))


def _rows_of(table: DataFrame, keys_of: DataFrame, key: str) -> DataFrame:
    """The rows whose key is listed, each once in the list."""
    return table.join(keys_of, key, "left_semi")


def _join_in_turn(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """The same by a left join for each further part, plus its rows without a partner: unlike in a full join, rows of a
    skewed key can then be dealt out to many tasks. Rows without a key have no partner and stay out of the joins."""
    out = tables[0]
    for table, key in zip(tables[1:], keys[1:]):
        fresh = [c for c in table.columns if c not in out.columns]
        part, no_key = table.select(key, *map(ident, fresh)), f"{ident(key)} IS NULL"
        keyed, keyed_part = out.where(f"NOT {no_key}"), part.where(f"NOT {no_key}")
        joined = skewed_left_join(keyed, keyed_part, key).select([ident(c) for c in [*out.columns, *fresh]])
        unmatched = keyed_part.join(keyed.select(key).distinct(), key, "left_anti")
        rest = [out.where(no_key), unmatched, part.where(no_key)]
        out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rest, joined)
    return out


def merge_sources(
    tables: Sequence[DataFrame], mapping_type: str, strategy: str | None, key: str | None
) -> DataFrame:
    """Several sources as one table."""
    if not tables:
        raise ValueError("a mapping needs at least one source")
    if len(tables) == 1:
        return tables[0]
    if mapping_type in ("N:1", "N:M") and strategy in ("sum", "count", "first", "last"):
        if not key:
            raise ValueError(f"strategy '{strategy}' needs a primary key")
        if strategy == "sum":
            return sum_by_key(tables, key)
        if strategy == "count":
            return count_by_key(tables, key)
        return pick_by_key(tables, key, last=strategy == "last")
    return concat(tables)


def merge_targets(
    tables: Sequence[DataFrame], mapping_type: str, strategy: str | None, keys: Sequence[str]
) -> DataFrame:
    """Several targets as one table. ``join`` puts vertical parts together, all others stack shards."""
    if not tables:
        raise ValueError("a mapping needs at least one target")
    if len(tables) > 1 and mapping_type == "1:N" and strategy == "join":
        return join_parts(tables, keys)
    return concat(tables)


def split_horizontally(df: DataFrame, key: str, parts: int) -> list[DataFrame]:
    """``parts`` tables by the remainder of an integer key."""
    return [df.where(f"pmod({ident(key)}, {parts}) = {i}") for i in range(parts)]


def orphan_rows(child: DataFrame, parent: DataFrame, fk_column: str, pk_column: str) -> DataFrame:
    """Child rows whose key is in no parent row; NULL keys are no orphans.

    Orphan keys come from the counted key table, so a hot foreign key never meets the parent in a join.
    """
    from evenkeel.operators.keys import pair_columns

    pairs, same_type = pair_columns(child, parent, fk_column, pk_column)
    if not same_type:
        return child.where(f"{ident(fk_column)} IS NOT NULL")
    lost = stage(
        pairs.where("k IS NOT NULL AND src_n > 0 AND tgt_n = 0").selectExpr(f"k AS {ident(fk_column)}", "src_n AS _rows"),
        "orphans",
    )
    return attach(child, lost, fk_column, "_rows").where("_rows IS NOT NULL").drop("_rows")
