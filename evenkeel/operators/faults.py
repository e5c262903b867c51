"""Deterministic faults put into a table.

Which rows are hit follows from the key alone (``pmod(key, every) = 0``), so a fault does not depend on
partitioning and can be reproduced in any SQL engine.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.functions.values import ident, quote


def _hit(key: str, every: int) -> str:
    return f"pmod({ident(key)}, {int(every)}) = 0"


def _change(df: DataFrame, column: str, key: str, every: int, expression: str) -> DataFrame:
    c = ident(column)
    return df.withColumn(column, F.expr(f"CASE WHEN {_hit(key, every)} THEN {expression} ELSE {c} END"))


def lose_rows(df: DataFrame, key: str, every: int) -> DataFrame:
    return df.where(f"NOT ({_hit(key, every)})")


def set_value(df: DataFrame, column: str, key: str, every: int, value) -> DataFrame:
    """A literal in the hit rows; a text in a numeric column turns the column to text."""
    dtype = df.schema[column].dataType.simpleString()
    if isinstance(value, str) and dtype != "string":
        df = df.withColumn(column, F.col(ident(column)).cast("string"))
        dtype = "string"
    return _change(df, column, key, every, f"CAST({quote(value)} AS {dtype})")


def null_value(df: DataFrame, column: str, key: str, every: int) -> DataFrame:
    return _change(df, column, key, every, "NULL")


def zero_value(df: DataFrame, column: str, key: str, every: int) -> DataFrame:
    return set_value(df, column, key, every, 0)


def negate(df: DataFrame, column: str, key: str, every: int) -> DataFrame:
    return _change(df, column, key, every, f"-{ident(column)}")


def garbage(df: DataFrame, column: str, key: str, every: int, text: str = "INVALID") -> DataFrame:
    return set_value(df, column, key, every, text)


def add_to(df: DataFrame, column: str, key: str, every: int, amount) -> DataFrame:
    """Raise a number: a boosted quantity, or a foreign key that then has no parent."""
    return _change(df, column, key, every, f"{ident(column)} + {amount}")


def round_value(df: DataFrame, column: str, key: str, every: int, digits: int = 1) -> DataFrame:
    return _change(df, column, key, every, f"round({ident(column)}, {digits})")


def truncate(df: DataFrame, column: str, key: str, every: int, length: int = 5, tail: str = "...") -> DataFrame:
    return _change(df, column, key, every, f"concat(left({ident(column)}, {length}), {quote(tail)})")


def pad(df: DataFrame, column: str, key: str, every: int, blank: str = "  ") -> DataFrame:
    return _change(df, column, key, every, f"concat({quote(blank)}, {ident(column)}, {quote(blank)})")


def damage_encoding(df: DataFrame, column: str, key: str, every: int) -> DataFrame:
    return _change(df, column, key, every, f"concat({ident(column)}, 'Ã©')")


def append_text(df: DataFrame, column: str, key: str, every: int, text: str) -> DataFrame:
    """Characters that a later step may not survive, as the caller chooses them."""
    return _change(df, column, key, every, f"concat({ident(column)}, {quote(text)})")


def shift_time(df: DataFrame, column: str, key: str, every: int, minutes: int) -> DataFrame:
    return _change(df, column, key, every, f"{ident(column)} + make_dt_interval(0, 0, {int(minutes)})")


def duplicate_rows(df: DataFrame, key: str, every: int) -> DataFrame:
    return df.unionByName(df.where(_hit(key, every)))


def drop_column(df: DataFrame, column: str) -> DataFrame:
    return df.drop(column)


FAULTS = {
    "delete_row": lose_rows, "modify_value": set_value, "nullify_value": null_value, "zero": zero_value,
    "negative": negate, "garbage": garbage, "boost": add_to, "orphan": add_to, "precision_loss": round_value,
    "truncate_string": truncate, "whitespace": pad, "encoding": damage_encoding,
    "special_chars": append_text, "shift_time": shift_time, "duplicate_ids": duplicate_rows,
}


def inject(df: DataFrame, key: str, faults: Sequence[Mapping]) -> DataFrame:
    """Apply faults in order: ``{"type": ..., "every": n, "column": ..., ...}``."""
    for fault in faults:
        args = {k: v for k, v in fault.items() if k != "type"}
        if fault["type"] == "drop_column":
            df = drop_column(df, args["column"])
        else:
            df = FAULTS[fault["type"]](df, key=key, **args)
    return df
