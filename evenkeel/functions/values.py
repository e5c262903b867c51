"""Scalar expressions shared by every check.

Expressions are Spark SQL text made of built-ins only, so they stay inside whole-stage codegen, and
a plan with hundreds of them is parsed in one step. Each function takes the text of an expression
and, where the rule depends on it, the Spark type.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import types as T

# Characters that count as white space when a text is stripped.
WHITESPACE = "".join(
    chr(point)
    for point in (
        *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
        *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    )
)

# Tokens a delimited-text scan reads as NULL by default.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Boolean tokens used when a configuration names none.
TRUE_TOKENS = ("Y", "1", "True", "true", "T", "t", "yes", "Yes")
FALSE_TOKENS = ("N", "0", "False", "false", "F", "f", "no", "No")

# Offsets in minutes that mark a time-zone shift.
ZONE_OFFSETS_MINUTES = (
    30, 60, 90, 120, 150, 180, 210, 240, 270, 300, 330, 345, 360, 390, 420, 450, 480, 510, 525,
    540, 570, 600, 630, 660, 720, 780, 840,
)

_NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI]nf(inity)?)\s*$"
_INTEGER = r"^\s*[+-]?\d+\s*$"
_ISO_STAMP = (
    r"^\s*\d{4}-\d{1,2}-\d{1,2}"
    r"([T ]\d{1,2}:\d{2}(:\d{2}(\.\d{1,9})?)?\s*(Z|UTC|[+-]\d{2}(:?\d{2})?)?)?\s*$"
)
_OFFSET = r"\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?\s*(Z|UTC|[+-]\d{2}:?(?:\d{2})?)\s*$"

# (shape the text must have, Spark datetime pattern); tried in this order after ISO 8601.
STAMP_FORMATS: tuple[tuple[str, str], ...] = (
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$", "M/d/yyyy H:mm"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$", "M/d/yyyy H:mm:ss"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{2}:\d{2}$", "yyyy/M/d H:mm:ss"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy"),
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^\d{1,2} [A-Za-z]{4,9} \d{4}$", "d MMMM yyyy"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^[A-Za-z]{4,9} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
)


def is_number_type(dtype: T.DataType) -> bool:
    """Numeric or boolean, the types whose sums and averages are compared."""
    return isinstance(dtype, (T.NumericType, T.BooleanType))


def is_integer_type(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.IntegralType, T.BooleanType))


def type_family(dtype: T.DataType) -> str:
    """Values of different families never compare as equal."""
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, T.NumericType):
        return "number"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    return "text"


def looks_like_key(name: str) -> bool:
    """``id``, ``*_id`` and camel-case ``*Id``/``*ID``; words such as ``paid`` are not keys."""
    return name.lower() == "id" or name.lower().endswith("_id") or bool(re.search(r"[a-z0-9]I[dD]$", name))


def quote(value) -> str:
    """A Python value as SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return f"double('{value!r}')"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


_WS = quote(WHITESPACE)


def fold_nan(c: str, dtype: T.DataType) -> str:
    """NaN counts as missing."""
    return f"nanvl({c}, NULL)" if isinstance(dtype, (T.DoubleType, T.FloatType)) else c


def to_number(c: str, dtype: T.DataType) -> str:
    """DOUBLE, or NULL where the value is not a number."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return f"nanvl(CAST({c} AS DOUBLE), NULL)"
    if isinstance(dtype, T.BooleanType):
        return f"CAST(CAST({c} AS INT) AS DOUBLE)"
    if isinstance(dtype, T.NumericType):
        return f"CAST({c} AS DOUBLE)"
    if isinstance(dtype, T.StringType):
        return f"CASE WHEN {c} RLIKE {quote(_NUMBER)} THEN try_cast(btrim({c}, {_WS}) AS DOUBLE) END"
    return "CAST(NULL AS DOUBLE)"


def to_integer(c: str) -> str:
    """BIGINT for texts that are whole numbers, else NULL."""
    return f"CASE WHEN {c} RLIKE {quote(_INTEGER)} THEN try_cast(btrim({c}, {_WS}) AS BIGINT) END"


def plain_number(c: str, dtype: T.DataType) -> str:
    """A number as plain digits: no exponent, no trailing zeros, no ``.0``."""
    if isinstance(dtype, T.BooleanType):
        return f"CAST(CAST({c} AS INT) AS STRING)"
    if isinstance(dtype, T.IntegralType):
        return f"CAST({c} AS STRING)"
    zeros = quote(r"\.?0+$")
    if isinstance(dtype, T.DecimalType):
        text = f"CAST({c} AS STRING)"
        return f"CASE WHEN contains({text}, '.') THEN regexp_replace({text}, {zeros}, '') ELSE {text} END"
    x = to_number(c, dtype)
    text = f"CAST({x} AS STRING)"
    # the shortest print has one digit before the point; its exponent moves the point, whatever the size
    power = f"CAST(substring_index({text}, 'E', -1) AS INT)"
    digits = f"rtrim('0', translate(substring_index({text}, 'E', 1), '.-', ''))"
    sign = f"IF({x} < 0, '-', '')"
    small = f"concat({sign}, '0.', repeat('0', -{power} - 1), {digits})"
    whole = f"rpad({digits}, {power} + 1, '0')"
    large = (
        f"IF(length({digits}) <= {power} + 1, concat({sign}, {whole}),"
        f" concat({sign}, left({digits}, {power} + 1), '.', substring({digits}, {power} + 2)))"
    )
    return (
        f"CASE WHEN contains({text}, 'E') THEN IF({power} < 0, {small}, {large})"
        f" WHEN endswith({text}, '.0') THEN left({text}, length({text}) - 2) ELSE {text} END"
    )


def exact_number(c: str, dtype: T.DataType) -> str:
    """A number as text that is equal exactly if the values are, also between integers, decimals and doubles."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        whole = f"{c} = floor({c}) AND abs({c}) < 9.2e18D"  # a whole double of this size is a BIGINT, digit by digit
        return f"CASE WHEN {whole} THEN CAST(CAST({c} AS BIGINT) AS STRING) ELSE {plain_number(c, dtype)} END"
    return plain_number(c, dtype)


def to_text(c: str, dtype: T.DataType) -> str:
    """The value as text; numbers through :func:`plain_number`, so 1 and 1.0 read the same."""
    if isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, T.BooleanType):
        return f"CASE WHEN {c} THEN 'True' WHEN NOT {c} THEN 'False' END"
    if isinstance(dtype, T.NumericType):
        return plain_number(c, dtype)
    return f"CAST({c} AS STRING)"


def strip(c: str) -> str:
    return f"btrim({c}, {_WS})"


def is_unstripped(text: str) -> str:
    """First or last character is white space. Only two characters are looked at."""
    points = ", ".join(str(ord(ch)) for ch in WHITESPACE)
    return f"(ascii({text}) IN ({points}) OR ascii(right({text}, 1)) IN ({points}))"


def is_mojibake(text: str) -> str:
    """Replacement character, or UTF-8 bytes read as Latin-1. The regex runs only after a byte search hits."""
    return (
        f"(contains({text}, '\ufffd') OR (contains({text}, '\u00c3')"
        f" AND {text} RLIKE '\u00c3[\u0080-\u00ff]'))"
    )


def percent_gap(source: str, target: str) -> str:
    """``|source - target| / |source| * 100``; NULL where the source is 0 or missing."""
    return f"(try_divide(abs({source} - {target}), abs({source})) * 100)"


def to_timestamp(c: str, dtype: T.DataType, formats: Sequence[tuple[str, str]] | None = None) -> str:
    """TIMESTAMP or NULL. Every format is tried for every value, so row order never matters.

    Text without an offset is read in the session zone (UTC, see :func:`evenkeel.session.session`).
    Numbers are no timestamps: without a declared unit they cannot be read as one.
    """
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return f"CAST({c} AS TIMESTAMP)"
    if not isinstance(dtype, T.StringType):
        return "CAST(NULL AS TIMESTAMP)"
    # the cast ignores outer blanks and reads offsets such as +05:30; +0530 needs its colon first
    colon = quote(r"([+-]\d{2})(\d{2})\s*$")
    iso = f"coalesce(try_cast({c} AS TIMESTAMP), try_cast(regexp_replace({c}, {colon}, '$1:$2') AS TIMESTAMP))"
    known = STAMP_FORMATS if formats is None else formats
    branches = f"WHEN {c} RLIKE {quote(_ISO_STAMP)} THEN {iso}"
    if known:
        # one test for all other shapes, so that a value of no shape costs two tests
        any_shape = r"^\s*(" + "|".join(shape.strip("^$") for shape, _ in known) + r")\s*$"
        text = strip(c)
        tries = ", ".join(
            f"CASE WHEN {text} RLIKE {quote(shape)} THEN try_to_timestamp({text}, {quote(fmt)}) END"
            for shape, fmt in known
        )
        branches += f" WHEN {c} RLIKE {quote(any_shape)} THEN coalesce({tries})"
    return f"CASE {branches} END"


def offset_minutes(c: str) -> str:
    """Minutes from UTC that a text names after its time, NULL where it names none."""
    raw = f"regexp_extract({c}, {quote(_OFFSET)}, 1)"
    hours, minutes = f"CAST(substring({raw}, 2, 2) AS INT)", f"rpad(replace(substring({raw}, 4), ':', ''), 2, '0')"
    return (
        f"CASE WHEN {raw} = '' THEN NULL WHEN {raw} IN ('Z', 'UTC') THEN 0"
        f" ELSE IF(left({raw}, 1) = '-', -1, 1) * ({hours} * 60 + CAST({minutes} AS INT)) END"
    )


def zone_name(minutes: str) -> str:
    """``UTC`` or ``UTC+05:30`` for minutes from UTC."""
    sign = f"IF({minutes} < 0, '-', '+')"
    return (
        f"CASE WHEN {minutes} = 0 THEN 'UTC' ELSE"
        f" format_string('UTC%s%02d:%02d', {sign}, abs({minutes}) DIV 60, abs({minutes}) % 60) END"
    )


def typed_literals(values: Iterable, dtype: T.DataType) -> list:
    """Of the given Python values, those a column of this type can equal (no implicit casts)."""
    keep = []
    for v in values:
        if isinstance(dtype, T.StringType) and isinstance(v, str):
            keep.append(v)
        elif isinstance(dtype, T.BooleanType) and isinstance(v, bool):
            keep.append(v)
        elif isinstance(dtype, T.NumericType) and isinstance(v, (int, float)) and not isinstance(v, bool):
            keep.append(v)
    return keep


def is_any(c: str, values: Sequence) -> str:
    """Membership that is false, not NULL, for a NULL value."""
    return f"coalesce({c} IN ({', '.join(map(quote, values))}), false)" if values else "false"


def to_boolean(c: str, dtype: T.DataType, true_values: Sequence[str], false_values: Sequence[str]) -> str:
    """Trimmed token to boolean; an unknown token gives NULL."""
    token = strip(to_text(c, dtype))
    return f"CASE WHEN {is_any(token, true_values)} THEN true WHEN {is_any(token, false_values)} THEN false END"
