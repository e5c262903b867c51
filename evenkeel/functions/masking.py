"""Column masking and redaction of secrets in text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.functions.values import ident, quote, to_text

# Fixed value: a secret is a key word, ``:`` or ``=``, and a value that may be quoted.
SECRET_PATTERN = r"""(?i)(password|secret|token|key|pwd)\s*[:=]\s*['"]?([^'"\s]+)['"]?"""


def redact(c: str) -> str:
    """Replace the value after a secret key word with ``[REDACTED]``."""
    return f"regexp_replace({c}, {quote(SECRET_PATTERN)}, '$1: [REDACTED]')"


def redact_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({name: F.expr(redact(ident(name))) for name in columns})


def mask_columns(
    df: DataFrame, hash_columns: Sequence[str] = (), drop_columns: Sequence[str] = (), salt: str = ""
) -> DataFrame:
    """SHA-256 the ``hash_columns`` (NULL stays NULL) and drop the ``drop_columns``."""
    hashed = {
        name: F.expr(f"sha2(concat({quote(salt)}, {to_text(ident(name), df.schema[name].dataType)}), 256)")
        for name in hash_columns
    }
    return df.withColumns(hashed).drop(*drop_columns)
