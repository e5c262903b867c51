"""A first audit configuration from a schema."""

from __future__ import annotations

from pyspark.sql import types as T

from evenkeel.functions.values import looks_like_key


def suggest_config(
    schema: T.StructType, source: str, target: str, primary_key: str | None = None
) -> dict:
    """Table configuration as a mapping that :class:`~evenkeel.config.TableConfig` accepts.

    Numeric columns that look like no key become aggregates, columns that are not nullable get
    ``not_null``, and dates and timestamps get ``date``. The key is the given one, else ``id``, else
    the first column that looks like a key, else the first column.
    """
    names = schema.names
    if primary_key is None:
        primary_key = next(
            (n for n in names if n.lower() == "id"), next((n for n in names if looks_like_key(n)), names[0])
        )
    aggregates, constraints, stamps = [], {}, []
    for f in schema:
        rules = [] if f.nullable else ["not_null"]
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            rules.append("date")
            stamps.append({"column": f.name})
        if isinstance(f.dataType, T.NumericType) and f.name != primary_key and not looks_like_key(f.name):
            aggregates.append(f.name)
        if rules:
            constraints[f.name] = rules
    return {
        "source": source, "target": target, "primary_key": primary_key, "aggregates": aggregates,
        "data_constraints": constraints, "datetime_columns": stamps, "mappings": [], "relationships": [],
    }
