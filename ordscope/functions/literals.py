"""Literal arrays and maps as one parsed expression each.

Building them from single literals costs one JVM call per entry at planning time.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def sql_literal(value) -> str:
    """Spark SQL text of a Python scalar."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(value)


def array_of(values: Iterable) -> Column:
    return F.expr("array(" + ", ".join(sql_literal(v) for v in values) + ")")


def map_of(mapping: Mapping) -> Column:
    return F.expr("map(" + ", ".join(f"{sql_literal(k)}, {sql_literal(v)}" for k, v in mapping.items()) + ")")


def structs_of(rows: Iterable[tuple], names: Iterable[str]) -> Column:
    """Array of structs with the given field names."""
    names = list(names)
    items = (
        "named_struct(" + ", ".join(f"'{n}', {sql_literal(v)}" for n, v in zip(names, row)) + ")" for row in rows
    )
    return F.expr("array(" + ", ".join(items) + ")")
