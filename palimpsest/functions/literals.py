"""Literal arrays and maps as one parsed expression each, instead of one call per element."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(value: str | int | bool | None) -> str:
    """A value as a SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strings(values: Iterable[str]) -> Column:
    """An array of strings."""
    return F.expr(f"cast(array({', '.join(map(quoted, values))}) as array<string>)")


def mapping(pairs: Mapping[str, str | int | bool | None]) -> Column:
    """A map from strings."""
    return F.expr("map(" + ", ".join(quoted(x) for pair in pairs.items() for x in pair) + ")")
