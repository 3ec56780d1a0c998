"""Aggregates with the dialect's rules for empty cells and empty groups."""

from __future__ import annotations

from pyspark.sql import types as T

from quillframe.errors import ArgumentError
from quillframe.functions.values import DOUBLE, LONG, STRING, Value

STATISTICS = {"VAR_POP", "VAR_SAMP", "STDDEV_POP", "STDDEV_SAMP", "MEDIAN"}


def sql(name: str, column: str | None, t: T.DataType, distinct: bool, separator: str, skips: bool) -> tuple[str, T.DataType]:
    """SQL of an aggregate over a prepared column, and its type.

    SUM and AVG of nothing are 0.  An empty cell is a candidate of MIN, unless ``skips``
    (a CASE without ELSE).  GROUP_CONCAT orders by value.
    """
    d = "DISTINCT " if distinct else ""
    if column is None:
        if name == "COUNT":
            return "count(1)", LONG
        if name in ("SUM", "AVG", "MAX", "MIN"):
            return "0", LONG
        raise ArgumentError(f"{name}(*) is not known")
    x = f"`{column}`"
    if name == "COUNT":
        return f"count({d}{x})", LONG
    if name == "SUM":
        out = LONG if t.simpleString() in ("tinyint", "smallint", "int", "bigint") else t if isinstance(t, T.DecimalType) else DOUBLE
        return f"coalesce(sum({d}{x}), 0)", out
    if name == "AVG":
        return f"coalesce(avg({d}{x}), 0)", DOUBLE
    if name == "MAX":
        return f"max({x})", t
    if name == "MIN":
        return (f"min({x})" if skips else f"CASE WHEN count({x}) < count(1) THEN NULL ELSE min({x}) END"), t
    if name == "MODE":
        return f"mode({x}, true)", t
    if name == "GROUP_CONCAT":
        quoted = separator.replace("\\", "\\\\").replace("'", "\\'")
        return f"nullif(array_join(array_sort({'collect_set' if distinct else 'collect_list'}({x})), '{quoted}'), '')", STRING
    return f"{name.lower()}({d}{x})", DOUBLE


def wants_number(name: str) -> bool:
    return name in ("SUM", "AVG") or name in STATISTICS


def checked(name: str, v: Value) -> Value:
    """Statistics refuse what is no number."""
    if name in STATISTICS and v.kind in ("date", "ts", "array", "bool"):
        raise ArgumentError(f"{name} takes numbers")
    return v
