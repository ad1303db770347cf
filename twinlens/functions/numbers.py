"""Small numeric helpers shared by metrics and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sql_name(column: str) -> str:
    """Column name quoted for SQL text."""
    return "`" + column.replace("`", "``") + "`"


def sql_text(value: str) -> str:
    """String literal for SQL text."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def tidy(value: Column, digits: int = 6) -> Column:
    """Rounded double without a negative zero."""
    return F.round(value.cast("double"), digits) + F.lit(0.0)


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def ratio(top: Column, bottom: Column) -> Column:
    """Division that gives null for a zero divisor (ANSI mode would raise)."""
    return top / F.nullif(bottom, F.lit(0.0))


def grade(value: Column, bands: list[tuple[str, str, float]], otherwise: str) -> Column:
    """First word whose comparison holds, e.g. ``[("high", "<", .1)]``."""
    tests = {"<": lambda t: value < t, "<=": lambda t: value <= t,
             ">": lambda t: value > t, ">=": lambda t: value >= t}
    out = None
    for word, op, threshold in bands:
        test = tests[op](F.lit(threshold))
        out = F.when(test, word) if out is None else out.when(test, word)
    return F.when(value.isNotNull(), out.otherwise(otherwise))
