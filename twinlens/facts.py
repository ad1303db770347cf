"""The result shape: one row per number or word.

(dimension, metric, feature, field, value, label); comparisons add ``variant``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlens.functions.numbers import sql_text

FACT_COLUMNS = ("dimension", "metric", "feature", "field", "value", "label")


def number(field: str, value: Column, digits: int = 6) -> tuple[str, Column, bool, int]:
    return field, value, False, digits


def word(field: str, label: Column) -> tuple[str, Column, bool, int]:
    return field, label, True, 0


def _struct(dimension: str, metric: str, feature: str, entry, column: str) -> str:
    """SQL text of one fact; ``feature`` and ``column`` are names or NULL."""
    field, _, is_word, digits = entry
    value = "cast(NULL AS double)" if is_word else f"round(cast({column} AS double), {digits}) + 0.0D"
    label = f"cast({column} AS string)" if is_word else "cast(NULL AS string)"
    return (f"named_struct('dimension', {sql_text(dimension)}, 'metric', {sql_text(metric)}, "
            f"'feature', cast({feature} AS string), 'field', {sql_text(field)}, 'value', {value}, 'label', {label})")


def single_facts(row: DataFrame, dimension: str, metric: str, entries: list) -> DataFrame:
    """Turn every row into one overall fact per entry."""
    named = row.select(*[e[1].alias(f"e{i}") for i, e in enumerate(entries)])
    cells = ", ".join(_struct(dimension, metric, "NULL", e, f"e{i}") for i, e in enumerate(entries))
    return named.selectExpr(f"inline(array({cells}))")


def feature_facts(df: DataFrame, dimension: str, metric: str, per: list, overall: list) -> DataFrame:
    """Per-feature facts plus overall facts from one pass over a row-per-feature table.

    ``overall`` entries are aggregates, or functions of earlier overall fields (a grade).
    """
    totals = [e for e in overall if not callable(e[1])]
    later = [e for e in overall if callable(e[1])]
    g = df.rollup("feature").agg(
        F.grouping("feature").alias("__total"),
        *[F.first(e[1]).alias(f"p_{e[0]}") for e in per],
        *[e[1].alias(f"t_{e[0]}") for e in totals])
    if later:
        g = g.withColumns({f"t_{e[0]}": e[1](lambda name: F.col(f"t_{name}")) for e in later})
    per_rows = ", ".join(_struct(dimension, metric, "feature", e, f"p_{e[0]}") for e in per)
    all_rows = ", ".join(_struct(dimension, metric, "NULL", e, f"t_{e[0]}") for e in overall)
    return g.selectExpr(f"inline(CASE WHEN __total = 0 THEN array({per_rows}) ELSE array({all_rows}) END)")


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
