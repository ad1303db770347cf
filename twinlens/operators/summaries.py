"""One-pass column summaries: a row per feature, or literals for later plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.functions.numbers import sql_name, sql_text

# Aggregate text per field; one parsed expression per column keeps plan building cheap.
_FIELDS = {
    "n": "cast(count({c}) AS double)",
    "mean": "avg({c})",
    "std_pop": "stddev_pop({c})",
    "std_samp": "stddev_samp({c})",
    "lo": "min({c})",
    "hi": "max({c})",
    "skew": "skewness({c})",
    "kurt": "kurtosis({c})",
}


def feature_stats(df: DataFrame, cols: list[str], fields: tuple[str, ...] = tuple(_FIELDS)) -> DataFrame:
    """(pos, feature, <fields>) with one wide partial aggregate, no row explosion."""
    row = df.agg(*[
        F.expr(f"named_struct('pos', {i}, 'feature', {sql_text(c)}, "
               + ", ".join(f"'{f}', {_FIELDS[f].format(c=sql_name(c))}" for f in fields) + f") AS s{i}")
        for i, c in enumerate(cols)
    ])
    return row.selectExpr("inline(array(" + ", ".join(f"s{i}" for i in range(len(cols))) + "))")


def collect_stats(df: DataFrame, cols: list[str]) -> dict[str, dict[str, float]]:
    """The same numbers on the driver; a handful of doubles per column."""
    fields = ("n", "mean", "std_pop", "std_samp", "lo", "hi")
    return {r["feature"]: {f: r[f] for f in fields} for r in feature_stats(df, cols, fields).collect()}


def joined_stats(pair) -> DataFrame:
    """(pos, feature, o_*, a_*), one row per common column."""
    o = feature_stats(pair.o, pair.cols)
    a = feature_stats(pair.a, pair.cols)
    left = o.selectExpr("pos", "feature", *[f"{f} AS o_{f}" for f in _FIELDS])
    right = a.selectExpr("feature", *[f"{f} AS a_{f}" for f in _FIELDS])
    return left.join(right, "feature")


def melt(df: DataFrame, cols: list[str], keep: list[str] = ()) -> DataFrame:
    """Long form (keep..., feature, value)."""
    return df.unpivot(list(keep), list(cols), "feature", "value")
