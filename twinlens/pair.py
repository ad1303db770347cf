"""The unit of analysis: an original table and an augmented one."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinlens.functions.numbers import sql_name

ROW_ID = "row_id"


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def double_or_null(df: DataFrame, name: str) -> Column:
    """The column as double with NaN turned into null."""
    q = sql_name(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.expr(f"nanvl(cast({q} AS double), NULL) AS {q}")
    return F.expr(f"cast({q} AS double) AS {q}")


@dataclass
class Pair:
    """Original and augmented table with their common numeric columns.

    ``key`` names a column that identifies a row on both sides; it is not a metric
    column. Without one, a row number over the hashed row content is used.
    """

    orig: DataFrame
    aug: DataFrame
    key: str | None = None
    cols: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        if not self.cols:
            other = set(numeric_columns(self.aug))
            self.cols = [c for c in numeric_columns(self.orig) if c in other and c != self.key]

    def _side(self, df: DataFrame, keyed: bool) -> DataFrame:
        values = [double_or_null(df, c) for c in self.cols]
        if not keyed:
            return df.select(*values).dropna(subset=self.cols)
        if self.key is not None:
            return df.select(F.col(self.key).alias(ROW_ID), *values).dropna(subset=self.cols)
        from twinlens.operators.ranking import row_number_global

        return row_number_global(df.select(*values).dropna(subset=self.cols), None, ROW_ID)

    @cached_property
    def o(self) -> DataFrame:
        """Original rows: metric columns as double, incomplete rows dropped."""
        return self._side(self.orig, keyed=False)

    @cached_property
    def a(self) -> DataFrame:
        return self._side(self.aug, keyed=False)

    @cached_property
    def o_keyed(self) -> DataFrame:
        return self._side(self.orig, keyed=True)

    @cached_property
    def a_keyed(self) -> DataFrame:
        return self._side(self.aug, keyed=True)

    @cached_property
    def o_stats(self) -> dict[str, dict[str, float]]:
        """Per column: n, mean, std_pop, std_samp, lo, hi (one aggregate pass)."""
        from twinlens.operators.summaries import collect_stats

        return collect_stats(self.o, self.cols)

    @cached_property
    def a_stats(self) -> dict[str, dict[str, float]]:
        from twinlens.operators.summaries import collect_stats

        return collect_stats(self.a, self.cols)

    @cached_property
    def scale(self) -> list[float]:
        """Original population deviation per column, 1 for a constant column."""
        return [self.o_stats[c]["std_pop"] or 1.0 for c in self.cols]

    def counts(self) -> tuple[int, int]:
        first = self.cols[0]
        return int(self.o_stats[first]["n"]), int(self.a_stats[first]["n"])

    def tagged(self) -> DataFrame:
        """Both sides in one frame, ``side`` 0 for original and 1 for augmented."""
        return (self.o.withColumn("side", F.lit(0))
                .unionByName(self.a.withColumn("side", F.lit(1))))
