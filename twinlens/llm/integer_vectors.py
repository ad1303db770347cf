"""Vectors as whole numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector_col: str) -> Column:
    """Neither null nor empty, and every component a finite number."""
    finite = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & finite


def floors(vector_col: str, scale: float) -> Column:
    """floor(scale * x) of every component; one that leaves 62 bits is an error."""
    large = F.raise_error(F.lit(f"a component leaves 62 bits at scale {scale}; lower the scale")).cast("long")
    number = lambda x: F.lit(float(scale)) * x.cast("double")
    return F.transform(F.col(vector_col), lambda x: F.when(F.abs(number(x)) < 2.0**62, F.floor(number(x))).otherwise(large))
