"""Histogram and quantile bins as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def equal_width_bin(value: Column, low: Column, high: Column, bins: int = 50) -> Column:
    """Zero-based bin of ``value`` among equal-width bins over [low, high].

    Null outside the range; the last bin is closed. The floor index is corrected
    against the edges themselves, so values lying on an edge never flip.
    """
    step = (high - low) / F.lit(float(bins))
    guess = F.least(F.floor((value - low) / F.nullif(step, F.lit(0.0))), F.lit(bins - 1)).cast("int")
    left = guess.cast("double") * step + low
    right = (guess + 1).cast("double") * step + low
    fixed = (F.when(value < left, guess - 1)
             .when((value >= right) & (guess < bins - 1), guess + 1)
             .otherwise(guess))
    return F.when((value >= low) & (value <= high) & (high > low), fixed)


def right_closed_bin(value: Column, edges: list[float]) -> Column:
    """Number of the right-closed bin (lowest edge included), -1 when out of range."""
    if len(edges) < 2:
        return F.lit(-1)
    out = F.when(value.isNull() | (value < F.lit(edges[0])), F.lit(-1))
    for i, edge in enumerate(edges[1:]):
        out = out.when(value <= F.lit(edge), F.lit(i))
    return out.otherwise(F.lit(-1))
