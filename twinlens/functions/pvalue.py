"""p-values of the two-sample Kolmogorov-Smirnov statistic."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TERMS = 100
EXACT_ROWS = 10_000


def kolmogorov_pvalue(d: str, n_o: str, n_a: str) -> Column:
    """Kolmogorov series 2 sum (-1)^(k-1) exp(-2 k^2 x^2), x = d sqrt(n_o n_a / (n_o + n_a))."""
    x2 = F.col(d) * F.col(d) * (F.col(n_o) * F.col(n_a) / (F.col(n_o) + F.col(n_a)))

    def term(k: Column) -> Column:
        sign = F.when(k % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
        return sign * F.exp(F.lit(-2.0) * k.cast("double") * k.cast("double") * x2)

    series = F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(TERMS)), term), F.lit(0.0), lambda s, t: s + t)
    # below x = 0.04 a hundred alternating terms have not settled; the limit is 1
    return F.when(x2 < F.lit(0.0016), F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * series)))


def exact_pvalue(d: float, n: int, m: int) -> float:
    """Share of lattice paths from (0,0) to (n,m) that reach a gap of at least ``d``.

    More than ``EXACT_ROWS`` rows on a side are refused: the count takes the product of both.
    """
    if max(n, m) > EXACT_ROWS:
        raise ValueError(f"exact p-values are for {EXACT_ROWS} rows a side at most; leave exact=False")
    if d <= 0:
        return 1.0
    g = math.gcd(n, m)
    lcm = n // g * m
    reach = round(d * lcm)  # the statistic is a multiple of 1/lcm
    js = np.arange(m + 1) * (n // g)
    # inside[j]: probability that a random path arrives here without ever reaching the gap
    row = np.zeros(m + 1)
    row[0] = 1.0
    row = np.where(js < reach, 1.0, 0.0)
    row = np.cumprod(row)
    for i in range(1, n + 1):
        ok = np.abs(i * (m // g) - js) < reach
        # P(i,j) = [P(i-1,j) * i + P(i,j-1) * j] / (i + j); solve the row by scaled prefix sums
        new = np.zeros(m + 1)
        live = np.flatnonzero(ok)
        if len(live) == 0:
            return 1.0
        lo, hi = live[0], live[-1]
        j = np.arange(lo, hi + 1)
        step = j / (i + j)
        add = row[lo:hi + 1] * i / (i + j)
        # first-order recurrence new[j] = step[j] * new[j-1] + add[j], via logs of binomials
        logw = np.concatenate([[0.0], np.cumsum(np.log(step[1:]))]) if len(j) > 1 else np.zeros(1)
        new[lo:hi + 1] = _recurrence(step, add, logw)
        row = new
    return float(min(1.0, max(0.0, 1.0 - row[m])))


def _recurrence(step: np.ndarray, add: np.ndarray, logw: np.ndarray) -> np.ndarray:
    """Stable y[j] = step[j] y[j-1] + add[j] with y[-1] = 0, in blocks of limited decay."""
    out = np.empty_like(add)
    carry, start = 0.0, 0
    while start < len(add):
        stop = int(np.searchsorted(-(logw[start:] - logw[start]), 500.0, side="right")) + start
        stop = max(stop, start + 1)
        w = np.exp(logw[start:stop] - logw[start])
        first = step[start] * carry if start else 0.0
        out[start:stop] = w * (first + np.cumsum(add[start:stop] / w))
        carry = out[stop - 1]
        start = stop
    return out


@F.pandas_udf(T.DoubleType())
def exact_pvalue_udf(d: pd.Series, n_o: pd.Series, n_a: pd.Series) -> pd.Series:
    """One call per feature row; the table holds a row per feature."""
    return pd.Series([exact_pvalue(x, int(n), int(m)) for x, n, m in zip(d, n_o, n_a)])
