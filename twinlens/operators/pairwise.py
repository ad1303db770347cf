"""Mean, deviation, least and largest Euclidean distance of all pairs of rows.

Equal rows are one point with a weight. Blocks of points meet pairwise in tasks, which return sums and never pairs. More than
``EXPAND_ROWS`` different points of one or two columns do not meet: their sum comes from ``distance_sums``, the sum of squares
from moments, the least distance from a neighbour join and the largest from the corners of the convex hull.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.operators import distance_sums as D
from twinlens.operators.clusters import EXPAND_ROWS, _squared
from twinlens.operators.neighbors import nearest
from twinlens.pair import ROW_ID
from twinlens.session import materialize

BLOCK_ROWS = 4096
LARGE_ROWS = 32_768  # of a block in a long table
MOST_BLOCKS = 32  # of a table as long as blocks stay below LARGE_ROWS; a point is copied to every one
CORNERS = 1_000_000  # that may go to the driver
_CELLS = 500_000  # of a matrix held at once


@dataclass
class Distances:
    mean: float = 0.0
    std: float = 0.0
    lo: float = 0.0
    hi: float = 0.0


def pair_distances(rows: DataFrame, cols: list[str], expand_rows: int = EXPAND_ROWS, block_rows: int = BLOCK_ROWS) -> Distances:
    """Figures over all pairs of ``rows``, whose ``cols`` hold neither null nor NaN; zeros for fewer than two rows."""
    x = [f"__x{i}" for i in range(len(cols))]
    points = materialize(rows.select(*[F.col(c).alias(a) for c, a in zip(cols, x)]).groupBy(*x).agg(F.count(F.lit(1)).alias("w"))
                         .select(*x, "w", F.lit(0).alias("code"), F.monotonically_increasing_id().alias(ROW_ID)))
    known = points.agg(F.count(F.lit(1)).alias("m"), F.sum("w").alias("n"), F.max("w").alias("most"), F.sum(F.col("w") * sum((F.col(c) * F.col(c) for c in x), F.lit(0.0))).alias("sq"),
                       *[f(g).alias(f"{k}{i}") for i, c in enumerate(x) for k, f, g in (("s", F.sum, F.col("w") * F.col(c)), ("lo", F.min, F.col(c)), ("hi", F.max, F.col(c)))]).first()
    n, m = known["n"] or 0, known["m"]
    if n < 2:
        return Distances()
    total = np.array([known[f"s{i}"] for i in range(len(x))], dtype=float)
    if not (np.isfinite(total).all() and np.isfinite(known["sq"])):
        return Distances(*[float("nan")] * 4)
    if m == 1:
        return Distances()
    if m > expand_rows and len(x) <= D.MAX_DIMS:
        summed = D.distance_sums(points.drop(ROW_ID), x, 1, m).agg(F.sum(F.col("w") * F.col("sums")[0])).first()[0]
        squared = 2.0 * (n * known["sq"] - float(total @ total))
        lo = 0.0 if known["most"] > 1 else _least(points, x, m)
        hi = known["hi0"] - known["lo0"] if len(x) == 1 else _largest(points, x, block_rows)
    else:
        summed, squared, lo, hi = _met(points, x, m, block_rows)
        lo = 0.0 if known["most"] > 1 else lo
    pairs = float(n) * (n - 1)  # a pair counts from both its rows, as in the sums
    mean = summed / pairs
    return Distances(mean, max(0.0, squared / pairs - mean * mean) ** 0.5, lo, hi)


def _met(points: DataFrame, x: list[str], m: int, block_rows: int) -> tuple[float, float, float, float]:
    """Sums of distances and of their squares over ordered pairs, least and largest distance of different points."""
    blocks = -(-m // max(block_rows, min(LARGE_ROWS, m // MOST_BLOCKS)))
    placed = materialize(points.select(*x, "w", F.pmod(F.xxhash64(*x), F.lit(blocks)).cast("int").alias("at")))
    one = placed.select(*x, "w", F.col("at").alias("p"), F.explode(F.sequence(F.col("at"), F.lit(blocks - 1))).alias("q"))
    two = placed.where("at > 0").select(*x, "w", F.explode(F.sequence(F.lit(0), F.col("at") - 1)).alias("p"), F.col("at").alias("q"))

    def meet(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        own = key[0] == key[1]
        right = left if own else right
        s1 = s2 = hi = 0.0
        lo = np.inf
        if len(left) and len(right):
            a, b = left[x].to_numpy(float), right[x].to_numpy(float)
            u, v = left["w"].to_numpy(float), right["w"].to_numpy(float)
            step = max(1, _CELLS // len(b))
            for s in range(0, len(a), step):
                d = _squared(a[s:s + step], b, (1.0,) * len(x))
                s2 += u[s:s + step] @ (d @ v)
                d = np.sqrt(d)
                s1 += u[s:s + step] @ (d @ v)
                hi = max(hi, d.max())
                if own:
                    d[np.arange(len(d)), s + np.arange(len(d))] = np.inf
                lo = min(lo, d.min())
        times = 1.0 if own else 2.0
        return pd.DataFrame({"s1": [times * s1], "s2": [times * s2], "lo": [lo], "hi": [hi]})

    groups = blocks * (blocks + 1) // 2
    tasks = min(groups, max(4 * points.sparkSession.sparkContext.defaultParallelism, groups // 4))  # few bytes are much work here
    sides = [side.repartition(tasks, "p", "q").groupBy("p", "q") for side in (one, two)]
    found = sides[0].cogroup(sides[1]).applyInPandas(meet, "s1 double, s2 double, lo double, hi double")
    return tuple(found.agg(F.sum("s1"), F.sum("s2"), F.min("lo"), F.max("hi")).first())


def _least(points: DataFrame, x: list[str], m: int) -> float:
    near = nearest(points, points, x, [1.0] * len(x), 1, skip_self=True, n_base=m)
    return near.agg(F.min("dist")).first()[0]


def corners(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of points of two columns."""
    order = np.lexsort((points[:, 1], points[:, 0]))
    p = points[order]
    new = np.flatnonzero(np.diff(p[:, 0], prepend=np.nan) != 0)  # of equal first columns only both ends can be corners
    p = p[np.unique(np.concatenate([new, np.append(new[1:], len(p)) - 1]))]
    for _ in range(2):
        turn = np.linspace(0, 2 * np.pi, 16, endpoint=False)
        far = p[np.unique((p @ np.stack([np.cos(turn), np.sin(turn)])).argmax(axis=0))]
        far = far[np.argsort(np.arctan2(*(far - far.mean(axis=0)).T[::-1]))]
        if len(far) < 3 or len(p) < 64:
            break
        inside = np.ones(len(p), bool)
        for a, b in zip(far, np.roll(far, -1, axis=0)):
            side = (b[0] - a[0]) * (p[:, 1] - a[1]) - (b[1] - a[1]) * (p[:, 0] - a[0])
            inside &= side > 1e-9 * max(np.abs(side).max(), 1e-300)
        p = p[~inside]
    if len(p) < 3:
        return np.unique(p, axis=0)
    chains = []
    for line in (p.tolist(), p[::-1].tolist()):
        chain: list[list[float]] = []
        for c in line:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (c[1] - chain[-2][1]) <= (chain[-1][1] - chain[-2][1]) * (c[0] - chain[-2][0]):
                chain.pop()
            chain.append(c)
        chains += chain[:-1]
    return np.array(chains)


def _largest(points: DataFrame, x: list[str], block_rows: int) -> float:
    """Two points as far apart as any are corners of the hull; those of a task's points hold all corners among them."""
    def outer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros((0, 2))
        for pdf in batches:
            if len(pdf):
                held = corners(np.concatenate([held, pdf[x].to_numpy(float)]))
        yield pd.DataFrame(held, columns=x)

    edge = materialize(points.select(*x).mapInPandas(outer, points.select(*x).schema))
    m = edge.count()
    if m <= CORNERS:
        last = corners(edge.toPandas().to_numpy(float))
        m = len(last)
        if m <= BLOCK_ROWS:
            return float(np.sqrt(_squared(last, last, (1.0, 1.0))).max())
        edge = edge.sparkSession.createDataFrame(pd.DataFrame(last, columns=x), edge.schema)
    return _met(edge.withColumn("w", F.lit(1)), x, m, block_rows)[3]
