"""Linear machines trained by passes over all rows: squared hinge by Newton steps, hinge by averaged stochastic steps.

One weight vector per class, against the rest (a single one for two classes). A pass returns sums of the size of the model
from every task, never rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.functions.numbers import sql_name
from twinlens.session import materialize


@dataclass
class Planes:
    """weights[k] = (w, bias) of class k, or of class 1 where there are two classes."""

    weights: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        s = x @ self.weights[:, :-1].T + self.weights[:, -1]
        return np.concatenate([np.zeros_like(s), s], axis=1) if len(self.weights) == 1 else s


def _targets(label: np.ndarray, n_planes: int) -> np.ndarray:
    """+1 for the plane's class, -1 for the rest."""
    of = np.arange(n_planes) if n_planes > 1 else np.array([1])
    return np.where(label[:, None] == of[None, :], 1.0, -1.0)


def _numbers(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Feature matrix with a column of ones, and labels."""
    x = np.column_stack([*(c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]), np.ones(batch.num_rows)])
    return x, batch.column(0).to_numpy(zero_copy_only=False)


def _rows(train: DataFrame, cols: tuple[str, ...]) -> DataFrame:
    return train.select(F.col("label").cast("double").alias("label"), *[F.col(sql_name(c)).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])


def _added(rows: DataFrame, run, width: int) -> dict[int, np.ndarray]:
    """Vectors (i, v) that tasks return, added up per i."""

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = run(batches)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(total) + 1, dtype=np.int32) * width), pa.array(total.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), flat], ["i", "v"])

    sums = rows.mapInArrow(packed, "i int, v array<double>").groupBy("i").agg(Summarizer.sum(array_to_vector("v")).alias("v"))
    return {r["i"]: r["v"].toArray() for r in sums.collect()}


def objective(rows: DataFrame, weights: np.ndarray, c: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Value, gradient and generalised Hessian per plane of |w|^2 / 2 + c * sum max(0, 1 - t f(x))^2; one pass."""
    k, d = weights.shape

    def run(batches: Iterable[pa.RecordBatch]) -> np.ndarray:
        total, losses = np.zeros((k * (d + 1), d)), np.zeros(k)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x, label = _numbers(batch)
            t = _targets(label, k)
            gap = np.maximum(1 - t * (x @ weights.T), 0.0)
            for j in range(k):
                inside = gap[:, j] > 0
                total[j * (d + 1)] += -2 * c * (gap[:, j] * t[:, j]) @ x
                total[j * (d + 1) + 1 : (j + 1) * (d + 1)] += 2 * c * x[inside].T @ x[inside]
            losses += c * (gap**2).sum(axis=0)
        return np.concatenate([total, np.pad(losses[:, None], ((0, 0), (0, d - 1)))])

    sums = _added(rows, run, d)
    flat = np.stack([sums[i] for i in range(k * (d + 1) + k)])
    value = flat[k * (d + 1) :, 0] + 0.5 * (weights**2).sum(axis=1)
    parts = flat[: k * (d + 1)].reshape(k, d + 1, d)
    return value, parts[:, 0] + weights, parts[:, 1:] + np.eye(d)[None]


def squared_hinge(train: DataFrame, cols: tuple[str, ...], classes: int, c: float = 1.0, steps: int = 1000, tolerance: float = 1e-4) -> Planes:
    """Newton steps, halved until the objective falls, until every gradient is at most ``tolerance`` times its first length."""
    rows = materialize(_rows(train, cols))
    weights = np.zeros((1 if classes == 2 else classes, len(cols) + 1))
    value, gradient, hessian = objective(rows, weights, c)
    first = np.linalg.norm(gradient, axis=1)
    for _ in range(steps):
        open_ = np.linalg.norm(gradient, axis=1) > tolerance * first
        if not open_.any():
            break
        move = np.stack([np.linalg.solve(h, g) for h, g in zip(hessian, gradient)]) * open_[:, None]
        size = np.ones(len(weights))
        for _ in range(30):
            tried = weights - size[:, None] * move
            found = objective(rows, tried, c)
            worse = open_ & (found[0] > value - 1e-4 * size * (move * gradient).sum(axis=1) + 1e-12 * np.abs(value))
            if not worse.any():
                break
            size[worse] /= 2
        weights, (value, gradient, hessian) = tried, found
    return Planes(weights)


def stochastic_hinge(train: DataFrame, cols: tuple[str, ...], classes: int, alpha: float = 1e-4, epochs: int = 1000, tolerance: float = 1e-3,
                     patience: int = 5, seed: int = 42) -> Planes:
    """Each epoch every partition walks its rows in a shuffled order with steps 1 / (alpha (t0 + t)); the weights of the
    partitions, by their rows, and the mean loss are averaged. Ends when the loss has not fallen by ``tolerance`` for
    ``patience`` epochs."""
    rows = materialize(_rows(train, cols))
    k, d = 1 if classes == 2 else classes, len(cols) + 1
    weights, best, idle, step = np.zeros((k, d)), np.full(k, np.inf), 0, 0
    typical = np.sqrt(1.0 / np.sqrt(alpha))
    t0 = 1.0 / (typical * alpha)  # the first step has about the length of typical weights

    for epoch in range(epochs):

        def run(batches: Iterable[pa.RecordBatch], start=weights, done=step, epoch=epoch) -> np.ndarray:
            w, total, n = start.copy(), np.zeros((2 * k + 1, d)), 0
            loss = np.zeros(k)
            rng = np.random.default_rng([seed, epoch])
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                x, label = _numbers(batch)
                t = _targets(label, k)
                for i in rng.permutation(len(x)):
                    rate = 1.0 / (alpha * (t0 + done + n))
                    margin = t[i] * (w @ x[i])
                    loss += np.maximum(1 - margin, 0.0)
                    w[:, :-1] *= 1 - rate * alpha
                    w += rate * np.where(margin < 1, t[i], 0.0)[:, None] * x[i][None, :]
                    n += 1
            total[:k], total[k, 0], total[k + 1 :, 0] = w * n, n, loss
            return total

        sums = _added(rows, run, d)
        n = sums[k][0]
        if not n:
            break
        weights, step = np.stack([sums[j] for j in range(k)]) / n, step + int(n)
        loss = np.array([sums[k + 1 + j][0] for j in range(k)]) / n
        idle = 0 if (loss < best - tolerance).any() else idle + 1
        best = np.minimum(best, loss)
        if idle >= patience:
            break
    return Planes(weights)
