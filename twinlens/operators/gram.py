"""Second moments of wide tables: tasks add up matrices, Spark adds up their rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HELD_CELLS = 4_000_000  # matrix cells a task holds before it passes its sums on


def gram(df: DataFrame, cols: list[str], by: str | None = None, shift: list[float] | None = None) -> dict:
    """{group: (n, s, p)} of d x d matrices over the rows where columns i and j both have a value: their number, the sum of
    column i, and the sum of the product, all after subtracting ``shift``; without ``by`` the only group is None.

    Null and NaN cells take no part. The matrices come back to the driver: d x d numbers a group.
    """
    d, low = len(cols), np.zeros(len(cols)) if shift is None else np.asarray(shift, float)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def passed() -> Iterator[pa.RecordBatch]:
            for key, sums in held.items():
                flat = pa.ListArray.from_arrays(pa.array(np.arange(d + 1, dtype=np.int32) * 3 * d), pa.array(sums.reshape(d, 3 * d).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([key] * d, kind), pa.array(np.arange(d, dtype=np.int32)), flat], ["key", "i", "v"])
            held.clear()

        for batch in batches:
            if batch.num_rows == 0:
                continue
            kind = batch.schema.field(0).type
            x = np.column_stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in batch.columns[1:]])  # null becomes NaN
            there = ~np.isnan(x)
            x = np.where(there, x - low, 0.0)
            coded = batch.column(0).dictionary_encode(null_encoding="encode")
            for k, key in enumerate(coded.dictionary.to_pylist()):
                rows = coded.indices.to_numpy() == k
                m, v = there[rows].astype(float), x[rows]
                sums = np.stack([m.T @ m, v.T @ m, v.T @ v], axis=1)
                held[key] = held[key] + sums if key in held else sums
            if len(held) * 3 * d * d > HELD_CELLS:
                yield from passed()
        yield from passed()

    key = F.col(by) if by is not None else F.lit(None).cast("int")
    rows = df.select(key.alias("key"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    partial = rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, i int, v array<double>")
    total = partial.groupBy("key", "i").agg(Summarizer.sum(array_to_vector("v")).alias("v"))
    out: dict = {}
    for r in total.collect():
        out.setdefault(r["key"], np.zeros((d, 3, d)))[r["i"]] = r["v"].toArray().reshape(3, d)
    return {k: (v[:, 0], v[:, 1], v[:, 2]) for k, v in out.items()}


def covariances(n: np.ndarray, s: np.ndarray, p: np.ndarray, sample: bool) -> np.ndarray:
    """Covariance matrix of one group, pairwise over complete rows; 0 where there are too few."""
    rows = np.maximum(n, 1)
    spread = p - s * s.T / rows
    least = n - 1 if sample else n
    return np.where(least > 0, spread / np.maximum(least, 1), 0.0)
