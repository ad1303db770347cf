"""Sums of Euclidean distances from every point to all points of each class, in one or two dimensions.

Points are cut into leaves along median splits of a sample. A leaf's points are met one by one only by points close by; to
all others a group of leaves is its distance function on Chebyshev nodes of its box: the distance to a point outside is smooth
over the box, so interpolation with ``NODES`` nodes a dimension is right to about ten digits once the gap is as wide as the
larger box (``APART`` half widths). Points of a leaf share the far part in the same way. The work grows with the points,
not with their pairs. The sample only steers the work: boxes and weights on the nodes are exact for all points.

Tasks get one cell (a subtree of some leaves) with copies of the leaves near it. Every task knows the boxes and node weights
of the tree, ``MAX_VALUES`` numbers at most; more points mean larger leaves from there on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinlens.session import materialize

MAX_DIMS = 2  # nodes of a box grow as NODES to the dimensions
NODES = 12
APART = 2.0
LEAF_POINTS = 512
CELL_LEAVES = 16
SAMPLE_POINTS = 32  # of a leaf
MAX_VALUES = 2_000_000
_AT_ONCE = 262_144  # distances held at once; they stay in a core's cache

_K = np.arange(NODES)
_ROOTS = np.cos((2 * _K + 1) * np.pi / (2 * NODES))
_AT_ROOTS = np.cos(np.outer(_K, (2 * _K + 1) * np.pi / (2 * NODES))) * np.where(_K == 0, 1.0, 2.0)[:, None] / NODES


def most_leaves(dims: int, classes: int) -> int:
    return MAX_VALUES // (NODES**dims * classes)


def _along(u: np.ndarray) -> np.ndarray:
    """Values at u (-1 to 1) of the polynomials that are 1 at one node and 0 at the others."""
    return np.cos(np.arccos(np.clip(u, -1.0, 1.0))[:, None] * _K) @ _AT_ROOTS


def _shape(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (lo + hi) / 2, (hi - lo) / 2


def basis(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """(points, nodes of the box): interpolation from the nodes to points in the box."""
    mid, half = _shape(lo, hi)
    out = np.ones((len(x), 1))
    for j in range(x.shape[1]):
        one = _along((x[:, j] - mid[j]) / (half[j] or 1.0))
        out = (out[:, :, None] * one[:, None, :]).reshape(len(x), -1)
    return out


def nodes(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    mid, half = _shape(lo, hi)
    axes = [m + h * _ROOTS for m, h in zip(mid, half)]
    return np.stack([g.ravel() for g in np.meshgrid(*axes, indexing="ij")], axis=1)


def summed(left: np.ndarray, right: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted sums (left rows, classes) of the distances to right rows."""
    out = np.zeros((len(left), weight.shape[1]))
    wide = min(len(right), 4096)
    step = max(1, _AT_ONCE // max(1, wide))
    for a in range(0, len(left), step):
        x = left[a:a + step]
        for b in range(0, len(right), max(1, wide)):
            y = right[b:b + wide]
            d = np.subtract.outer(x[:, 0], y[:, 0])
            np.multiply(d, d, out=d)
            for j in range(1, x.shape[1]):
                e = np.subtract.outer(x[:, j], y[:, j])
                np.multiply(e, e, out=e)
                d += e
            out[a:a + step] += np.sqrt(d, out=d) @ weight[b:b + wide]
    return out


class Tree:
    """Median splits of a sample; then boxes and node weights of all points."""

    def __init__(self, sample: np.ndarray, n_leaves: int):
        per_leaf = max(1, -(-len(sample) // n_leaves))
        self.dim, self.cut, self.children, self.parent = [], [], [], []
        todo = [(np.arange(len(sample)), -1)]
        sizes = []
        at = 0
        while at < len(todo):  # parents come before their children
            rows, parent = todo[at]
            self.parent.append(parent)
            self.dim.append(-1), self.cut.append(0.0), self.children.append((-1, -1)), sizes.append(len(rows))
            width = np.ptp(sample[rows], axis=0) if len(rows) else np.zeros(1)
            if len(rows) > per_leaf and width.max() > 0:
                j = int(width.argmax())
                v = sample[rows, j]
                cut = np.partition(v, (len(v) - 1) // 2)[(len(v) - 1) // 2]
                if cut == v.max():
                    cut = v[v < cut].max()
                self.dim[at], self.cut[at], self.children[at] = j, cut, (len(todo), len(todo) + 1)
                todo += [(rows[v <= cut], at), (rows[v > cut], at)]
            at += 1
        self.dim, self.cut, self.children, self.parent = np.array(self.dim), np.array(self.cut), np.array(self.children), np.array(self.parent)
        inside = np.where(self.dim < 0, 1, 0)
        for i in range(len(self.parent) - 1, 0, -1):
            inside[self.parent[i]] += inside[i]
        self.cell = np.full(len(self.parent), -1)  # the subtree of CELL_LEAVES leaves at most that a node is in
        for i, parent in enumerate(self.parent):
            if parent >= 0 and self.cell[parent] >= 0:
                self.cell[i] = self.cell[parent]
            elif inside[i] <= CELL_LEAVES:
                self.cell[i] = i

    @property
    def leaves(self) -> np.ndarray:
        return np.flatnonzero(self.dim < 0)

    def located(self, x: np.ndarray) -> np.ndarray:
        """Leaf (node number) of every point."""
        at = np.zeros(len(x), dtype=np.int64)
        while len(x):
            rows = np.flatnonzero(self.dim[at] >= 0)
            if len(rows) == 0:
                break
            node = at[rows]
            right = x[rows, self.dim[node]] > self.cut[node]
            at[rows] = self.children[node, right.astype(np.int64)]
        return at

    def describe(self, leaf: np.ndarray, lo: np.ndarray, hi: np.ndarray, weight: np.ndarray) -> None:
        """Take what the leaves hold: boxes, and weights (leaves, nodes, classes); add up those of the nodes above."""
        n, dims = len(self.parent), lo.shape[1]
        self.lo, self.hi = np.full((n, dims), np.inf), np.full((n, dims), -np.inf)
        self.weight = np.zeros((n, *weight.shape[1:]))
        self.lo[leaf], self.hi[leaf], self.weight[leaf] = lo, hi, weight
        for i in range(n - 1, 0, -1):
            up = self.parent[i]
            self.lo[up], self.hi[up] = np.minimum(self.lo[up], self.lo[i]), np.maximum(self.hi[up], self.hi[i])
        for i in range(n - 1, 0, -1):
            up = self.parent[i]
            if np.isfinite(self.lo[i]).all():
                self.weight[up] += basis(nodes(self.lo[i], self.hi[i]), self.lo[up], self.hi[up]).T @ self.weight[i]
        self.half = np.where(np.isfinite(self.lo).all(axis=1), (self.hi - self.lo).max(axis=1) / 2, 0.0)

    def meets(self, leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nodes that a leaf meets by nodes on both sides, by their nodes only, and leaves it meets point by point."""
        far, half, near, front = [], [], [], np.zeros(1, dtype=np.int64)
        while len(front):
            gap = np.maximum(np.maximum(self.lo[front] - self.hi[leaf], self.lo[leaf] - self.hi[front]), 0.0)
            gap = np.sqrt((gap * gap).sum(axis=1))
            empty = ~np.isfinite(self.lo[front]).all(axis=1)
            clear = (gap >= APART * self.half[front]) & (gap > 0) & ~empty
            both = clear & (gap >= APART * self.half[leaf])
            end = ~clear & ~empty & (self.dim[front] < 0)
            far.append(front[both]), half.append(front[clear & ~both]), near.append(front[end])
            front = self.children[front[~clear & ~empty & ~end]].ravel()
        return np.concatenate(far), np.concatenate(half), np.concatenate(near)

    def _swept(self, x: np.ndarray, which: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.weight.shape[2]))
        for a in range(0, len(which), 16):
            some = which[a:a + 16]
            out += summed(x, np.concatenate([nodes(self.lo[i], self.hi[i]) for i in some]), self.weight[some].reshape(-1, out.shape[1]))
        return out

    def away(self, leaf: int, x: np.ndarray, far: np.ndarray, half: np.ndarray) -> np.ndarray:
        """Sums from points x of a leaf to all points that are not near."""
        if len(x) <= NODES ** x.shape[1]:
            return self._swept(x, np.concatenate([far, half]))
        lo, hi = self.lo[leaf], self.hi[leaf]
        return basis(x, lo, hi) @ self._swept(nodes(lo, hi), far) + self._swept(x, half)


def _one_hot(code: np.ndarray, weight: np.ndarray, classes: int) -> np.ndarray:
    out = np.zeros((len(code), classes))
    out[np.arange(len(code)), code] = weight
    return out


def distance_sums(points: DataFrame, cols: list[str], classes: int, n_points: int, leaf_points: int | None = None) -> DataFrame:
    """``points`` (cols; code int, the class from 0; w, how many such rows there are) with sums: array of one sum per class.

    ``points`` is a written table of different (code, cols) without null or NaN.
    """
    dims = len(cols)
    n_leaves = int(max(1, min(most_leaves(dims, classes), -(-n_points // (leaf_points or LEAF_POINTS)))))
    share = min(1.0, n_leaves * SAMPLE_POINTS / max(1, n_points))
    tree = Tree(points.select(*cols).sample(share, 31).toPandas().to_numpy(float).reshape(-1, dims), n_leaves)
    leaf_type = T.StructField("__leaf", T.IntegerType())
    placed = T.StructType([*points.schema.fields, leaf_type, T.StructField("__cell", T.IntegerType())])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            leaf = tree.located(pdf[cols].to_numpy(float))
            yield pdf.assign(__leaf=leaf, __cell=tree.cell[leaf])

    def told(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for leaf, part in pdf.groupby("__leaf"):
            x = part[cols].to_numpy(float)
            lo, hi = x.min(axis=0), x.max(axis=0)
            weight = basis(x, lo, hi).T @ _one_hot(part["code"].to_numpy(), part["w"].to_numpy(float), classes)
            rows.append((leaf, lo, hi, weight.ravel()))
        return pd.DataFrame(rows, columns=["__leaf", "lo", "hi", "weight"])

    placed_points = materialize(points.mapInPandas(place, placed))
    facts = T.StructType([leaf_type, *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("lo", "hi", "weight")]])
    known = placed_points.groupBy("__cell").applyInPandas(told, facts).toPandas()  # a row per leaf
    if len(known) == 0:
        return points.withColumn("sums", F.array().cast("array<double>"))
    tree.describe(known["__leaf"].to_numpy(), np.stack(known["lo"]), np.stack(known["hi"]), np.stack(known["weight"]).reshape(len(known), -1, classes))
    wanted = [set() for _ in tree.parent]  # cells that need the points of a leaf
    for leaf in known["__leaf"]:
        for near in tree.meets(leaf)[2]:
            wanted[near].add(int(tree.cell[leaf]))
    first = np.concatenate([[0], np.cumsum([len(w) for w in wanted])])
    cells = np.array([c for w in wanted for c in sorted(w)], dtype=np.int64)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf) == 0:
                continue
            leaf = pdf["__leaf"].to_numpy()
            times = first[leaf + 1] - first[leaf]
            ends = np.cumsum(times)
            for a in range(0, int(ends[-1]), 65_536):  # copies one frame holds at most
                copy = np.arange(a, min(a + 65_536, int(ends[-1])))
                at = np.searchsorted(ends, copy, side="right")
                yield pdf.iloc[at].assign(__cell=cells[first[leaf[at]] + copy - (ends - times)[at]])

    kept = points.columns
    result = T.StructType([*points.schema.fields, T.StructField("sums", T.ArrayType(T.DoubleType()))])

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if len(left) == 0:
            return pd.DataFrame({c: [] for c in result.names})
        right = right.sort_values("__leaf", kind="stable")
        at, y = right["__leaf"].to_numpy(), right[cols].to_numpy(float)
        weight = _one_hot(right["code"].to_numpy(), right["w"].to_numpy(float), classes)
        done = []
        for leaf, part in left.groupby("__leaf"):
            x = part[cols].to_numpy(float)
            far, half, near = tree.meets(leaf)
            total = tree.away(leaf, x, far, half)
            for other in near:
                rows = slice(*np.searchsorted(at, [other, other + 1]))
                total += summed(x, y[rows], weight[rows])
            done.append(part[kept].assign(sums=list(total)))
        return pd.concat(done)

    return (placed_points.groupBy("__cell").cogroup(placed_points.mapInPandas(send, placed).groupBy("__cell"))
            .applyInPandas(meet, result))
