"""Exact nearest-neighbour and within-radius joins on numeric and categorical columns.

Base rows are cut into leaves of bounded size along median splits of a sample. The
nearest join takes two passes. First every query row is searched in its home leaf, which
gives a true k-th distance. Then it goes only to those leaves that can still beat it:
by their bounding box, by the interval of their rows' distances to shared pivots, and by
the interval around their own centre (triangle inequality, which keeps pruning where boxes
of many dimensions no longer do). Spark shuffles query and base rows together by leaf,
each task indexes its leaf and searches it, and the partial results are merged per query
row. The sample only steers the work: results are exact for any sample. Hot spots are
handled before the shuffle: equal base rows are reduced to the few that can matter,
oversized leaves become several blocks, and leaves that attract many queries are
replicated over salts. A base of at most ``broadcast_rows`` rows (counted first) travels
to the tasks instead, and nothing is shuffled.

A categorical column is a struct (a, b, w): the point (1 - w) a + w b between two corners
of the simplex of its categories, a category itself being (c, c, 0). Distances are those of
the one-hot columns, which are never built, so any number of categories will do. Classes
and categories are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinlens.session import materialize, spread

BROADCAST_ROWS = 50_000
LEAF_ROWS = 32_768
BLOCK_ROWS = 262_144  # base rows one task indexes at most, on average
MAX_LEAVES = 16384
GROUP_QUERIES = 50_000
PLACED_ROWS = 65_536  # copies of rows one frame holds at most while they are placed
SAMPLE_ROWS = 200_000
SAMPLE_VALUES = 4_000_000  # bound on sampled rows x columns held by the driver
LEAF_VALUES = 131_072  # numbers a leaf of the nearest join holds by default
LARGE_VALUES = 2_097_152  # numbers a leaf holds at most where query rows visit many leaves
MANY_VISITS = 24  # of leaves by a query row, on average
PIVOTS = 8
BOX_DIMS = 3  # up to so many columns boxes alone prune well
PRODUCT_DIMS = 8  # from so many columns on a matrix product tells which pairs need their exact distance
_CHUNK = 2_000_000  # matrix cells computed at once inside a task


@dataclass(frozen=True)
class SearchSpec:
    """What is searched: columns, their scale, and the optional class column."""

    cols: tuple[str, ...]
    scale: tuple[float, ...]
    k: int
    same: bool
    skip_self: bool
    cats: tuple[str, ...] = ()

    @property
    def fields(self) -> list[str]:
        """Columns of a placed row that describe its position."""
        return [*(["code"] if self.same else []), *self.cols, *[f"{c}__{part}" for c in self.cats for part in "abw"]]

    def points(self, pdf: pd.DataFrame) -> np.ndarray:
        return pdf[list(self.cols)].to_numpy(dtype=float)

    def codes(self, pdf: pd.DataFrame) -> np.ndarray:
        return pdf["code"].to_numpy() if self.same else np.zeros(len(pdf), dtype=np.int64)

    def mixes(self, pdf: pd.DataFrame) -> list[Mix]:
        return [Mix(*(pdf[f"{c}__{part}"].to_numpy() for part in "abw")) for c in self.cats]


@dataclass(frozen=True)
class Mix:
    """Points (1 - w) a + w b of a categorical column."""

    a: np.ndarray
    b: np.ndarray
    w: np.ndarray

    def __getitem__(self, rows) -> Mix:
        return Mix(self.a[rows], self.b[rows], self.w[rows])

    @property
    def pure(self) -> np.ndarray:
        return (self.a == self.b) | (self.w == 0)

    def norm(self) -> np.ndarray:
        """Squared length."""
        return self._dot(self, lambda x: x, lambda x: x)

    def _dot(self, other: Mix, left, right) -> np.ndarray:
        a, b, w, v = left(self.a), left(self.b), left(self.w), right(other.w)
        c, d = right(other.a), right(other.b)
        return (((1 - w) * (1 - v) * (a == c) + w * v * (b == d)) + ((1 - w) * v * (a == d) + w * (1 - v) * (b == c)))

    def apart(self, other: Mix) -> np.ndarray:
        """Squared distances to the points of ``other``."""
        if self.pure.all() and other.pure.all():
            return 2.0 * (self.a[:, None] != other.a[None, :])
        dot = self._dot(other, lambda x: x[:, None], lambda x: x[None, :])
        return np.maximum(self.norm()[:, None] + other.norm()[None, :] - 2 * dot, 0.0)

    def gap(self, lo: np.ndarray, hi: np.ndarray, pure: np.ndarray) -> np.ndarray:
        """Least squared distance to cells whose rows are single categories with codes in [lo, hi]; 0 where unknown."""
        outside = lambda x: (x[:, None] < lo[None, :]) | (x[:, None] > hi[None, :])
        return np.where(outside(self.a) & outside(self.b) & pure[None, :], (self.norm() + 1)[:, None], 0.0)


def squared_distances(q: np.ndarray, b: np.ndarray, scale: tuple[float, ...]) -> np.ndarray:
    """Differences are taken in raw units, so mirror-image ties stay exact ties."""
    out = np.zeros((len(q), len(b)))
    for j, s in enumerate(scale):
        d = (q[:, j, None] - b[None, :, j]) / s
        out += d * d
    return out


def product_distances(q: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by one matrix product, and how far those of each row of ``q`` may be off."""
    one, two = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", b, b)
    out = q @ (-2 * b).T
    out += one[:, None]
    out += two
    return out, 1e-14 * (8 + q.shape[1]) * (one + two.max(initial=0.0))


def loose(squared: np.ndarray) -> np.ndarray:
    """A squared distance widened by rounding error."""
    return squared * (1 + 1e-9) + 1e-12


def spreads(z: np.ndarray, n_cats: int) -> np.ndarray:
    """Extent of every column of [code, scaled columns, category codes]; two categories are sqrt(2) apart."""
    out = np.ptp(z, axis=0) if len(z) else np.zeros(max(1, z.shape[1]))
    if n_cats:
        out[-n_cats:] = np.where(out[-n_cats:] > 0, 2.0**0.5, 0.0)
    return out


def _chunks(n: int, width: int) -> Iterator[slice]:
    step = max(1, _CHUNK // max(1, width))
    for start in range(0, n, step):
        yield slice(start, start + step)


class LocalIndex:
    """Median-split cells over the base rows of one task, searched nearest cell first."""

    CELL = 512

    def __init__(self, spec: SearchSpec, b: pd.DataFrame):
        self.spec = spec
        if "bid" in b:
            b = b.sort_values("bid", kind="stable")
            self.ids = b["bid"].to_numpy()
        self.weight = b["w"].to_numpy() if "w" in b else None
        self.x, self.codes, self.mixes = spec.points(b), spec.codes(b), spec.mixes(b)
        z = np.column_stack([self.codes.astype(float), self.x / np.array(spec.scale), *[m.a.astype(float) for m in self.mixes]])
        self.cells: list[np.ndarray] = []
        todo = [np.arange(len(z))] if len(z) else []
        while todo:
            rows = todo.pop()
            spread = spreads(z[rows], len(self.mixes))
            if len(rows) <= self.CELL or spread.max() == 0:
                self.cells.append(rows)  # ascending positions, hence ascending ids
                continue
            v = z[rows, 0 if spread[0] > 0 else int(spread.argmax())]
            cut = np.partition(v, (len(v) - 1) // 2)[(len(v) - 1) // 2]
            right = v > cut if cut < v.max() else v >= cut
            todo += [rows[~right], rows[right]]
        self.lo = np.array([z[r].min(axis=0) for r in self.cells])
        self.hi = np.array([z[r].max(axis=0) for r in self.cells])
        self.kinds = [tuple(np.array([f(r) for r in self.cells]) for f in (
            lambda r: m.a[r].min(), lambda r: m.a[r].max(), lambda r: m.pure[r].all())) for m in self.mixes]
        if self.weight is not None:
            self.cell_weight = np.array([self.weight[r].sum() for r in self.cells])

    def _reach(self, z: np.ndarray, mixes: list[Mix]) -> tuple[np.ndarray, np.ndarray]:
        """Squared distance to the near side and to the far side (numeric columns) of every cell."""
        near, far = np.zeros((len(z), len(self.cells))), np.zeros((len(z), len(self.cells)))
        for j in range(1, z.shape[1]):
            below, above = self.lo[None, :, j] - z[:, j, None], z[:, j, None] - self.hi[None, :, j]
            gap, span = np.maximum(np.maximum(below, above), 0.0), np.maximum(np.abs(below), np.abs(above))
            near += gap * gap
            far += span * span
        for m, kinds in zip(mixes, self.kinds):
            near += m.gap(*kinds)
        near[(z[:, 0, None] < self.lo[None, :, 0]) | (z[:, 0, None] > self.hi[None, :, 0])] = np.inf
        return near, far

    def top_k(self, q: pd.DataFrame) -> pd.DataFrame:
        """The k nearest rows of every query row; ties go to the lowest base id."""
        row, bid, dist = self.best(q)
        return pd.DataFrame({"qid": q["qid"].to_numpy()[row], "bid": bid, "dist": dist})

    def best(self, q: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position of the query row, base id, distance), by position, distance and base id.

        A column ``bound`` holds a squared distance that wanted rows do not exceed.
        """
        spec, k, qid = self.spec, self.spec.k, q["qid"].to_numpy()
        qx, qc, qm = spec.points(q), spec.codes(q), spec.mixes(q)
        start = loose(q["bound"].to_numpy()) if "bound" in q else np.full(len(q), np.inf)
        z = np.column_stack([qc.astype(float), qx / np.array(spec.scale)])
        parts = []
        for piece in _chunks(len(q) if self.cells else 0, max(len(self.cells), 4 * k)):
            near, _ = self._reach(z[piece], [m[piece] for m in qm])
            dist, at = np.repeat(start[piece][:, None], k, axis=1), np.full((len(near), k), -1, dtype=np.int64)
            home = near.argmin(axis=1)
            for first in (True, False):
                for c, cell in enumerate(self.cells):
                    if first:
                        rows = np.flatnonzero((home == c) & np.isfinite(near[:, c]))
                    else:
                        rows = np.flatnonzero((home != c) & (near[:, c] <= loose(dist[:, -1])) & np.isfinite(near[:, c]))
                    for some in _chunks(len(rows), len(cell)):
                        self._offer(qx[piece], qc[piece], qid[piece], [m[piece] for m in qm], rows[some], cell, dist, at)
            r, c = np.nonzero(at >= 0)
            parts.append((r + piece.start, self.ids[at[r, c]], np.sqrt(dist[r, c])))
        none = np.zeros(0, dtype=np.int64)
        return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (none, none, np.zeros(0))

    def _offer(self, qx, qc, qid, qm, rows, cell, dist, at) -> None:
        """Merge the base rows of a cell into the best lists of some query rows."""
        if len(self.spec.scale) >= PRODUCT_DIMS and not qm:
            rows, d = self._close(qx, qc, qid, rows, cell, dist)
        else:
            d = squared_distances(qx[rows], self.x[cell], self.spec.scale)
        for m, own in zip(qm, self.mixes):
            d += m[rows].apart(own[cell])
        if self.spec.same:
            d[qc[rows][:, None] != self.codes[cell][None, :]] = np.inf
        if self.spec.skip_self:
            d[qid[rows][:, None] == self.ids[cell][None, :]] = np.inf
        new_d, new_at, line = [], [], np.arange(len(rows))
        for _ in range(min(self.spec.k, len(cell))):
            best = d.argmin(axis=1)
            new_d.append(d[line, best])
            new_at.append(np.where(np.isfinite(new_d[-1]), cell[best], -1))
            d[line, best] = np.inf
        all_d = np.column_stack([dist[rows], *new_d])
        all_at = np.column_stack([at[rows], *new_at])
        # equal distances are ordered by position, i.e. by base id
        order = np.lexsort((all_at, all_d), axis=1)[:, :self.spec.k]
        dist[rows], at[rows] = np.take_along_axis(all_d, order, 1), np.take_along_axis(all_at, order, 1)

    def _close(self, qx, qc, qid, rows, cell, dist) -> tuple[np.ndarray, np.ndarray]:
        """Those rows that a row of the cell may come close enough to, and exact squared distances of such pairs (else infinite)."""
        x, y = qx[rows], self.x[cell]
        about, off = product_distances(x / np.array(self.spec.scale), y / np.array(self.spec.scale))
        if self.spec.same:
            about[qc[rows][:, None] != self.codes[cell][None, :]] = np.inf
        if self.spec.skip_self:
            about[qid[rows][:, None] == self.ids[cell][None, :]] = np.inf
        limit = loose(dist[rows, -1])
        first = np.flatnonzero(np.isinf(limit))
        if len(first) and len(cell) >= self.spec.k:
            limit[first] = np.partition(about[first], self.spec.k - 1, axis=1)[:, self.spec.k - 1] + off[first]
        r, c = np.nonzero(~(about > (limit + off)[:, None]))
        kept, at = np.unique(r, return_inverse=True)
        d = np.full((len(kept), len(cell)), np.inf)
        for some in _chunks(len(r), len(self.spec.scale)):
            gap = (x[r[some]] - y[c[some]]) / np.array(self.spec.scale)
            total = np.zeros(len(gap))
            for j in range(gap.shape[1]):  # in the order of squared_distances
                total += gap[:, j] * gap[:, j]
            d[at[some], c[some]] = total
        return rows[kept], d

    def count(self, q: pd.DataFrame, radius: float) -> np.ndarray:
        """Weight of the rows within the radius of every query row."""
        qx, r2 = self.spec.points(q), radius * radius
        z = np.column_stack([np.zeros(len(q)), qx / np.array(self.spec.scale)])
        out = np.zeros(len(q), dtype=np.int64)
        for piece in _chunks(len(q) if self.cells else 0, len(self.cells)):
            near, far = self._reach(z[piece], [])
            inside = far < r2 * (1 - 1e-9)
            got = inside @ self.cell_weight
            edge = (near <= r2 * (1 + 1e-9) + 1e-12) & ~inside
            for c, cell in enumerate(self.cells):
                rows = np.flatnonzero(edge[:, c])
                for some in _chunks(len(rows), len(cell)):
                    d = squared_distances(qx[piece][rows[some]], self.x[cell], self.spec.scale)
                    got[rows[some]] += (np.sqrt(d) <= radius) @ self.weight[cell]
            out[piece] = got
        return out


class Leaves:
    """Median-split cells over a sample, with exact extents and sizes of the whole base."""

    def __init__(self, spec: SearchSpec, sample: pd.DataFrame, n_leaves: int):
        self.spec = spec
        pts = np.unique(self.matrix(sample), axis=0)
        self.dim: list[int] = []
        self.cut: list[float] = []
        self.kids: list[tuple[int, int]] = []
        self.members: list[np.ndarray] = []
        per_leaf = max(2, len(pts) // max(1, n_leaves))
        self._grow(pts, per_leaf)
        self.dim_a, self.cut_a, self.kids_a = np.array(self.dim), np.array(self.cut), np.array(self.kids)
        self.n = len(self.members)
        self.salts = np.ones(self.n, dtype=np.int64)
        d = len(spec.cols)
        self.centres = np.array([m[:, 1:1 + d].mean(axis=0) if len(m) else np.zeros(d) for m in self.members]).reshape(self.n, d)
        self.members = []  # the sample has done its work
        self.pivots = self._far_points(pts[:, 1:1 + d]) if d > BOX_DIMS and self.n > 1 else np.zeros((0, d))

    def _far_points(self, x: np.ndarray) -> np.ndarray:
        """Points far from each other: each the farthest from those before."""
        x = x[np.linspace(0, len(x) - 1, min(len(x), 20_000)).astype(int)]
        away, out = ((x - x.mean(axis=0)) ** 2).sum(axis=1), []
        for i in range(min(PIVOTS, len(x))):
            out.append(x[int(away.argmax())])
            d = ((x - out[-1]) ** 2).sum(axis=1)
            away = d if i == 0 else np.minimum(away, d)
        return np.array(out)

    def places(self, x: np.ndarray) -> np.ndarray:
        """Distances to the pivots."""
        return np.column_stack([np.zeros((len(x), 0)), *[np.sqrt(((x[:, 1:1 + len(self.spec.cols)] - p) ** 2).sum(axis=1)) for p in self.pivots]])

    def _grow(self, pts: np.ndarray, per_leaf: int) -> int:
        """Split ``pts`` at the median of the class code, else of the widest column."""
        node = len(self.dim)
        self.dim.append(-1)
        self.cut.append(0.0)
        self.kids.append((-1, -1))
        spread = spreads(pts, len(self.spec.cats))
        if len(pts) > per_leaf and spread.max() > 0:
            d = 0 if spread[0] > 0 else int(spread.argmax())
            values = np.sort(pts[:, d])
            cut = values[(len(values) - 1) // 2]
            if cut == values[-1]:
                cut = values[values < cut].max()
            right = pts[:, d] > cut
            self.dim[node], self.cut[node] = d, float(cut)
            left_kid = self._grow(pts[~right], per_leaf)
            self.kids[node] = (left_kid, self._grow(pts[right], per_leaf))
        else:
            self.kids[node] = (len(self.members), -1)
            self.members.append(pts)
        return node

    def located(self, x: np.ndarray) -> np.ndarray:
        """Leaf number of every row of [code, scaled columns]."""
        node = np.zeros(len(x), dtype=np.int64)
        active = self.dim_a[node] >= 0
        while active.any():
            rows = np.flatnonzero(active)
            at = node[rows]
            right = (x[rows, self.dim_a[at]] > self.cut_a[at]).astype(int)
            node[rows] = self.kids_a[at, right]
            active[rows] = self.dim_a[node[rows]] >= 0
        return self.kids_a[node, 0]

    def matrix(self, pdf: pd.DataFrame) -> np.ndarray:
        """[code, scaled columns, category codes]"""
        return np.column_stack([self.spec.codes(pdf).astype(float), self.spec.points(pdf) / np.array(self.spec.scale),
                                *[m.a.astype(float) for m in self.spec.mixes(pdf)]])

    def measures(self, pdf: pd.DataFrame) -> pd.DataFrame:
        """(leaf, n, total, lo, hi, klo, khi, mixed) of the leaves that rows of ``pdf`` fall into."""
        x, d = self.matrix(pdf), 1 + len(self.spec.cols)
        leaf = self.located(x)
        values = x[:, :d]
        if len(self.pivots):
            own = np.sqrt(((x[:, 1:d] - self.centres[leaf]) ** 2).sum(axis=1))
            values = np.column_stack([values, self.places(x), own])
        order = np.argsort(leaf, kind="stable")
        ids, heads = np.unique(leaf[order], return_index=True)
        weight = pdf["w"].to_numpy() if "w" in pdf else np.ones(len(pdf), dtype=np.int64)
        mixes = self.spec.mixes(pdf)
        kinds = np.column_stack([np.zeros((len(pdf), 0), dtype=np.int64), *[m.a for m in mixes]])[order]
        mixed = np.any([~m.pure for m in mixes], axis=0) if mixes else np.zeros(len(pdf), dtype=bool)
        per = lambda f, v: list(f.reduceat(v, heads, axis=0))
        return pd.DataFrame({
            "leaf": ids, "n": np.diff(np.append(heads, len(leaf))), "total": np.add.reduceat(weight[order], heads),
            "lo": per(np.minimum, values[order]), "hi": per(np.maximum, values[order]),
            "klo": per(np.minimum, kinds), "khi": per(np.maximum, kinds), "mixed": np.logical_or.reduceat(mixed[order], heads)})

    def describe(self, rows: list) -> None:
        """Take exact extents and sizes; decide the number of blocks per leaf."""
        d, k = 1 + len(self.spec.cols), len(self.spec.cats)
        wide = d + (len(self.pivots) + 1 if len(self.pivots) else 0)
        lo, hi = np.full((self.n, wide), np.inf), np.full((self.n, wide), -np.inf)
        self.klo, self.khi, self.pure = np.zeros((self.n, k), dtype=np.int64), np.zeros((self.n, k), dtype=np.int64), np.ones(self.n, dtype=bool)
        self.total, rows_in = np.zeros(self.n, dtype=np.int64), np.zeros(self.n)
        for r in rows:
            leaf = r["leaf"]
            lo[leaf], hi[leaf] = r["lo"], r["hi"]
            self.klo[leaf], self.khi[leaf], self.pure[leaf] = r["klo"], r["khi"], not r["mixed"]
            self.total[leaf], rows_in[leaf] = r["total"], r["n"]
        with np.errstate(invalid="ignore"):  # empty leaves
            slack = 1e-9 * np.maximum(np.abs(lo), np.abs(hi)) + 1e-12
            slack[:, :d] = 0.0  # box sides are values of rows
            lo, hi = lo - slack, hi + slack
        self.lo, self.hi = lo[:, :d], hi[:, :d]
        self.ring_lo, self.ring_hi = lo[:, d:], hi[:, d:]
        self.blocks = np.maximum(1, np.ceil(rows_in / BLOCK_ROWS)).astype(np.int64)

    def _near_far(self, x: np.ndarray, mixes: list[Mix]) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances that no row of a leaf falls below, and (numeric columns) that none exceeds."""
        near, far = np.zeros((len(x), self.n)), np.zeros((len(x), self.n))
        d = 1 + len(self.spec.cols)
        with np.errstate(invalid="ignore"):
            for j in range(1, d):
                below, above = self.lo[None, :, j] - x[:, j, None], x[:, j, None] - self.hi[None, :, j]
                gap = np.maximum(np.maximum(below, above), 0.0)
                near += gap * gap
                reach = np.maximum(np.abs(below), np.abs(above))
                far += reach * reach
            if len(self.pivots):
                away = self.places(x)
                rings = [away[:, i, None] for i in range(len(self.pivots))]
                square = (x[:, 1:d] ** 2).sum(axis=1)[:, None] + (self.centres ** 2).sum(axis=1)[None, :] - 2 * x[:, 1:d] @ self.centres.T
                # the rounding error of the short form above is allowed for
                error = 1e-12 * ((x[:, 1:d] ** 2).sum(axis=1)[:, None] + (self.centres ** 2).sum(axis=1)[None, :])
                rings.append((np.sqrt(np.maximum(square - error, 0.0)), np.sqrt(np.maximum(square + error, 0.0))))
                for i, ring in enumerate(rings):
                    low, high = ring if isinstance(ring, tuple) else (ring, ring)
                    gap = np.maximum(np.maximum(self.ring_lo[None, :, i] - high, low - self.ring_hi[None, :, i]), 0.0)
                    near = np.maximum(near, gap * gap)
        for j, m in enumerate(mixes):
            near += m.gap(self.klo[:, j], self.khi[:, j], self.pure)
        alien = (x[:, 0, None] < self.lo[None, :, 0]) | (x[:, 0, None] > self.hi[None, :, 0])
        near[alien | (self.total == 0)[None, :]] = np.inf
        return near, far

    def visits(self, pdf: pd.DataFrame, limit: np.ndarray, count: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf) pairs within the squared distances ``limit``, and with ``count`` the rows already counted whole."""
        x, mixes = self.matrix(pdf), self.spec.mixes(pdf)
        who, where, whole = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], np.zeros(len(x), dtype=np.int64)
        for piece in _chunks(len(x), self.n):
            near, far = self._near_far(x[piece], [m[piece] for m in mixes])
            go = (near <= loose(limit[piece])[:, None]) & np.isfinite(near)
            if count:
                inside = go & (far < limit[piece][:, None] * (1 - 1e-9))
                whole[piece] = inside @ self.total
                go &= ~inside
            r, leaf = np.nonzero(go)
            who.append(r + piece.start)
            where.append(leaf)
        return np.concatenate(who), np.concatenate(where), whole

    def load(self, leaf_queries: np.ndarray) -> None:
        """Salts by the number of query rows that visit each leaf."""
        self.salts = np.clip(np.ceil(leaf_queries / GROUP_QUERIES), 1, 1 << 19).astype(np.int64)


def _cell(leaf: np.ndarray, block: np.ndarray, salt: np.ndarray) -> np.ndarray:
    return (leaf.astype(np.int64) << 40) + (block.astype(np.int64) << 20) + salt.astype(np.int64)


def _key_hash(values: pd.Series) -> np.ndarray:
    return pd.util.hash_array(values.to_numpy()).astype(np.uint64)


def _row_hash(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), dtype=np.uint64)
    for j in range(x.shape[1]):
        out = out * np.uint64(31) + _key_hash(pd.Series(x[:, j]))
    return out


def _expand(index: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Repeat positions and number the copies."""
    rep = np.repeat(np.arange(len(index)), times)
    first = np.repeat(np.cumsum(times) - times, times)
    return rep, np.arange(len(rep)) - first


def search_spec(scale: list[float], k: int, same: bool = False, skip_self: bool = False, cats: list[str] | None = None) -> SearchSpec:
    return SearchSpec(tuple(f"__x{i}" for i in range(len(scale))), tuple(float(s) for s in scale), k, same, skip_self, tuple(f"__k{i}" for i in range(len(cats or ()))))


def _side(df: DataFrame, key: str, name: str, cols: list[str], cats: list[str] | None, same: str | None) -> DataFrame:
    """(name, position columns) under names of their own; classes and categories become hashes."""
    places = [F.col(c).alias(f"__x{i}") for i, c in enumerate(cols)]
    code = [F.xxhash64(same).alias("code")] if same else []
    mixes = [x for i, c in enumerate(cats or ()) for x in (F.xxhash64(F.col(c)["a"]).alias(f"__k{i}__a"), F.xxhash64(F.col(c)["b"]).alias(f"__k{i}__b"),
                                                          F.col(c)["w"].alias(f"__k{i}__w"))]
    rows = df.where(F.col(same).isNotNull()) if same else df
    return rows.select(F.col(key).alias(name), *places, *code, *mixes)


def _plan_leaves(spec: SearchSpec, b: DataFrame, n_base: int, leaf_rows: int) -> Leaves:
    """Cut a sample, then measure every leaf over all rows of ``b`` in one pass."""
    n_leaves = int(min(MAX_LEAVES, max(1, -(-n_base // leaf_rows))))
    room = min(SAMPLE_ROWS, SAMPLE_VALUES // (len(spec.cols) + 1))
    sample = b.sample(min(1.0, min(room, 32 * n_leaves) / max(1, n_base)), 17).limit(room).toPandas()
    leaves = Leaves(spec, sample, n_leaves)
    schema = "leaf int, n long, total long, lo array<double>, hi array<double>, klo array<long>, khi array<long>, mixed boolean"

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield leaves.measures(pdf)

    wide = 1 + len(spec.cols) + (len(leaves.pivots) + 1 if len(leaves.pivots) else 0)
    each = lambda f, c, n: F.array(*[f(F.col(c)[i]) for i in range(n)]).alias(c)
    rows = b.mapInPandas(measure, schema).groupBy("leaf").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), each(F.min, "lo", wide), each(F.max, "hi", wide),
        each(F.min, "klo", len(spec.cats)), each(F.max, "khi", len(spec.cats)), F.max("mixed").alias("mixed")).collect()
    leaves.describe(rows)
    return leaves


def _placed_base(b: DataFrame, leaves: Leaves, weight: bool) -> DataFrame:
    schema = T.StructType([*b.schema.fields, T.StructField("cell", T.LongType())])
    key, salts = None if weight else "bid", leaves.salts

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = leaves.matrix(pdf)
            leaf = leaves.located(x)
            spread = _key_hash(pdf[key]) if key else _row_hash(x)
            block = (spread % leaves.blocks[leaf].astype(np.uint64)).astype(np.int64)
            rep, salt = _expand(leaf, salts[leaf])
            for a in range(0, len(rep), PLACED_ROWS):
                part = rep[a:a + PLACED_ROWS]
                yield pdf.iloc[part].assign(cell=_cell(leaf[part], block[part], salt[a:a + PLACED_ROWS]))

    return b.mapInPandas(place, schema)


def _homes(leaves: Leaves, pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Leaf and block in which a query row is searched first."""
    leaf = leaves.located(leaves.matrix(pdf))
    block = ((_key_hash(pdf["qid"]) >> np.uint64(20)) % leaves.blocks[leaf].astype(np.uint64)).astype(np.int64)
    return leaf, block


def _placed_home(q: DataFrame, leaves: Leaves) -> DataFrame:
    schema, salts = T.StructType([*q.schema.fields, T.StructField("cell", T.LongType())]), leaves.salts

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                leaf, block = _homes(leaves, pdf)
                salt = (_key_hash(pdf["qid"]) % salts[leaf].astype(np.uint64)).astype(np.int64)
                yield pdf.assign(cell=_cell(leaf, block, salt))

    return q.mapInPandas(place, schema)


def _elsewhere(leaves: Leaves, pdf: pd.DataFrame, anew: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, block) a query row still has to visit, given its squared distance ``bound``; all such places if ``anew``."""
    who, leaf, _ = leaves.visits(pdf, pdf["bound"].to_numpy())
    rep, block = _expand(leaf, leaves.blocks[leaf])
    who, leaf = who[rep], leaf[rep]
    if anew:
        return who, leaf, block
    home, home_block = _homes(leaves, pdf)
    new = (leaf != home[who]) | (block != home_block[who])
    return who[new], leaf[new], block[new]


def _placed_visits(q: DataFrame, leaves: Leaves, anew: bool = False) -> DataFrame:
    schema, salts = T.StructType([*q.schema.fields, T.StructField("cell", T.LongType())]), leaves.salts

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf) == 0:
                continue
            who, leaf, block = _elsewhere(leaves, pdf, anew)
            salt = (_key_hash(pdf["qid"])[who] % salts[leaf].astype(np.uint64)).astype(np.int64)
            cell = _cell(leaf, block, salt)
            for a in range(0, len(who), PLACED_ROWS):
                yield pdf.iloc[who[a:a + PLACED_ROWS]].assign(cell=cell[a:a + PLACED_ROWS])

    return q.mapInPandas(place, schema)


def _placed_radius(q: DataFrame, leaves: Leaves, radius2: float, n_query_cells: int) -> DataFrame:
    schema = T.StructType([*q.schema.fields, T.StructField("cell", T.LongType()), T.StructField("whole", T.LongType())])
    salts = leaves.salts

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf) == 0:
                continue
            who, leaf, whole = leaves.visits(pdf, np.full(len(pdf), radius2), count=True)
            rep, block = _expand(leaf, leaves.blocks[leaf])
            who, leaf = who[rep], leaf[rep]
            h = _key_hash(pdf["qid"])
            salt = (h[who] % salts[leaf].astype(np.uint64)).astype(np.int64)
            cell = _cell(leaf, block, salt)
            for a in range(0, len(who), PLACED_ROWS):
                yield pdf.iloc[who[a:a + PLACED_ROWS]].assign(cell=cell[a:a + PLACED_ROWS], whole=np.int64(0))
            spread = (h % np.uint64(n_query_cells)).astype(np.int64)
            yield pdf.assign(cell=-1 - spread, whole=whole)

    return q.mapInPandas(place, schema)


def complete_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows without null or NaN in ``cols``; only such rows have a place and a distance."""
    keep = F.lit(True)
    for c in cols:
        keep = keep & F.col(c).isNotNull()
        if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
            keep = keep & ~F.isnan(c)
    return df.where(keep)


def nearest(query: DataFrame, base: DataFrame, cols: list[str], scale: list[float], k: int, *,
            qid: str = "row_id", bid: str = "row_id", same: str | None = None, skip_self: bool = False, cats: list[str] | None = None,
            n_base: int | None = None, leaf_rows: int | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(qid, bid, dist, rank): the k nearest base rows per query row, rank from 1.

    Rows with a null or NaN coordinate are left out on both sides. Ties are ordered by base id. ``same`` restricts the search to base rows with an
    equal class (a null class has no rows); ``skip_self`` leaves out the base row whose id equals the query id. ``cats`` names struct columns
    (a, b, w). ``n_base`` saves a count where the number of complete base rows is known; a leaf holds ``leaf_rows`` rows, by default a bounded
    number of values.
    """
    query, base = complete_rows(query, cols), complete_rows(base, cols)
    spec = search_spec(scale, k, same is not None, skip_self, cats)
    q, b = _side(query, qid, "qid", cols, cats, same), _side(base, bid, "bid", cols, cats, same)
    schema = T.StructType([T.StructField("qid", q.schema["qid"].dataType),
                           T.StructField("bid", b.schema["bid"].dataType),
                           T.StructField("dist", T.DoubleType())])
    n_base = b.count() if n_base is None else n_base
    if n_base <= broadcast_rows and n_base * len(spec.fields) <= SAMPLE_VALUES:
        small = b.toPandas()

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = LocalIndex(spec, small)
            for pdf in batches:
                yield index.top_k(pdf)

        found = q.mapInPandas(search, schema)
    else:
        leaf_rows = leaf_rows or max(256, LEAF_VALUES // max(1, len(spec.fields)))
        found = _two_passes(spec, q, b, leaf_rows, schema)
    if k == 1:
        best = found.groupBy("qid").agg(F.min(F.struct("dist", "bid")).alias("m"))
        return best.select("qid", "m.bid", "m.dist", F.lit(1).alias("rank"))
    order = W.partitionBy("qid").orderBy("dist", "bid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def lean_base(spec: SearchSpec, b: DataFrame) -> DataFrame:
    """Base rows without those that k equal ones of smaller id hide; written once."""
    copies = spec.k + (1 if spec.skip_self else 0)
    if copies == 1:
        return materialize(b.groupBy(*spec.fields).agg(F.min("bid").alias("bid")).select(b.columns))
    first = F.row_number().over(W.partitionBy(*spec.fields).orderBy("bid"))  # pushed below the shuffle as a per-task group limit
    return materialize(b.withColumn("__copy", first).where(F.col("__copy") <= copies).drop("__copy"))


def home_pass(spec: SearchSpec, q: DataFrame, lean: DataFrame, leaves: Leaves) -> DataFrame:
    """Query rows with what their home leaf holds: (..., bound, bids, dists); written once."""
    q = materialize(spread(q, q.count()))
    named = T.StructType([T.StructField("leaf", T.IntegerType())])

    def at(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"leaf": leaves.located(leaves.matrix(pdf)) if len(pdf) else []})

    loads = np.zeros(leaves.n)
    for r in q.mapInPandas(at, named).groupBy("leaf").count().collect():  # a row per leaf
        loads[r["leaf"]] = r["count"]
    leaves.load(loads / leaves.blocks)
    bids = T.ArrayType(lean.schema["bid"].dataType)
    schema = T.StructType([*q.schema.fields, T.StructField("bound", T.DoubleType()), T.StructField("bids", bids), T.StructField("dists", T.ArrayType(T.DoubleType()))])

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.drop(columns="cell").reset_index(drop=True)
        if len(left) == 0 or len(right) == 0:
            none = pd.Series([[]] * len(left), dtype=object)
            return left.assign(bound=np.inf, bids=none, dists=none)
        row, bid, dist = LocalIndex(spec, right).best(left)
        size = np.bincount(row, minlength=len(left))
        ends = np.cumsum(size)
        bound = np.where(size == spec.k, dist[ends - 1] ** 2, np.inf) if len(dist) else np.inf
        lists = {"bids": np.split(bid, ends[:-1]), "dists": np.split(dist, ends[:-1])}
        return left.assign(bound=bound, **{c: pd.Series(v, dtype=object) for c, v in lists.items()})

    return materialize(_placed_home(q, leaves).groupBy("cell").cogroup(_placed_base(lean, leaves, False).groupBy("cell")).applyInPandas(search, schema))


def _two_passes(spec: SearchSpec, q: DataFrame, b: DataFrame, leaf_rows: int, schema: T.StructType) -> DataFrame:
    lean = lean_base(spec, b)
    n_lean = lean.count()
    leaves = _plan_leaves(spec, lean, n_lean, leaf_rows)
    first = home_pass(spec, q, lean, leaves)
    found = first.select("qid", F.explode(F.arrays_zip("bids", "dists")).alias("m")).select("qid", F.col("m.bids").alias("bid"), F.col("m.dists").alias("dist"))
    if int(leaves.blocks.sum()) == 1:
        return found
    asked = first.drop("bids", "dists")
    n_query = first.count()
    trial = asked.sample(min(1.0, 5000 / max(1, n_query)), 23).limit(10_000).toPandas()
    anew = False
    if len(trial):
        _, where, block = _elsewhere(leaves, trial)
        larger = min(leaf_rows * (len(where) // (MANY_VISITS * len(trial))), LARGE_VALUES // len(spec.fields))
        if larger > leaf_rows:
            # bounds prune little here: larger leaves, all visited with the bound that is known now, take fewer copies of a query row
            leaves, anew = _plan_leaves(spec, lean, n_lean, larger), True
            _, where, block = _elsewhere(leaves, trial, anew)
        loads = np.bincount(where, minlength=leaves.n) * (n_query / len(trial)) / leaves.blocks
        leaves.load(loads)

    def search_cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if len(left) == 0 or len(right) == 0:
            return pd.DataFrame({"qid": [], "bid": [], "dist": []})
        return LocalIndex(spec, right).top_k(left)

    more = (_placed_visits(asked, leaves, anew).groupBy("cell").cogroup(_placed_base(lean, leaves, False).groupBy("cell"))
            .applyInPandas(search_cell, schema))
    return more if anew else found.unionByName(more)


def count_within(query: DataFrame, base: DataFrame, cols: list[str], scale: list[float], radius: float, *,
                 qid: str = "row_id", n_base: int | None = None, leaf_rows: int = LEAF_ROWS,
                 broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(qid, n): number of base rows at most ``radius`` away from each query row.

    Rows with a null or NaN coordinate are left out on both sides. Equal base rows are counted once and weighted; leaves that lie inside the ball
    contribute their size without being visited.
    """
    query, base = complete_rows(query, cols), complete_rows(base, cols)
    spec = search_spec(scale, 1)
    q = _side(query, qid, "qid", cols, None, None)
    b = base.select(*[F.col(c).alias(x) for c, x in zip(cols, spec.cols)])
    radius2 = radius * radius
    schema = T.StructType([T.StructField("qid", q.schema["qid"].dataType), T.StructField("n", T.LongType())])

    weighted = b.groupBy(*spec.cols).agg(F.count(F.lit(1)).alias("w"))
    n_base = b.count() if n_base is None else n_base
    if n_base <= broadcast_rows and n_base * len(cols) <= SAMPLE_VALUES:
        small = weighted.toPandas()

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = LocalIndex(spec, small)
            for pdf in batches:
                yield pd.DataFrame({"qid": pdf["qid"], "n": index.count(pdf, radius)})

        return q.mapInPandas(search, schema)
    weighted = materialize(weighted)
    leaves = _plan_leaves(spec, weighted, n_base, leaf_rows)
    n_query = q.count()
    q = materialize(spread(q, n_query))
    trial = q.sample(min(1.0, 5000 / max(1, n_query)), 23).limit(10_000).toPandas()
    if len(trial):
        _, where, _ = leaves.visits(trial, np.full(len(trial), radius2), count=True)
        leaves.load(np.bincount(where, minlength=leaves.n) * (n_query / len(trial)))

    def search_cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        near = LocalIndex(spec, right).count(left, radius) if len(left) and len(right) else 0
        return pd.DataFrame({"qid": left["qid"], "n": left["whole"] + near})

    cells = max(1, n_query // GROUP_QUERIES)
    found = (_placed_radius(q, leaves, radius2, cells).groupBy("cell")
             .cogroup(_placed_base(weighted, leaves, True).groupBy("cell"))
             .applyInPandas(search_cell, schema))
    return found.groupBy("qid").agg(F.sum("n").alias("n"))


def mean_nearest(query: DataFrame, base: DataFrame, sets: list[tuple[str, ...]], scale: dict[str, float], *, n_base: int,
                 qid: str = "row_id", bid: str = "row_id", broadcast_rows: int = BROADCAST_ROWS) -> list[DataFrame]:
    """Tables (at, m): for sets of columns, by their position, the mean distance of query rows to their nearest base row.

    A base that travels to the tasks is read once for all sets, and so are the query rows.
    """
    cols = list(dict.fromkeys(c for names in sets for c in names))
    if n_base > broadcast_rows or n_base * len(cols) > SAMPLE_VALUES:
        return [nearest(query, base, list(names), [scale[c] for c in names], 1, qid=qid, bid=bid, n_base=n_base, broadcast_rows=broadcast_rows)
                .agg(F.lit(i).alias("at"), F.avg("dist").alias("m")) for i, names in enumerate(sets)]
    specs = [SearchSpec(names, tuple(float(scale[c]) for c in names), 1, False, False) for names in sets]
    small = complete_rows(base, cols).select(F.col(bid).alias("bid"), *cols).toPandas()

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        indexes = [LocalIndex(spec, small) for spec in specs]
        for pdf in batches:
            dists = [index.best(pdf)[2] for index in indexes]
            yield pd.DataFrame({"at": range(len(dists)), "s": [d.sum() for d in dists], "n": [len(d) for d in dists]})

    rows = complete_rows(query, cols).select(F.col(qid).alias("qid"), *cols)
    sums = rows.mapInPandas(search, "at int, s double, n long").groupBy("at").agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("m"))
    return [sums]
