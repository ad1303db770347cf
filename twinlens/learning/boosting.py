"""Second-order gradient boosting on histograms.

Features are cut into at most 256 bins at exact quantiles, once. A tree grows level by level; for a level every task adds up
gradients and Hessians of its rows by (class, node, feature, bin), Spark adds the partial sums, each (node, feature) finds its
best split from running sums over its bins, and the best split of every node is all that reaches the driver. Leaves are
-G / (H + l2); a split gains half of GL^2 / (HL + l2) + GR^2 / (HR + l2) - G^2 / (H + l2).

A training table of at most ``local_values`` codes is one group of one task, which runs the same steps on the same sums
without a job per level; the trees are the same up to the order of additions.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlens.functions.numbers import sql_name
from twinlens.operators.ranking import exact_quantiles
from twinlens.session import materialize

LOCAL_VALUES = 4_000_000
WRITE_EVERY = 10  # rounds after which the scores of all rows are written, so that no pass applies many trees


@dataclass(frozen=True)
class Rules:
    """How trees grow."""

    rounds: int = 100
    rate: float = 0.3
    depth: int = 6
    leaves: int = 2**30
    l2: float = 1.0
    least_gain: float = 0.0
    least_hessian: float = 1.0
    least_rows: int = 1
    bins: int = 256


@dataclass
class Tree:
    """Nodes as arrays; a leaf has feature -1. Codes up to ``cut`` go left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, values: tuple[float, float]) -> None:
        self.feature[node], self.cut[node], self.left[node] = feature, cut, len(self.feature)
        for v in values:
            self.feature.append(-1)
            self.cut.append(0)
            self.left.append(0)
            self.value.append(v)

    def nodes(self, codes: np.ndarray) -> np.ndarray:
        """The leaf every row of ``codes`` falls into."""
        feature, cut, left = np.array(self.feature), np.array(self.cut), np.array(self.left)
        at = np.zeros(len(codes), np.int64)
        while True:
            rows = np.flatnonzero(feature[at] >= 0)
            if not len(rows):
                return at
            here = at[rows]
            at[rows] = left[here] + (codes[rows, feature[here]] > cut[here])


@dataclass
class Boosted:
    """Edges of the bins, first scores, and a list of trees (one per score) for every round."""

    cols: tuple[str, ...]
    edges: list[np.ndarray]
    base: np.ndarray
    rounds: list[list[Tree]] = field(default_factory=list)

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)]).astype(np.uint8)

    def scores(self, codes: np.ndarray, since: int = 0, start: np.ndarray | None = None) -> np.ndarray:
        out = np.repeat(self.base[None, :], len(codes), axis=0) if start is None else start.copy()
        for trees in self.rounds[since:]:
            for k, tree in enumerate(trees):
                out[:, k] += np.array(tree.value)[tree.nodes(codes)]
        return out


def slopes(scores: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and Hessians of the logistic loss (one score) or of the softmax loss."""
    if scores.shape[1] == 1:
        p = 1 / (1 + np.exp(-scores))
        return p - label[:, None], p * (1 - p)
    p = np.exp(scores - scores.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    g = p.copy()
    g[np.arange(len(p)), label] -= 1
    return g, p * (1 - p)


def histogram(codes: np.ndarray, node: np.ndarray, g: np.ndarray, h: np.ndarray, n_nodes: int) -> np.ndarray:
    """[node, feature, bin, (rows, gradient, Hessian)]; rows of a negative node are left out."""
    d, live = codes.shape[1], node >= 0
    out = np.zeros((n_nodes, d, 256, 3))
    for j in range(d):
        place = node[live] * 256 + codes[live, j]
        for v, w in enumerate((None, g[live], h[live])):
            out[:, j, :, v] = np.bincount(place, w, n_nodes * 256).reshape(n_nodes, 256)
    return out


def gains(sums: np.ndarray, rules: Rules) -> np.ndarray:
    """Gain of a cut after every bin of [..., bin, (rows, gradient, Hessian)]; -inf where a side is too small."""
    left = sums.cumsum(axis=-2)
    whole = left[..., -1:, :]
    right = whole - left
    value = lambda s: s[..., 1] ** 2 / (s[..., 2] + rules.l2 + 1e-300)
    fits = (np.minimum(left[..., 0], right[..., 0]) >= rules.least_rows) & (np.minimum(left[..., 2], right[..., 2]) >= rules.least_hessian - 1e-12)
    return np.where(fits, 0.5 * (value(left) + value(right) - value(whole)), -np.inf)


def best_cut(sums: np.ndarray, rules: Rules) -> tuple:
    """(gain, cut, GL, HL, G, H) of one feature's bins; the lowest cut on ties."""
    gain = np.round(gains(sums, rules), 9)
    cut = int(gain.argmax())
    left, whole = sums[: cut + 1].sum(axis=0), sums.sum(axis=0)
    return float(gain[cut]), cut, left[1], left[2], whole[1], whole[2]


def grow(rules: Rules, level: Callable[[list[Tree], list[list[int]]], dict], n_scores: int) -> list[Tree]:
    """Trees of one round. ``level`` finds, for the open nodes of every tree, {(k, node): (gain, feature, cut, GL, HL, G, H)}."""
    trees = [Tree() for _ in range(n_scores)]
    open_: list[list[int]] = [[0] for _ in trees]
    leaf = lambda g, h: -rules.rate * g / (h + rules.l2) if h + rules.l2 > 0 else 0.0
    for depth in range(rules.depth):
        if not any(open_):
            break
        found, fresh = level(trees, open_), [[] for _ in trees]
        for k, tree in enumerate(trees):
            options = sorted(((n, found[k, n]) for n in open_[k] if (k, n) in found), key=lambda o: (-o[1][0], o[0]))
            for node, (gain, feature, cut, gl, hl, g, h) in options:
                if depth == 0:
                    tree.value[0] = leaf(g, h)
                if gain > max(rules.least_gain, 1e-9) and tree.feature.count(-1) < rules.leaves:
                    tree.split(node, feature, cut, (leaf(gl, hl), leaf(g - gl, h - hl)))
                    fresh[k] += [len(tree.feature) - 2, len(tree.feature) - 1]
        open_ = fresh
    return trees


def _numbered(tree: Tree, codes: np.ndarray, open_: list[int]) -> np.ndarray:
    """Place of every row's leaf among the open ones, -1 for the others."""
    place = np.full(len(tree.feature), -1)
    place[open_] = np.arange(len(open_))
    return place[tree.nodes(codes)]


def _fit_local(codes: np.ndarray, label: np.ndarray, model: Boosted, rules: Rules) -> None:
    scores = model.scores(codes)
    for _ in range(rules.rounds):
        g, h = slopes(scores, label)

        def level(trees: list[Tree], open_: list[list[int]], g=g, h=h) -> dict:
            out = {}
            for k, tree in enumerate(trees):
                sums = histogram(codes, _numbered(tree, codes, open_[k]), g[:, k], h[:, k], len(open_[k]))
                for i, node in enumerate(open_[k]):
                    cuts = [best_cut(sums[i, j], rules) for j in range(codes.shape[1])]
                    j = max(range(len(cuts)), key=lambda f: (cuts[f][0], -f))
                    out[k, node] = (cuts[j][0], j, *cuts[j][1:])
            return out

        model.rounds.append(grow(rules, level, scores.shape[1]))
        scores = model.scores(codes, len(model.rounds) - 1, scores)


def _unpacked(batch: pa.RecordBatch, d: int, n_scores: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, d)
    return codes, batch.column(1).to_numpy(), batch.column(2).flatten().to_numpy().reshape(-1, n_scores)


def _coded(train: DataFrame, model: Boosted) -> DataFrame:
    """(codes, label, scores) of the training rows, in order of the columns; written once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(model.cols))])
            codes = model.codes(x)
            scores = pa.FixedSizeListArray.from_arrays(pa.array(np.tile(model.base, len(x))), len(model.base)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in codes], pa.binary()), batch.column(0), scores], ["codes", "label", "scores"])

    rows = train.select(F.col("label").cast("int").alias("label"), *[F.col(sql_name(c)).cast("double") for c in model.cols])
    return materialize(rows.mapInArrow(run, "codes binary, label int, scores array<double>"))


def level_sums(rows: DataFrame, model: Boosted, since: int, trees: list[Tree], open_: list[list[int]]) -> DataFrame:
    """(k, node, feature, bin, n, g, h) of the open nodes, added up over all rows; ``rows`` hold the scores before round ``since``."""
    d, n_scores = len(model.cols), len(model.base)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((len(o), d, 256, 3)) for o in open_]
        for batch in batches:
            if batch.num_rows == 0:
                continue
            codes, label, start = _unpacked(batch, d, n_scores)
            g, h = slopes(model.scores(codes, since, start), label)
            for k, tree in enumerate(trees):
                if open_[k]:
                    total[k] += histogram(codes, _numbered(tree, codes, open_[k]), g[:, k], h[:, k], len(open_[k]))
        for k, sums in enumerate(total):
            i, j, b = np.nonzero(sums[..., 0])
            if len(i):
                s = sums[i, j, b]
                columns = [np.full(len(i), k, np.int32), np.array(open_[k], np.int32)[i], j.astype(np.int32), b.astype(np.int32), s[:, 0].astype(np.int64), s[:, 1].copy(), s[:, 2].copy()]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["k", "node", "feature", "bin", "n", "g", "h"])

    partial = rows.mapInArrow(run, "k int, node int, feature int, bin int, n long, g double, h double")
    return partial.groupBy("k", "node", "feature", "bin").agg(F.sum("n").alias("n"), F.sum("g").alias("g"), F.sum("h").alias("h"))


def _fit_spread(rows: DataFrame, model: Boosted, rules: Rules) -> None:
    def cut(group: pd.DataFrame) -> pd.DataFrame:
        sums = np.zeros((256, 3))
        sums[group["bin"].to_numpy()] = group[["n", "g", "h"]].to_numpy()
        found = best_cut(sums, rules)
        return pd.DataFrame([(group["k"].iloc[0], group["node"].iloc[0], found[0], -int(group["feature"].iloc[0]), *found[1:])],
                            columns=["k", "node", "gain", "minus", "cut", "gl", "hl", "g", "h"])

    schema = "k int, node int, gain double, minus int, cut int, gl double, hl double, g double, h double"
    since = 0
    for turn in range(rules.rounds):

        def level(trees: list[Tree], open_: list[list[int]], rows=rows, since=since) -> dict:
            cuts = level_sums(rows, model, since, trees, open_).groupBy("k", "node", "feature").applyInPandas(cut, schema)
            top = cuts.groupBy("k", "node").agg(F.max(F.struct("gain", "minus", "cut", "gl", "hl", "g", "h")).alias("m"))
            return {(r["k"], r["node"]): (r["m"]["gain"], -r["m"]["minus"], r["m"]["cut"], r["m"]["gl"], r["m"]["hl"], r["m"]["g"], r["m"]["h"]) for r in top.collect()}

        model.rounds.append(grow(rules, level, len(model.base)))
        if turn % WRITE_EVERY == WRITE_EVERY - 1 and turn + 1 < rules.rounds:
            rows, since = _rescored(rows, model, since), turn + 1


def _rescored(rows: DataFrame, model: Boosted, since: int) -> DataFrame:
    """The rows with the scores that all rounds so far give; written once."""
    d, n_scores = len(model.cols), len(model.base)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, _, start = _unpacked(batch, d, n_scores)
            scores = model.scores(codes, since, start)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.FixedSizeListArray.from_arrays(pa.array(scores.ravel()), n_scores).cast(pa.list_(pa.float64()))],
                                             ["codes", "label", "scores"])

    return materialize(rows.mapInArrow(run, rows.schema))


def prepared(train: DataFrame, cols: tuple[str, ...], classes: int, bins: int) -> tuple[Boosted, int]:
    """A model without trees: bin edges at exact quantiles, and the scores that give the class shares; and the row count."""
    counts = {int(r["label"]): r["count"] for r in train.groupBy("label").count().collect()}  # a row per class
    n = sum(counts.values())
    probs = [i / bins for i in range(1, bins)]
    plain = {f"x{i}": c for i, c in enumerate(cols)}
    cuts = exact_quantiles(train.select(*[F.col(sql_name(c)).cast("double").alias(x) for x, c in plain.items()]), list(plain), probs, {x: n for x in plain})
    share = np.array([(counts.get(k, 0) + 1e-9) / (n + 1e-9 * classes) for k in range(classes)])
    base = np.array([math.log(share[1] / share[0])]) if classes == 2 else np.log(share)
    return Boosted(tuple(cols), [np.unique(np.array(cuts[c], dtype=float)) for c in plain], base), n


def fit(train: DataFrame, cols: tuple[str, ...], classes: int, rules: Rules, local_values: int = LOCAL_VALUES) -> Boosted:
    """Boosted trees for ``label`` (0 .. classes - 1) from the numeric ``cols``, which hold no nulls."""
    model, n = prepared(train, cols, classes, rules.bins)
    rows = _coded(train, model)
    if n * len(cols) > local_values:
        _fit_spread(rows, model, rules)
        return model

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["codes", "label"], kind="stable")  # sums in one order on every run
        codes = np.frombuffer(b"".join(group["codes"]), np.uint8).reshape(-1, len(cols))
        made = Boosted(model.cols, model.edges, model.base)
        _fit_local(codes, group["label"].to_numpy(), made, rules)
        return pd.DataFrame({"model": [pickle.dumps(made.rounds)]})

    found = rows.select("codes", "label", F.lit(0).alias("one")).groupBy("one").applyInPandas(run, "model binary").first()
    model.rounds = pickle.loads(found["model"]) if found else []
    return model


def predictions(model: Boosted, test: DataFrame) -> Column:
    """The class of highest score of a row, the lowest class on ties."""

    @F.pandas_udf("double")
    def predict(frame: pd.DataFrame) -> pd.Series:
        scores = model.scores(model.codes(frame.to_numpy(dtype=float)))
        return pd.Series((scores[:, 0] > 0).astype(float) if scores.shape[1] == 1 else scores.argmax(axis=1).astype(float))

    return predict(F.struct(*[F.col(sql_name(c)).cast("double") for c in model.cols]))


def root_gains(train: DataFrame, cols: tuple[str, ...], classes: int, rules: Rules) -> DataFrame:
    """(k, feature, bin, n, g, h, gain): the histogram of the first tree's root and the gain of a cut after each of its bins
    (null where a side is too small)."""
    model, _ = prepared(train, cols, classes, rules.bins)
    trees = [Tree() for _ in model.base]
    sums = level_sums(_coded(train, model), model, 0, trees, [[0]] * len(trees))

    def gain(group: pd.DataFrame) -> pd.DataFrame:
        full = np.zeros((256, 3))
        full[group["bin"].to_numpy()] = group[["n", "g", "h"]].to_numpy()
        found = gains(full, rules)[group["bin"].to_numpy()]
        return group.drop(columns="node").assign(gain=np.where(np.isfinite(found), found, np.nan))

    out = sums.groupBy("k", "node", "feature").applyInPandas(gain, "k int, feature int, bin int, n long, g double, h double, gain double")
    return out.withColumn("gain", F.expr("nanvl(gain, NULL)"))
