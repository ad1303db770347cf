"""Classifiers trained as Spark jobs on a vector of standardised features.

Every entry of MODELS takes (train, test, ctx, params) with columns ``row_id``,
``label`` (0..k-1), ``features`` and the scaled feature columns, and returns
(row_id, label, prediction) of the test rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.functions.hashing import hash_uniform
from twinlens.functions.numbers import sql_name
from twinlens.learning import boosting, linear
from twinlens.operators.gram import covariances, gram
from twinlens.operators.neighbors import nearest
from twinlens.session import materialize

SEED = 42
TREE_DEPTH = 10  # fixed value: the client's default depth


@dataclass(frozen=True)
class Context:
    """What a model needs to know besides the rows."""

    cols: tuple[str, ...]
    classes: int
    n_train: int


Model = Callable[[DataFrame, DataFrame, Context, dict], DataFrame]
MODELS: dict[str, Model] = {}


def model(name: str) -> Callable[[Model], Model]:
    """Register a classifier under a type id."""
    def wrap(fn: Model) -> Model:
        MODELS[name] = fn
        return fn

    return wrap


def _out(df: DataFrame) -> DataFrame:
    return df.select("row_id", "label", F.col("prediction").cast("double").alias("prediction"))


def _fit(estimator, train: DataFrame, test: DataFrame) -> DataFrame:
    return _out(estimator.fit(train).transform(test))


def _many(estimator, train: DataFrame, test: DataFrame, ctx: Context) -> DataFrame:
    """A two-class estimator, one against the rest when there are more classes."""
    if ctx.classes > 2:
        estimator = OneVsRest(classifier=estimator, parallelism=4)
    return _fit(estimator, train, test)


def _depth(params: dict) -> int:
    return min(30, int(params.get("max_depth") or TREE_DEPTH))


@model("logistic_regression")
def logistic(train, test, ctx, params):
    reg = 1.0 / (float(params.get("C", 1.0)) * max(1, ctx.n_train))
    return _fit(LogisticRegression(maxIter=int(params.get("max_iter", 1000)), regParam=reg, standardization=False, tol=1e-4), train, test)


@model("random_forest")
def forest(train, test, ctx, params):
    return _fit(RandomForestClassifier(numTrees=int(params.get("n_estimators", 100)), maxDepth=_depth(params),
                                       seed=int(params.get("random_state", SEED))), train, test)


@model("bagging")
def bagging(train, test, ctx, params):
    """Bootstrapped trees that look at every feature."""
    return _fit(RandomForestClassifier(numTrees=int(params.get("n_estimators", 100)), maxDepth=_depth(params),
                                       featureSubsetStrategy="all", seed=int(params.get("random_state", SEED))), train, test)


@model("decision_tree")
def tree(train, test, ctx, params):
    return _fit(DecisionTreeClassifier(maxDepth=_depth(params), seed=int(params.get("random_state", SEED))), train, test)


@model("gradient_boosting")
def gradient_boosting(train, test, ctx, params):
    gbt = GBTClassifier(maxIter=int(params.get("n_estimators", 100)), stepSize=float(params.get("learning_rate", 0.1)),
                        maxDepth=int(params.get("max_depth") or 3), seed=int(params.get("random_state", SEED)))
    return _many(gbt, train, test, ctx)


def _second_order(train, test, ctx, rules: boosting.Rules):
    fitted = boosting.fit(train, ctx.cols, ctx.classes, rules)
    return _out(test.withColumn("prediction", boosting.predictions(fitted, test)))


@model("xgboost")
def xgboost(train, test, ctx, params):
    """Second-order boosting with regularised leaves."""
    return _second_order(train, test, ctx, boosting.Rules(
        rounds=int(params.get("n_estimators", 100)), rate=float(params.get("learning_rate", 0.3)), depth=int(params.get("max_depth") or 6),
        l2=float(params.get("reg_lambda", 1.0)), least_gain=float(params.get("gamma", 0.0)), least_hessian=float(params.get("min_child_weight", 1.0)),
        bins=min(256, int(params.get("max_bin", 256)))))


@model("hist_gradient_boosting")
def histogram_boosting(train, test, ctx, params):
    """The same trees with bounded leaves in number and size instead of a penalty; grown level by level, best splits first."""
    return _second_order(train, test, ctx, boosting.Rules(
        rounds=int(params.get("max_iter", 100)), rate=float(params.get("learning_rate", 0.1)), depth=int(params.get("max_depth") or 10),
        leaves=int(params.get("max_leaf_nodes") or 31), l2=float(params.get("l2_regularization", 0.0)), least_hessian=1e-3,
        least_rows=int(params.get("min_samples_leaf", 20)), bins=min(256, int(params.get("max_bins", 255)))))


@model("mlp")
def perceptron_layers(train, test, ctx, params):
    hidden = params.get("hidden_layer_sizes", (100,))
    hidden = [hidden] if isinstance(hidden, int) else list(hidden)
    return _fit(MultilayerPerceptronClassifier(
        layers=[len(ctx.cols), *map(int, hidden), ctx.classes], maxIter=int(params.get("max_iter", 1000)),
        seed=int(params.get("random_state", SEED))), train, test)


@model("linear_svc")
def linear_svc(train, test, ctx, params):
    """Squared hinge loss with an L2 term on weights and bias, by damped Newton steps over all rows."""
    fitted = linear.squared_hinge(train, ctx.cols, ctx.classes, c=float(params.get("C", 1.0)), steps=int(params.get("max_iter", 1000)),
                                  tolerance=float(params.get("tol", 1e-4)))
    return _best(test, ctx, list(range(ctx.classes)), fitted.scores)


@model("sgd_classifier")
def sgd(train, test, ctx, params):
    """Hinge loss with an L2 term by stochastic steps in every partition, whose results are averaged after each epoch."""
    fitted = linear.stochastic_hinge(train, ctx.cols, ctx.classes, alpha=float(params.get("alpha", 1e-4)), epochs=int(params.get("max_iter", 1000)),
                                     tolerance=float(params.get("tol", 1e-3)), patience=int(params.get("n_iter_no_change", 5)), seed=int(params.get("random_state", SEED)))
    return _best(test, ctx, list(range(ctx.classes)), fitted.scores)


@model("svm")
def kernel_svm(train, test, ctx, params):
    """RBF machine approximated by random Fourier features and a linear machine.

    gamma="scale" is 1 / (features * variance) = 1 / features on standardised columns.
    """
    gamma = params.get("gamma", "scale")
    gamma = 1.0 / len(ctx.cols) if gamma in ("scale", "auto") else float(gamma)
    width = int(params.get("n_components", 128))
    rng = np.random.default_rng(int(params.get("random_state", SEED)))
    weights = rng.normal(scale=math.sqrt(2 * gamma), size=(width, len(ctx.cols)))
    phase = rng.uniform(0, 2 * math.pi, size=width)
    names = [f"__f{i}" for i in range(width)]
    scale = math.sqrt(2.0 / width)

    def lift(df: DataFrame) -> DataFrame:
        exprs = [f"{scale!r}D * cos({float(phase[i])!r}D + " + " + ".join(
            f"({float(w)!r}D) * {sql_name(c)}" for w, c in zip(weights[i], ctx.cols)) + f") AS {names[i]}" for i in range(width)]
        lifted = df.selectExpr("row_id", "label", *exprs)
        return VectorAssembler(inputCols=names, outputCol="features").transform(lifted).select("row_id", "label", "features")

    reg = 1.0 / (float(params.get("C", 1.0)) * max(1, ctx.n_train))
    machine = LinearSVC(maxIter=200, regParam=reg, standardization=False, tol=float(params.get("tol", 1e-3)))
    return _many(machine, lift(train), lift(test), ctx)


@model("knn")
def k_nearest(train, test, ctx, params):
    """Majority label of the k nearest training rows, lowest label on ties."""
    k = int(params.get("n_neighbors", 5))
    near = nearest(test, train, list(ctx.cols), [1.0] * len(ctx.cols), k)
    votes = (near.join(train.select(F.col("row_id").alias("bid"), F.col("label").alias("vote")), "bid")
             .groupBy("qid", "vote").agg(F.count(F.lit(1)).alias("n")))  # at most k rows per query row
    top = votes.groupBy("qid").agg(F.max(F.struct("n", -F.col("vote"))).alias("m"))
    won = top.select(F.col("qid").alias("row_id"), (-F.col("m")["col2"]).alias("prediction"))
    return _out(test.join(won, "row_id"))


@model("naive_bayes")
def naive_bayes(train, test, ctx, params):
    return _fit(NaiveBayes(modelType="gaussian"), train, test)


def _class_moments(train: DataFrame, ctx: Context) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Per class: rows, mean vector, population covariance; one pass, however many columns."""
    out = {}
    for label, (n, s, p) in gram(train, list(ctx.cols), by="label").items():
        out[int(label)] = (int(n[0, 0]), np.diag(s) / n[0, 0], covariances(n, s, p, sample=False))
    return dict(sorted(out.items()))


def _argmax(test: DataFrame, scores: dict[int, str]) -> DataFrame:
    """Class with the highest score, the lowest class on ties."""
    cells = ", ".join(f"named_struct('s', {text}, 'c', {-c})" for c, text in sorted(scores.items()))
    return _out(test.withColumn("prediction", F.expr(f"-array_max(array({cells})).c")))


def _best(test: DataFrame, ctx: Context, classes: list[int], scores: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Class with the highest of the ``scores`` (rows x classes) of each row, the lowest class on ties."""
    names = np.array(classes, float)

    @F.pandas_udf("double")
    def best(frame: pd.DataFrame) -> pd.Series:
        return pd.Series(names[scores(frame.to_numpy(dtype=float)).argmax(axis=1)])

    return _out(test.withColumn("prediction", best(F.struct(*[F.col(sql_name(c)).cast("double") for c in ctx.cols]))))


def _best_linear(test: DataFrame, ctx: Context, planes: dict[int, tuple[np.ndarray, float]]) -> DataFrame:
    weights, bias = np.stack([w for w, _ in planes.values()], axis=1), np.array([b for _, b in planes.values()])
    return _best(test, ctx, list(planes), lambda x: x @ weights + bias)


@model("lda")
def discriminant(train, test, ctx, params):
    """Class means and pooled covariance from one pass, linear scores."""
    m = _class_moments(train, ctx)
    n = sum(v[0] for v in m.values())
    pooled = sum(v[0] * v[2] for v in m.values()) / max(1, n - len(m))
    inverse = np.linalg.pinv(pooled)
    planes = {}
    for c, (have, mean, _) in m.items():
        w = inverse @ mean
        planes[c] = (w, -0.5 * mean @ w + math.log(have / n))
    return _best_linear(test, ctx, planes)


@model("qda")
def quadratic_discriminant(train, test, ctx, params):
    """Gaussian log-likelihood with the covariance of each class."""
    m = _class_moments(train, ctx)
    n = sum(v[0] for v in m.values())
    parts = []
    for have, mean, cov in m.values():
        cov = cov * have / max(1, have - 1)
        sign, logdet = np.linalg.slogdet(cov)
        parts.append((mean, np.linalg.pinv(cov), math.log(have / n) - 0.5 * (logdet if sign > 0 else 0.0)))

    def scores(x: np.ndarray) -> np.ndarray:
        return np.stack([shift - 0.5 * (((x - mean) @ inverse) * (x - mean)).sum(axis=1) for mean, inverse, shift in parts], axis=1)

    return _best(test, ctx, list(m), scores)


@model("ridge_classifier")
def ridge(train, test, ctx, params):
    """Least squares on +-1 targets with an L2 term, solved from class moments."""
    m = _class_moments(train, ctx)
    n = sum(v[0] for v in m.values())
    mean = sum(v[0] * v[1] for v in m.values()) / n
    total = sum(v[0] * (v[2] + np.outer(v[1] - mean, v[1] - mean)) for v in m.values())
    lhs = total + float(params.get("alpha", 1.0)) * np.eye(len(ctx.cols))
    planes = {}
    for c, (have, mu, _) in m.items():
        target = 2 * have / n - 1  # mean of the +-1 target
        w = np.linalg.solve(lhs, 2 * have * (mu - mean))
        planes[c] = (w, target - mean @ w)
    return _best_linear(test, ctx, planes)


@model("ada_boost")
def ada_boost(train, test, ctx, params):
    """SAMME over weighted one-level trees; a round is one fit and one aggregate.

    The weights of a round build on those of the round before; every ten rounds they are written, so that a lost block
    or a plan never reaches back further.
    """
    rounds, rate = int(params.get("n_estimators", 100)), float(params.get("learning_rate", 1.0))
    k = ctx.classes
    stages: list[tuple[float, object]] = []
    data = train.select("row_id", "label", "features").withColumn("w", F.lit(1.0)).persist()
    try:
        for turn in range(rounds):
            fitted = DecisionTreeClassifier(maxDepth=1, weightCol="w", seed=SEED).fit(data)
            scored = fitted.transform(data)
            miss = (F.col("prediction") != F.col("label")).cast("double")
            bad, whole = scored.agg(F.sum(F.col("w") * miss), F.sum("w")).first()
            err = bad / whole
            if err <= 0:
                stages.append((1.0, fitted))
                break
            if err >= 1 - 1 / k:
                break
            alpha = rate * (math.log((1 - err) / err) + math.log(k - 1))
            stages.append((alpha, fitted))
            # weights are a product over rounds; scaling by the largest keeps them finite
            grown = scored.select("row_id", "label", "features", (F.col("w") * F.exp(F.lit(alpha) * (miss - 1))).alias("w"))
            fresh = (materialize(grown) if turn % 10 == 9 else grown).persist()
            fresh.count()
            data.unpersist()
            data = fresh
    finally:
        data.unpersist()
    if not stages:
        return dummy_model(train, test, ctx, {"strategy": "most_frequent"})
    voted = test
    for i, (_, fitted) in enumerate(stages):
        voted = fitted.setPredictionCol(f"p{i}").setRawPredictionCol("").setProbabilityCol("").transform(voted)
    votes = {c: "(" + " + ".join(f"CASE WHEN p{i} = {c} THEN {a!r}D ELSE 0D END" for i, (a, _) in enumerate(stages)) + ")"
             for c in range(k)}
    return _argmax(voted, votes)


@model("dummy")
def dummy_model(train, test, ctx, params):
    """Labels drawn by their training shares, or always the most frequent one."""
    counts = [(r["label"], r["count"]) for r in train.groupBy("label").count().orderBy("label").collect()]
    if params.get("strategy", "stratified") != "stratified":
        return _out(test.withColumn("prediction", F.lit(max(counts, key=lambda c: c[1])[0])))
    n, upto, draw = sum(c for _, c in counts), 0, None
    u = hash_uniform(SEED, "dummy", F.col("row_id"))
    for label, c in counts:
        upto += c
        draw = F.when(u * n < upto, F.lit(label)) if draw is None else draw.when(u * n < upto, F.lit(label))
    return _out(test.withColumn("prediction", draw))


@model("calibrated_cv")
def calibrated(train, test, ctx, params):
    """Per fold: logistic scores, a sigmoid fitted on the held-out fold; probabilities averaged."""
    folds = int(params.get("cv", 5))
    split = train.withColumn("fold", F.pmod(F.xxhash64("row_id"), F.lit(folds)).cast("int")).persist()
    scored: DataFrame = test
    try:
        for f in range(folds):
            part = split.where(F.col("fold") != f)
            base = LogisticRegression(maxIter=1000, regParam=1.0 / max(1, ctx.n_train), standardization=False,
                                      tol=1e-4).fit(part)
            base = base.setRawPredictionCol(f"raw{f}").setProbabilityCol("").setPredictionCol("")
            held = base.transform(split.where(F.col("fold") == f)).withColumn("raw", vector_to_array(f"raw{f}"))
            scored = base.transform(scored).withColumn(f"raw{f}", vector_to_array(f"raw{f}"))
            for c in range(ctx.classes):
                pairs = held.select((F.col("label") == c).cast("double").alias("label"), F.col("raw")[c].alias("s"))
                one = VectorAssembler(inputCols=["s"], outputCol="features").transform(pairs)
                fit = LogisticRegression(maxIter=100, tol=1e-4).fit(one)
                a, b = float(fit.coefficients[0]), float(fit.intercept)
                scored = scored.withColumn(f"q{f}_{c}", F.expr(f"1D / (1D + exp(-(({a!r}D) * raw{f}[{c}] + ({b!r}D))))"))
    finally:
        split.unpersist()
    mean = {}
    for c in range(ctx.classes):
        parts = [f"q{f}_{c} / (" + " + ".join(f"q{f}_{j}" for j in range(ctx.classes)) + ")" for f in range(folds)]
        mean[c] = "(" + " + ".join(parts) + ")"
    return _argmax(scored, mean)


def predict(name: str, train: DataFrame, test: DataFrame, ctx: Context, params: dict | None = None) -> DataFrame:
    if name not in MODELS:
        raise ValueError(f"unknown model type: {name}")
    return MODELS[name](train, test, ctx, dict(params or {}))


