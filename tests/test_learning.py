"""Splits, folds, figures and classifiers on separable data."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from twinlens.learning import boosting, linear
from twinlens.learning import utility as U
from twinlens.learning.models import MODELS, Context, predict


def blobs(n: int = 240, classes: int = 2, seed: int = 0) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    y = np.arange(n) % classes
    return pd.DataFrame({"k": np.arange(n), "a": rng.normal(size=n) + 5 * y, "b": rng.normal(size=n) - 4 * (y == 1),
                         "kind": np.array(["x", "y", "z"])[y]})


QUICK = {"random_forest": {"n_estimators": 5}, "bagging": {"n_estimators": 5}, "gradient_boosting": {"n_estimators": 3},
         "xgboost": {"n_estimators": 3}, "hist_gradient_boosting": {"max_iter": 3}, "mlp": {"max_iter": 60, "hidden_layer_sizes": (8,)},
         "ada_boost": {"n_estimators": 4}, "calibrated_cv": {"cv": 2}, "svm": {"n_components": 16}}


@pytest.mark.parametrize("name", sorted(MODELS))
def test_models_learn_two_blobs(spark, name):
    df = spark.createDataFrame(blobs())
    rows = U.stratified_split(U.prepare(df, ["a", "b"], "kind", {"x": 0.0, "y": 1.0}, "k"))
    p = U.fit_predict(name, QUICK.get(name, {}), rows.where("train"), rows.where("NOT train"), ["a", "b"], 2)
    figures = U.classification_metrics(p).first()
    assert figures["n"] == 72
    assert figures["accuracy"] > (0.2 if name == "dummy" else 0.9)


@pytest.mark.parametrize("name", ["lda", "qda", "ridge_classifier", "knn", "ada_boost", "linear_svc"])
def test_models_with_three_classes(spark, name):
    df = spark.createDataFrame(blobs(300, 3))
    rows = U.stratified_split(U.prepare(df, ["a", "b"], "kind", {"x": 0.0, "y": 1.0, "z": 2.0}, "k"))
    p = U.fit_predict(name, QUICK.get(name, {}), rows.where("train"), rows.where("NOT train"), ["a", "b"], 3)
    assert U.classification_metrics(p).first()["accuracy"] > 0.6


def test_split_and_folds_are_stratified(spark):
    df = spark.createDataFrame(blobs(101, 3))
    rows = U.prepare(df, ["a", "b"], "kind", {"x": 0.0, "y": 1.0, "z": 2.0}, "k")
    got = U.stratified_split(rows).toPandas()
    for _, part in got.groupby("label"):
        assert part.train.sum() == int(np.ceil(round(0.7 * len(part), 6)))
    dealt = U.folds(rows, 4).toPandas()
    assert (dealt.groupby(["label", "fold"]).size().unstack().apply(lambda r: r.max() - r.min(), axis=1) <= 1).all()


def test_target_fallbacks(spark):
    a = spark.createDataFrame([(1, 2)], "x int, category int")
    b = spark.createDataFrame([(1, 2)], "x int, y int")
    assert U.target_column(a, a) == "category" and U.target_column(a, a, "x") == "x" and U.target_column(b, b) == "y"
    with pytest.raises(ValueError):
        U.target_column(a, b)


def test_binary_figures_are_those_of_class_one(spark):
    p = spark.createDataFrame([(1, 1.0, 1.0), (2, 1.0, 0.0), (3, 0.0, 0.0), (4, 0.0, 0.0)], "row_id int, label double, prediction double")
    r = U.classification_metrics(p).first()
    assert (r["accuracy"], r["precision"], r["recall"]) == (0.75, 1.0, 0.5) and r["f1"] == pytest.approx(2 / 3)
    w = U.classification_metrics(p, weighted=True).first()
    assert w["f1"] == pytest.approx(0.5 * 2 / 3 + 0.5 * 0.8)


def test_scenarios_leave_the_holdout_alone(spark):
    df = spark.createDataFrame(blobs())
    p = U.prepare_scenarios(df, df, "kind", "k")
    held = {r.row_id for r in p.test.collect()}
    combined = {r.row_id for r in p.trains["combined"].collect()}
    assert not {f"o{i}" for i in held} & combined
    leaky = U.prepare_scenarios(df, df, "kind", "k", leaky=True)
    assert {f"o{i}" for i in held} & {r.row_id for r in leaky.trains["combined"].collect()}
    got = U.utility_facts(U.evaluate(p, [{"type": "lda", "cv": 3}, {"type": "dummy"}], use_cv=True))
    f = {(r.metric, r.feature, r.field): r.value for r in got.collect()}
    assert f[("combined", "lda", "accuracy")] > 0.9 and f[("combined", "lda", "cv_n_folds")] == 3
    assert 0 <= f[("utility", None, "overall_utility_score")] <= 1
    cells = {k[2]: v for k, v in f.items() if k[:2] == ("combined", "lda") and k[2].startswith("confusion_")}
    right = sum(v for k, v in cells.items() if len(set(k.split("_")[1:])) == 1)
    assert sum(cells.values()) == len(held) and right / len(held) == pytest.approx(f[("combined", "lda", "accuracy")])


def test_failing_models_leave_their_reason(spark):
    df = spark.createDataFrame(blobs())
    p = U.prepare_scenarios(df, df, "kind", "k")
    got = U.evaluate(p, [{"type": "no_such_model"}, {"type": "dummy"}])
    failed = got.where("field = 'failed'").collect()
    assert {(r.model, r.scenario) for r in failed} == {("no_such_model", s) for s in U.SCENARIOS}
    assert all("no_such_model" in r.label for r in failed)
    assert got.where("model = 'dummy' AND field = 'accuracy'").count() == 3
    facts = U.utility_facts(got).where("field = 'failed'").collect()
    assert all("no_such_model" in r.label for r in facts) and len(facts) == 3


def rings(n: int, classes: int, seed: int = 0) -> pd.DataFrame:
    """Classes as rings, which no linear model tells apart."""
    rng = np.random.default_rng(seed)
    y = rng.integers(0, classes, n)
    r, t = y + rng.normal(size=n) * 0.15 + 1, rng.uniform(0, 6.283, n)
    return pd.DataFrame({"row_id": np.arange(n), "a": (r * np.cos(t)).round(3), "b": (r * np.sin(t)).round(3), "c": rng.normal(size=n).round(1), "label": y.astype(float)})


def plain_first_tree(x, y, rules):
    """Level by level from the definition, on the values themselves: {path: leaf}."""
    p = y.mean()
    g, h = p - y, np.full(len(y), p * (1 - p))
    edges = [np.unique(np.quantile(x[:, j], [i / rules.bins for i in range(1, rules.bins)])) for j in range(x.shape[1])]

    def score(m):
        return g[m].sum() ** 2 / (h[m].sum() + rules.l2)

    leaves = {"": np.ones(len(y), bool)}
    for _ in range(rules.depth):
        fresh = {}
        for path, m in leaves.items():
            best = (1e-9, None)
            for j, cuts in enumerate(edges):
                for e in cuts:
                    left = m & (x[:, j] <= e)
                    right = m & ~left
                    if min(left.sum(), right.sum()) >= max(1, rules.least_rows) and min(h[left].sum(), h[right].sum()) >= rules.least_hessian:
                        gain = round(0.5 * (score(left) + score(right) - score(m)), 9)
                        if gain > best[0]:
                            best = (gain, (left, right))
            if best[1] is None:
                fresh[path + "."] = m
            else:
                fresh[path + "l"], fresh[path + "r"] = best[1]
        leaves = fresh
    out = np.zeros(len(y))
    for m in leaves.values():
        out[m] = -rules.rate * g[m].sum() / (h[m].sum() + rules.l2)
    return np.log(p / (1 - p)) + out


@pytest.mark.parametrize("local", [boosting.LOCAL_VALUES, 0])
def test_second_order_trees_equal_their_definition(spark, local):
    pdf = rings(300, 2)
    rules = boosting.Rules(rounds=1, depth=3, bins=16)
    model = boosting.fit(spark.createDataFrame(pdf).repartition(3), ("a", "b", "c"), 2, rules, local)
    x = pdf[["a", "b", "c"]].to_numpy()
    assert np.allclose(model.scores(model.codes(x))[:, 0], plain_first_tree(x, pdf.label.to_numpy(), rules))


@pytest.mark.parametrize("classes", [2, 3])
def test_both_paths_of_boosting_grow_the_same_trees(spark, classes, monkeypatch):
    monkeypatch.setattr(boosting, "WRITE_EVERY", 2)
    pdf = rings(400, classes, 5)
    df, x = spark.createDataFrame(pdf).repartition(4), pdf[["a", "b", "c"]].to_numpy()
    rules = boosting.Rules(rounds=5, depth=4, leaves=6, least_rows=5, bins=32)
    one, many = (boosting.fit(df, ("a", "b", "c"), classes, rules, local) for local in (10**9, 0))
    assert len(one.rounds) == len(many.rounds) == 5
    assert all(t.feature.count(-1) <= 6 for r in one.rounds for t in r)
    assert np.allclose(one.scores(one.codes(x)), many.scores(many.codes(x)))
    predicted = df.withColumn("prediction", boosting.predictions(many, df))
    assert predicted.where("prediction = label").count() > 0.85 * len(pdf)


def test_boosting_differs_from_gradient_boosting(spark):
    pdf = rings(400, 2, 9).rename(columns={"row_id": "k", "label": "y"})
    pdf["kind"] = np.array(["x", "y"])[pdf.pop("y").astype(int)]
    rows = U.stratified_split(U.prepare(spark.createDataFrame(pdf), ["a", "b", "c"], "kind", {"x": 0.0, "y": 1.0}, "k"))
    wrong = {}
    for name in ("gradient_boosting", "xgboost", "hist_gradient_boosting"):
        p = U.fit_predict(name, {"n_estimators": 8, "max_iter": 8}, rows.where("train"), rows.where("NOT train"), ["a", "b", "c"], 2).toPandas()
        wrong[name] = frozenset(p.row_id[p.label != p.prediction])
        assert len(wrong[name]) < 0.25 * len(p)
    assert len(set(wrong.values())) > 1


@pytest.mark.parametrize("classes", [2, 3])
def test_squared_hinge_ends_where_the_gradient_does(spark, classes):
    pdf = rings(240, classes, 3)
    x = np.column_stack([pdf[["a", "b", "c"]].to_numpy(), np.ones(len(pdf))])
    fitted = linear.squared_hinge(spark.createDataFrame(pdf).repartition(3), ("a", "b", "c"), classes, c=0.5, tolerance=1e-6)
    for k, w in zip(range(classes) if classes > 2 else [1], fitted.weights):
        t = np.where(pdf.label == k, 1.0, -1.0)
        gap = np.maximum(1 - t * (x @ w), 0)
        gradient = w - 2 * 0.5 * (gap * t) @ x
        at_zero = -2 * 0.5 * t @ x
        assert np.linalg.norm(gradient) < 1e-5 * np.linalg.norm(at_zero)


def test_stochastic_hinge_comes_near_the_least_objective(spark):
    rng = np.random.default_rng(21)
    n, alpha = 400, 1e-2
    y = rng.integers(0, 2, n)
    pdf = pd.DataFrame({"a": rng.normal(size=n) + 1.5 * y, "b": rng.normal(size=n) - y, "label": y.astype(float)})
    x, t = np.column_stack([pdf[["a", "b"]].to_numpy(), np.ones(n)]), 2.0 * y - 1

    def value(w):
        return alpha / 2 * (w[:-1] ** 2).sum() + np.maximum(1 - t * (x @ w), 0).mean()

    fitted = linear.stochastic_hinge(spark.createDataFrame(pdf).repartition(3), ("a", "b"), 2, alpha=alpha, epochs=40)
    least = np.zeros(3)
    for k in range(1, 20_000):  # plain subgradient steps over all rows
        hit = t * (x @ least) < 1
        least = least - 1 / (alpha * (k + 100)) * (alpha * np.append(least[:-1], 0) - (t * hit) @ x / n)
    assert value(fitted.weights[0]) < 1.03 * value(least)


def test_five_hundred_columns(spark):
    rng = np.random.default_rng(22)
    d, n = 500, 1300
    y = np.arange(n) % 2
    x = rng.normal(size=(n, d)) + 0.4 * y[:, None]
    df = spark.createDataFrame(pd.DataFrame(x, columns=[f"c{i}" for i in range(d)]).assign(row_id=np.arange(n), label=y.astype(float))).repartition(3)
    cols = tuple(f"c{i}" for i in range(d))
    ctx = Context(cols, 2, n)
    for name in ("lda", "ridge_classifier", "qda"):
        got = predict(name, df, df, ctx)
        assert got.where("label = prediction").count() > 0.9 * n
    from twinlens.operators.generate import covariance

    assert np.allclose(covariance(df, list(cols)), np.cov(x.T))


def test_training_rows_stand_in_even_rounds_over_all_cores(spark, monkeypatch):
    """Few rows are one task; more are even shares, as many as fill all cores once or several times."""
    cores = spark.sparkContext.defaultParallelism
    uneven = spark.range(0, 900, 1, 1).union(spark.range(900, 1000, 1, 2 * cores))
    assert U.in_rounds(uneven, 1000).rdd.getNumPartitions() == 1
    for per_task, rounds in ((900, 1), (-(-1000 // (cores + 1)), 2)):
        monkeypatch.setattr(U, "ROWS_PER_TASK", per_task)
        sizes = U.in_rounds(uneven, 1000).rdd.glom().map(len).collect()
        assert len(sizes) == rounds * cores and sum(sizes) == 1000
        assert max(sizes) <= 2 * 1000 / len(sizes)


def test_mlp_trains_on_shares_of_all_cores(spark, monkeypatch):
    monkeypatch.setattr(U, "ROWS_PER_TASK", 100)
    seen, fit = [], U.predict
    monkeypatch.setattr(U, "predict", lambda name, train, *rest: seen.append(train.rdd.getNumPartitions()) or fit(name, train, *rest))
    df = spark.createDataFrame(blobs()).selectExpr("k AS row_id", "CAST(kind = 'x' AS double) AS label", "a", "b")
    found = U.fit_predict("mlp", {"max_iter": 20, "hidden_layer_sizes": (4,)}, df.where("row_id >= 40"), df.where("row_id < 40"), ["a", "b"], 2)
    assert seen == [spark.sparkContext.defaultParallelism] and found.count() == 40
