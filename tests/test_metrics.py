"""Hand-made frames: edge cases and invariants of the metrics and scores."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from twinlens import Pair
from twinlens.operators import diversity as D
from twinlens.operators import fidelity as M
from twinlens.operators import pairwise
from twinlens.operators import privacy as V
from twinlens.operators import profile as P
from twinlens.plans import analyze as A
from twinlens.plans import score


def facts(df) -> dict:
    return {(r.metric, r.feature, r.field): r.label if r.value is None else r.value for r in df.collect()}


def frame(spark, **cols):
    return spark.createDataFrame(pd.DataFrame(cols))


@pytest.fixture(scope="module")
def same(spark):
    df = frame(spark, k=range(60), x=[float(i % 20) for i in range(60)], y=[float(i * i % 17) for i in range(60)])
    return Pair(df, df, key="k")


def test_identical_tables_have_no_distance(same):
    f = facts(M.ks_test(same)) | facts(M.kl_divergence(same)) | facts(M.js_divergence(same))
    f |= facts(M.statistical_moments(same)) | facts(M.mmd(same)) | facts(M.q_function(same))
    assert f[("kolmogorov_smirnov", "x", "statistic")] == 0 and f[("kolmogorov_smirnov", "x", "pvalue")] == 1
    assert f[("kl_divergence", None, "average_kl_divergence")] == 0
    assert f[("js_divergence", None, "average_js_divergence")] == 0
    assert f[("statistical_moments", "y", "wasserstein")] == 0
    assert f[("statistical_moments", None, "stat_badge")] == "high"
    assert f[("q_function", None, "q_score")] == 1
    near = V.pair_neighbors(same)
    p = facts(V.distance_to_closest(same, near)) | facts(V.uniqueness(same)) | facts(V.attribute_disclosure(same, near))
    assert p[("distance_to_closest", None, "mean_dcr")] == 0
    assert p[("uniqueness", None, "average_uniqueness")] <= 0.5
    assert p[("attribute_disclosure", None, "overall_risk")] == "high"


def test_missing_and_nan_rows_are_dropped(spark):
    o = spark.createDataFrame([(1.0, 1), (float("nan"), 2), (None, 3), (4.0, None), (5.0, 5)], "x double, y int")
    pair = Pair(o, o)
    assert pair.counts() == (2, 2) and pair.o.count() == 2
    assert {r["column"]: r["missing"] for r in P.missing_values(o).collect()} == {"x": 2, "y": 1, None: 3}


def test_column_kinds(spark):
    df = spark.sql("SELECT 1 AS i, 2.5D AS d, cast(1.5 AS decimal(5,2)) AS m, 'a' AS s, true AS b, date'2020-01-01' AS t, array(1) AS r")
    assert [(r.kind, r.n) for r in P.column_type_shares(df).collect()] == [("numeric", 3), ("categorical", 1), ("other", 3)]
    assert Pair(df, df).cols == ["i", "d", "m"]


def test_validation_flags(spark):
    o, a = frame(spark, x=[1.0, 2.0]), frame(spark, z=["a"] * 30)
    got = {(r.kind, r.item): r.value for r in P.validate_pair(o, a).collect()}
    assert ("error", "no_common_column") in got and ("error", "no_common_numeric_column") in got
    assert ("warning", "original_small") in got and ("warning", "augmented_much_larger") in got
    assert got[("info", "size_ratio")] == 15 and got[("info", "valid")] == 0


def test_constant_column(spark):
    o = frame(spark, x=[3.0] * 12, y=[float(i) for i in range(12)])
    a = frame(spark, x=[3.0] * 12, y=[float(i + 1) for i in range(12)])
    pair = Pair(o, a)
    f = facts(M.kl_divergence(pair)) | facts(D.feature_entropy(pair)) | facts(D.range_coverage(pair)) | facts(V.k_anonymity(pair))
    assert f[("kl_divergence", "x", "kl")] == 0 and f[("feature_entropy", "x", "entropy")] == 0
    assert f[("range_coverage", "x", "coverage_ratio")] == 1
    assert f[("k_anonymity", None, "k_anonymity")] >= 1


def test_disjoint_ranges(spark):
    o, a = frame(spark, x=[float(i) for i in range(50)]), frame(spark, x=[float(i + 500) for i in range(50)])
    pair = Pair(o, a)
    f = facts(M.ks_test(pair)) | facts(D.range_coverage(pair)) | facts(M.js_divergence(pair)) | facts(V.k_anonymity(pair))
    assert f[("kolmogorov_smirnov", "x", "statistic")] == 1
    assert f[("range_coverage", "x", "coverage_ratio")] == 0
    assert f[("k_anonymity", None, "n_equivalence_classes")] == 1  # everything in the out-of-range bin
    # the augmented histogram is empty, so smoothing makes it uniform: sqrt(ln 2) is the most
    assert 0 <= f[("js_divergence", "x", "js")] <= math.sqrt(math.log(2))


def test_histogram_edges_belong_right_and_last_bin_is_closed(spark):
    from twinlens.operators.histogram import pair_histogram

    o = frame(spark, x=[0.0, 1.0, 2.0, 50.0])
    got = {r.bin: r.o for r in pair_histogram(Pair(o, o)).collect() if r.o}
    assert got == {0: 1, 1: 1, 2: 1, 49: 1}


def test_single_column_leaves_only_q_function_empty(spark):
    o = frame(spark, x=[float(i) for i in range(30)])
    f = facts(M.q_function(Pair(o, o)))
    assert f[("q_function", None, "q_score")] is None
    assert facts(M.ks_test(Pair(o, o)))[("kolmogorov_smirnov", None, "average_pvalue")] == 1


def test_triples_of_attributes():
    sets = M.attribute_sets(["a", "b", "c", "d", "e", "f"])
    assert sum(len(s) == 2 for s in sets) == 15 and sum(len(s) == 3 for s in sets) == 6
    assert all(sum(c in s for s in sets) == 8 for c in "abcdef")  # no column is left out


def test_shift_raises_distances(spark):
    base = [float(i % 23) for i in range(200)]
    o = frame(spark, x=base)
    small, large = frame(spark, x=[v + 1 for v in base]), frame(spark, x=[v + 8 for v in base])
    got = [facts(M.mean_absolute_distance(Pair(o, a))) for a in (small, large)]
    key = ("mean_absolute_distance", None, "overall_distance")
    assert got[0][key] < got[1][key]


def test_key_free_pairs_work(spark):
    o = frame(spark, x=[float(i % 5) for i in range(40)], y=[1.0 * i for i in range(40)])
    f = facts(V.nearest_neighbor_risk(V.pair_neighbors(Pair(o, o))))
    assert f[("nearest_neighbor_risk", None, "average_distance_to_nearest")] == 0


def test_whole_analysis_and_scores(spark):
    n = 120
    o = frame(spark, k=range(n), x=[float(i % 29) for i in range(n)], y=[float((i * 7) % 31) for i in range(n)])
    near = o.withColumn("x", F.col("x") + 0.1)
    far = o.withColumn("x", F.col("x") * 3 + 40)
    out = A.compare(o, {"near": near, "far": far}, key="k").cache()
    assert out.where("field = 'error'").count() == 0
    s = {(r.variant, r.metric): r.value for r in out.where("dimension = 'score'").collect()}
    assert all(0 <= v <= 1 for v in s.values()) and len(s) == 8
    table = {r.variant: r for r in score.comparison_table(out.where("dimension <> 'score'")).collect()}
    assert table["near"].rating in {"Excellent", "Good", "Fair", "Adequate", "Poor"}
    ks = {r.variant: r.value for r in out.where("metric = 'kolmogorov_smirnov' AND field = 'average_pvalue'").collect()}
    assert ks["near"] > ks["far"]


def test_no_common_numeric_column_gives_error_facts(spark):
    pair = Pair(frame(spark, x=[1.0]), frame(spark, z=[1.0]))
    got = A.analyze(pair).collect()
    assert {r.metric for r in got if r.field == "error"} == {"fidelity", "diversity", "privacy"}
    assert {r.dimension for r in got if r.field != "error"} == {"validation", "summary"}
    assert {(r.metric, r.feature) for r in got if r.dimension == "summary"} == {("original", "x"), ("augmented", "z")}


def test_ratings_at_bounds(spark):
    df = spark.createDataFrame([(v,) for v in (0.8, 0.6, 0.4, 0.2, 0.19)], "s double")
    assert [r[0] for r in df.select(score.rating(F.col("s"))).collect()] == ["Excellent", "Good", "Fair", "Adequate", "Poor"]


def test_shared_steps_give_the_same_facts(spark):
    from twinlens.operators import fidelity, privacy
    from twinlens.pair import Pair

    rows = [(k, float(k * 7 % 23), float(k * k % 31)) for k in range(60)] + [(60, None, 1.0)]
    more = [(k, float(k * 5 % 19), float(k * k % 37)) for k in range(45)] + [(45, 2.0, None)]
    pair = Pair(spark.createDataFrame(rows, "k long, a double, b double"), spark.createDataFrame(more, "k long, a double, b double"), key="k")
    gaps, bins, near = fidelity.pair_gaps(pair), fidelity.divergences(pair), privacy.pair_neighbors(pair)
    facts = lambda df: sorted(map(str, df.collect()))
    for metric, shared in ((fidelity.ks_test, {"gaps": gaps}), (fidelity.statistical_moments, {"gaps": gaps}), (fidelity.kl_divergence, {"found": bins}),
                           (fidelity.js_divergence, {"found": bins}), (fidelity.q_function, {"neighbors": near})):
        assert facts(metric(pair)) == facts(metric(pair, **shared))


def test_cosines_of_turns_equal_those_of_angles():
    turns = np.concatenate([np.linspace(-3, 3, 4001), [0.5, -0.5, 1.5, 123456.25, np.nan, np.inf]])
    got = M.cosines(turns.reshape(-1, 1))[:, 0]
    assert np.allclose(got[:-2], np.cos(2 * np.pi * turns[:-2]), rtol=0, atol=1e-10) and np.isnan(got[-2:]).all()
    assert np.allclose(got[:4001], np.cos(2 * np.pi * turns[:4001]), rtol=0, atol=1e-14)


def all_distances(x: np.ndarray) -> np.ndarray:
    gap = x[:, None, :] - x[None, :, :]
    return np.sqrt((gap * gap).sum(axis=2))[np.triu_indices(len(x), 1)]


def test_intra_diversity_is_of_all_pairs(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(50, [1, 7], (300, 2))
    x[0] = [80, 300]  # far from all others
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "k long, x double, y double")
    d = all_distances(x / x.std(axis=0))
    f = facts(D.intra_diversity(Pair(df, df, key="k")))
    for name, want in (("mean_pairwise_distance", d.mean()), ("std_pairwise_distance", d.std()), ("min_pairwise_distance", d.min()),
                       ("max_pairwise_distance", d.max()), ("diversity_score", d.mean())):
        assert f[("intra_diversity", None, name)] == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("dims", [1, 2, 3, 9])
@pytest.mark.parametrize("twice", [False, True])
def test_pair_distances_by_blocks_and_by_nodes(spark, dims, twice):
    rng = np.random.default_rng(dims)
    x = np.concatenate([rng.normal(0, 1, (200, dims)), rng.uniform(5, 9, (150, dims))])
    x = np.concatenate([x, x[:40]]) if twice else x
    cols = ["w", "code", *(f"c{i}" for i in range(7))][:dims]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{c} double" for c in cols))
    d = all_distances(x)
    want = (d.mean(), d.std(), d.min(), d.max())
    for ways in ({}, {"block_rows": 64}, {"expand_rows": 10}):
        got = pairwise.pair_distances(df, cols, **ways)
        assert (got.mean, got.std, got.lo, got.hi) == pytest.approx(want, rel=1e-8, abs=1e-8)


def test_pair_distances_of_few_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0), (4.0, 6.0), (4.0, 6.0)], "x double, y double")
    zero = pairwise.Distances()
    assert pairwise.pair_distances(df.limit(0), ["x", "y"]) == zero == pairwise.pair_distances(df.limit(1), ["x", "y"])
    assert pairwise.pair_distances(df.where("x = 4"), ["x", "y"]) == zero
    got = pairwise.pair_distances(df, ["x", "y"])
    assert (got.mean, got.lo, got.hi) == pytest.approx((10 / 3, 0, 5)) and got.std == pytest.approx(np.std([5, 5, 0]))


def test_corners_hold_the_largest_distance(spark, monkeypatch):
    rng = np.random.default_rng(6)
    turn = rng.uniform(0, 2 * np.pi, 500)
    for x in (rng.normal(size=(2000, 2)), np.stack([np.cos(turn), np.sin(turn)], axis=1), rng.integers(0, 9, (500, 2)).astype(float),
              np.stack([np.arange(100.0), 2 * np.arange(100.0)], axis=1), np.array([[1.0, 2.0]]), np.zeros((70, 2)) + [[3.0, 1.0]]):
        ends = pairwise.corners(x)
        assert len(ends) <= len(np.unique(x, axis=0))
        assert max(all_distances(ends), default=0.0) == pytest.approx(all_distances(x).max(initial=0.0), rel=1e-12)
    monkeypatch.setattr(pairwise, "CORNERS", 10)  # they meet in blocks then
    ring = spark.createDataFrame([(float(np.cos(t)), float(np.sin(t)) * 2) for t in turn], "x double, y double")
    got = pairwise.pair_distances(ring, ["x", "y"], expand_rows=10, block_rows=64)
    d = all_distances(np.stack([np.cos(turn), 2 * np.sin(turn)], axis=1))
    assert (got.mean, got.std, got.lo, got.hi) == pytest.approx((d.mean(), d.std(), d.min(), d.max()), rel=1e-8)
