"""Kernels against brute force on small hand-made tables, with every large-data path forced."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from twinlens import Pair
from twinlens.functions.gaussian import normal_cdf_sql, normal_ppf_sql
from twinlens.functions.pvalue import exact_pvalue
from twinlens.operators import clusters as C
from twinlens.operators import distance_sums as D
from twinlens.operators import neighbors as N
from twinlens.operators import ranking as R
from twinlens.operators.classes import within_class_bins


def cloud(n: int, hot: int, seed: int = 0) -> pd.DataFrame:
    """Rounded normal points of which the first ``hot`` are identical."""
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 2)
    x[:hot] = x[0]
    out = pd.DataFrame(x, columns=["a", "b", "c"])
    out["row_id"], out["y"] = np.arange(n), (rng.random(n) > 0.7).astype(int)
    return out


SCALE = [1.0, 2.0, 0.5]


def brute(q: pd.DataFrame, b: pd.DataFrame, k: int, same: bool, skip: bool):
    d = np.sqrt(N.squared_distances(q[["a", "b", "c"]].to_numpy(), b[["a", "b", "c"]].to_numpy(), tuple(SCALE)))
    if same:
        d[q.y.to_numpy()[:, None] != b.y.to_numpy()[None]] = np.inf
    if skip:
        d[q.row_id.to_numpy()[:, None] == b.row_id.to_numpy()[None]] = np.inf
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    return order, np.take_along_axis(d, order, 1), d


@pytest.mark.parametrize("path", [{}, {"broadcast_rows": 0, "leaf_rows": 64}])
@pytest.mark.parametrize("k,same,skip", [(1, False, False), (3, True, False), (4, True, True)])
def test_nearest_is_exact(spark, path, k, same, skip):
    b = cloud(1500, 500)
    q = b if skip else cloud(400, 0, 5)
    got = N.nearest(spark.createDataFrame(q), spark.createDataFrame(b), ["a", "b", "c"], SCALE, k,
                    same="y" if same else None, skip_self=skip, **path).toPandas().sort_values(["qid", "rank"])
    ids, dist, _ = brute(q, b, k, same, skip)
    assert (got.bid.to_numpy().reshape(-1, k) == ids).all()
    assert np.allclose(got.dist.to_numpy().reshape(-1, k), dist)


def test_hot_leaf_is_salted_and_blocked(spark, monkeypatch):
    monkeypatch.setattr(N, "GROUP_QUERIES", 50)
    monkeypatch.setattr(N, "BLOCK_ROWS", 100)
    monkeypatch.setattr(N.LocalIndex, "CELL", 16)
    b, q = cloud(2000, 0), cloud(600, 300, 3)
    got = N.nearest(spark.createDataFrame(q), spark.createDataFrame(b), ["a", "b", "c"], SCALE, 2,
                    broadcast_rows=0, leaf_rows=256).toPandas().sort_values(["qid", "rank"])
    ids, _, _ = brute(q, b, 2, False, False)
    assert (got.bid.to_numpy().reshape(-1, 2) == ids).all()


@pytest.mark.parametrize("path", [{}, {"broadcast_rows": 0, "leaf_rows": 64}])
def test_count_within_is_exact(spark, path):
    b, q = cloud(1500, 500), cloud(400, 100, 5)
    got = N.count_within(spark.createDataFrame(q), spark.createDataFrame(b), ["a", "b", "c"], SCALE, 0.7,
                         **path).toPandas().sort_values("qid")
    assert (got.n.to_numpy() == (brute(q, b, 1, False, False)[2] <= 0.7).sum(1)).all()


def test_fewer_base_rows_than_k(spark):
    b = spark.createDataFrame([(1, 0.0), (2, 3.0)], "row_id bigint, a double")
    got = N.nearest(b, b, ["a"], [1.0], 5, skip_self=True).orderBy("qid").collect()
    assert [(r.qid, r.bid, r.dist) for r in got] == [(1, 2, 3.0), (2, 1, 3.0)]


@pytest.mark.parametrize("per_bucket", [None, 40])
def test_ecdf_counts_and_distances(spark, per_bucket):
    rng = np.random.default_rng(1)
    o, a = np.round(rng.normal(size=900), 1), np.round(rng.normal(0.3, 1, size=500), 1)
    o[:300] = 0.0  # a third of the rows share one value
    pair = Pair(spark.createDataFrame(pd.DataFrame({"x": o})), spark.createDataFrame(pd.DataFrame({"x": a})))
    from twinlens.operators.fidelity import distribution_gaps

    row = distribution_gaps(R.ecdf(pair, per_bucket)).first()
    grid = np.unique(np.concatenate([o, a]))
    fo, fa = [np.searchsorted(np.sort(v), grid, side="right") / len(v) for v in (o, a)]
    assert row["d"] == pytest.approx(np.abs(fo - fa).max())
    assert row["w"] == pytest.approx((np.abs(fo - fa)[:-1] * np.diff(grid)).sum())


def test_exact_quantiles_paths_agree(spark):
    rng = np.random.default_rng(2)
    v = np.round(rng.normal(size=3001), 2)
    df = spark.createDataFrame(pd.DataFrame({"x": v, "y": np.repeat(5.0, 3001)}))
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]
    for kw in ({}, {"small_rows": 0}, {"small_rows": 0, "rows_per_bucket": 100}):
        got = R.exact_quantiles(df, ["x", "y"], probs, {"x": 3001, "y": 3001}, **kw)
        assert np.allclose(got["x"], np.quantile(v, probs)) and set(got["y"]) == {5.0}


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_row_numbers_are_gap_free_and_stable(spark, parts):
    df = spark.createDataFrame(cloud(2000, 700)).repartition(parts)
    for order, by in ((None, None), ("row_id", None), ("row_id", ["y"])):
        got = R.row_number_global(df, order, "n", by=by, rows_per_bucket=150).toPandas()
        groups = got.groupby("y") if by else [(0, got)]
        for _, g in groups:
            assert sorted(g.n) == list(range(len(g)))
            if order:
                assert (g.sort_values("n").row_id.diff().dropna() > 0).all()


def test_row_number_over_text(spark):
    words = [f"w{i * 37 % 100:02d}" for i in range(100)]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = R.row_number_global(df, "w", "n", rows_per_bucket=10).orderBy("n").toPandas()
    assert list(got.w) == sorted(words) and list(got.n) == list(range(100))


def test_lookup_intervals_with_a_wide_one(spark):
    iv = spark.createDataFrame([("a", 0, 5), ("b", 5, 4000), ("c", 4000, 4001), ("none", 4001, 4001)], "k string, s bigint, e bigint")
    pts = spark.createDataFrame([(p,) for p in (0, 4, 5, 300, 3999, 4000)], "p bigint")
    got = {r.p: r.k for r in R.lookup_intervals(pts, "p", iv, "s", "e").collect()}
    assert got == {0: "a", 4: "a", 5: "b", 300: "b", 3999: "b", 4000: "c"}


@pytest.mark.parametrize("per_bucket", [None, 30])
def test_within_class_bins_match_pandas_qcut(spark, per_bucket):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.integers(0, 8, 600), "v": np.round(rng.exponential(2, 600), 1)})
    pdf.loc[pdf.g == 1, "v"] = 7.0  # constant class
    pdf.loc[pdf.g == 2, "v"] = pdf.v[pdf.g == 2].round()  # heavy ties
    pdf = pd.concat([pdf, pd.DataFrame({"g": [99], "v": [1.5]})])  # one row
    got = within_class_bins(spark.createDataFrame(pdf), ["g"], "v", len(pdf), 10, per_bucket).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        bins = pd.qcut(part.v, q=min(10, max(2, len(part))), duplicates="drop").astype(str).value_counts()
        p = bins / bins.sum()
        assert got.distinct_bins[g] == len(bins)
        assert got.entropy_bits[g] == pytest.approx(-(p * np.log2(p)).sum(), abs=1e-9)


@pytest.mark.parametrize("path", [{}, {"broadcast_rows": 0, "block_rows": 60}])
def test_silhouette_against_definition(spark, path):
    pdf = cloud(240, 20, 9)
    pdf["label"] = pdf.row_id % 3
    pdf.loc[239, "label"] = 7  # singleton cluster
    d = np.sqrt(N.squared_distances(pdf[["a", "b"]].to_numpy(), pdf[["a", "b"]].to_numpy(), (1.0, 1.0)))
    want = []
    for i, label in enumerate(pdf.label):
        own = (pdf.label == label).to_numpy()
        if own.sum() == 1:
            want.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, (pdf.label == x).to_numpy()].mean() for x in set(pdf.label) - {label})
        want.append((b - a) / max(a, b))
    got = C.silhouette(spark.createDataFrame(pdf), ["a", "b"], **path).orderBy("row_id").toPandas()
    assert np.allclose(got.s, want)


def test_gaussian_expressions(spark):
    row = spark.range(1).select(F.expr(normal_cdf_sql("1.96e0")), F.expr(normal_ppf_sql("9.75e-1")),
                                F.expr(normal_cdf_sql("-9e0")), F.expr(normal_ppf_sql("1e-3"))).first()
    assert row[0] == pytest.approx(0.9750021048517795, abs=1e-12)
    assert row[1] == pytest.approx(1.959963984540054, abs=1e-8)
    assert row[2] == pytest.approx(1.1285884059538408e-19, rel=1e-6)
    assert row[3] == pytest.approx(-3.090232306167813, abs=1e-8)


def test_exact_pvalue_by_path_counting():
    import math

    def count(d, n, m):
        reach = round(d * math.lcm(n, m))
        paths = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n + 1):
            for j in range(m + 1):
                if abs(i * (math.lcm(n, m) // n) - j * (math.lcm(n, m) // m)) < reach:
                    paths[i][j] = 1 if i == j == 0 else (paths[i - 1][j] if i else 0) + (paths[i][j - 1] if j else 0)
        return 1 - paths[n][m] / math.comb(n + m, n)

    for n, m, gap in ((5, 7, 14), (10, 10, 30), (30, 50, 30), (200, 300, 30)):
        d = gap / math.lcm(n, m)
        assert exact_pvalue(d, n, m) == pytest.approx(count(d, n, m), abs=1e-10)


@pytest.mark.parametrize("order", ["name", None])
def test_numbering_spreads_hot_keys(spark, order):
    from twinlens.operators.ranking import _range_buckets, row_number_global

    if order:
        df = spark.range(3000).selectExpr("concat('Customer#', lpad(id * 7919 % 3000, 9, '0')) AS name", "id % 5 AS g")
    else:  # one row content makes up half the table
        df = spark.range(3000).selectExpr("if(id % 2 = 0, 'same', cast(id AS string)) AS name", "id % 1 AS g")
    cut, several = _range_buckets(df.selectExpr("*", "name AS __order" if order else "xxhash64(name, g) AS __order"), order is None, 3000, 200)
    sizes = [r["count"] for r in cut.groupBy("__axis__b").count().collect()]
    assert several and len(sizes) >= 12 and max(sizes) < 600
    got = row_number_global(df, order, "n", n_rows=3000, rows_per_bucket=200).toPandas()
    assert sorted(got["n"]) == list(range(3000))
    if order:
        assert (got.sort_values("name")["n"].to_numpy() == np.arange(3000)).all()
        per = row_number_global(df, order, "n", by=["g"], n_rows=3000, rows_per_bucket=200).toPandas()
        for _, part in per.groupby("g"):
            assert (part.sort_values("name")["n"].to_numpy() == np.arange(len(part))).all()
    else:
        whole = row_number_global(df, None, "n", n_rows=3000).toPandas()
        assert sorted(map(tuple, whole[["name", "n"]].to_numpy())) == sorted(map(tuple, got[["name", "n"]].to_numpy()))


def mixed_rows(n: int, seed: int, kinds: int) -> pd.DataFrame:
    """Rows with two numbers and two categorical points, a third of them between two categories."""
    rng = np.random.default_rng(seed)
    out = pd.DataFrame({"row_id": np.arange(n), "a": rng.normal(size=n).round(1), "b": rng.normal(size=n).round(1), "y": rng.integers(0, 3, n)})
    for c in ("u", "v"):
        one, two = rng.integers(0, kinds, n), rng.integers(0, kinds, n)
        w = np.where(rng.random(n) < 0.35, rng.random(n).round(2), 0.0)
        out[c] = [(f"k{i}" if i else None, f"k{j}" if j else None, float(x)) for i, j, x in zip(one, np.where(w > 0, two, one), w)]
    return out


def one_hot(pdf: pd.DataFrame, kinds: int) -> np.ndarray:
    number = lambda v: 0 if v is None else int(v[1:])
    blocks = [pdf[["a", "b"]].to_numpy()]
    for c in ("u", "v"):
        block = np.zeros((len(pdf), kinds))
        for r, (x, y, w) in enumerate(pdf[c]):
            block[r, number(x)] += 1 - w
            block[r, number(y)] += w
        blocks.append(block)
    return np.hstack(blocks)


@pytest.mark.parametrize("path", [{}, {"broadcast_rows": 0, "leaf_rows": 60}])
def test_categories_are_as_far_apart_as_one_hot_columns(spark, path):
    kinds = 6
    base, query = mixed_rows(500, 1, kinds), mixed_rows(120, 2, kinds)
    schema = "row_id long, a double, b double, y int, u struct<a:string,b:string,w:double>, v struct<a:string,b:string,w:double>"
    frames = [spark.createDataFrame([tuple(r) for r in p.itertuples(index=False)], schema) for p in (query, base)]
    for same in (None, "y"):
        got = N.nearest(*frames, ["a", "b"], [1.0, 1.0], 4, cats=["u", "v"], same=same, **path).toPandas().sort_values(["qid", "rank"])
        d = np.sqrt(((one_hot(query, kinds)[:, None] - one_hot(base, kinds)[None]) ** 2).sum(axis=2))
        if same:
            d[query.y.to_numpy()[:, None] != base.y.to_numpy()[None]] = np.inf
        assert np.allclose(got.dist.to_numpy().reshape(-1, 4), np.sort(d, axis=1)[:, :4], atol=1e-6)
        chosen = d[got.qid.to_numpy(), got.bid.to_numpy()]
        assert np.allclose(chosen, got.dist, atol=1e-6)


def test_pivots_leave_few_leaves_to_visit_in_eight_dimensions(spark):
    """Gathered points of eight dimensions: the second pass visits under a third of the leaves, and the join stays exact."""
    rng = np.random.default_rng(12)
    cols = [f"x{i}" for i in range(8)]
    x = rng.normal(size=(40, 8))[rng.integers(0, 40, 8000)] * 2 + rng.normal(size=(8000, 8)) * 0.5
    pdf = pd.DataFrame(x, columns=cols)
    pdf["row_id"] = np.arange(len(pdf))
    base, query = spark.createDataFrame(pdf), spark.createDataFrame(pdf.iloc[::20])
    got = N.nearest(query, base, cols, [1.0] * 8, 3, skip_self=True, broadcast_rows=0, leaf_rows=100).toPandas().sort_values(["qid", "rank"])
    d = ((x[::20, None] - x[None]) ** 2).sum(axis=2)
    d[np.arange(400), np.arange(0, 8000, 20)] = np.inf
    assert (got.bid.to_numpy().reshape(-1, 3) == np.argsort(d, axis=1)[:, :3]).all()
    spec = N.search_spec([1.0] * 8, 3, skip_self=True)
    lean = N.lean_base(spec, N._side(base, "row_id", "bid", cols, None, None))
    leaves = N._plan_leaves(spec, lean, 8000, 100)
    first = N.home_pass(spec, N._side(query, "row_id", "qid", cols, None, None), lean, leaves).toPandas()
    assert leaves.n > 40 and len(first) == 400
    visited = {}
    for name, pivots in (("pivots", leaves.pivots), ("boxes", leaves.pivots[:0])):
        leaves.pivots = pivots
        visited[name] = len(N._elsewhere(leaves, first)[0]) / (len(first) * leaves.n)
    assert visited["pivots"] < 1 / 3 and visited["pivots"] <= visited["boxes"]


def test_silhouette_sums_few_pairs_of_separate_clusters(spark):
    rng = np.random.default_rng(13)
    label = rng.integers(0, 8, 1200)
    x = rng.normal(size=(8, 3))[label] * 6 + rng.normal(size=(1200, 3))
    pdf = pd.DataFrame({"row_id": range(1200), "label": label, "a": x[:, 0], "b": x[:, 1], "c": x[:, 2]})
    df = spark.createDataFrame(pdf)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    means = np.array([d[:, label == c].sum(axis=1) for c in range(8)]).T
    sizes = np.bincount(label)
    own = means[np.arange(1200), label] / (sizes[label] - 1)
    others = means / sizes
    others[np.arange(1200), label] = np.inf
    want = (others.min(axis=1) - own) / np.maximum(own, others.min(axis=1))
    for path in ({}, {"broadcast_rows": 0, "block_rows": 70}):
        got = C.silhouette(df, ["a", "b", "c"], **path).orderBy("row_id").toPandas()
        assert np.allclose(got.s, want)
    known = C.cluster_facts(df, ["a", "b", "c"])
    summed = (known.wanted(x, label) * sizes[None, :]).sum()
    assert summed < 0.5 * 1200**2


@pytest.mark.parametrize("cols", [["a"], ["a", "b"]])
def test_silhouette_by_node_weights(spark, monkeypatch, cols):
    rng = np.random.default_rng(21)
    pdf = pd.DataFrame({"row_id": range(4000), "a": np.round(rng.standard_cauchy(4000), 2), "b": rng.integers(0, 9, 4000) * 1.0})
    pdf.loc[:600, ["a", "b"]] = [0.5, 3.0]
    pdf["label"] = rng.integers(0, 4, 4000)
    pdf.loc[7, "label"] = 9  # alone
    df = spark.createDataFrame(pdf)
    want = C.silhouette(df, cols).orderBy("row_id").toPandas()
    monkeypatch.setattr(C, "EXPAND_ROWS", 100)
    monkeypatch.setattr(D, "LEAF_POINTS", 40)
    got = C.silhouette(df, cols).orderBy("row_id").toPandas()
    assert list(got.row_id) == list(want.row_id) and list(got.label) == list(want.label)
    assert np.allclose(got.s, want.s, atol=1e-9) and got.s[7] == 0.0
    assert C.mean_silhouette(df, cols).first()[0] == pytest.approx(want.s.mean(), abs=1e-9)
    assert {r.s for r in C.silhouette(df.withColumn("label", F.lit(1)), cols).collect()} == {0.0}


def test_mean_silhouette_counts_repeated_ids_once(spark, monkeypatch):
    pdf = cloud(500, 20, 3)
    pdf["label"] = pdf.row_id % 3
    df = spark.createDataFrame(pd.concat([pdf, pdf[100:250]]))
    want = C.silhouette(df, ["a", "b"]).orderBy("row_id").toPandas()
    monkeypatch.setattr(C, "EXPAND_ROWS", 100)
    got = C.silhouette(df, ["a", "b"]).orderBy("row_id").toPandas()
    assert len(got) == 500 and np.allclose(got.s, want.s)
    assert C.mean_silhouette(df, ["a", "b"]).first()[0] == pytest.approx(want.s.mean())


@pytest.mark.parametrize("kind", ["uniform", "heavy tails"])
def test_distance_sums_meet_few_points_one_by_one(kind):
    rng = np.random.default_rng(6)
    met = []
    for n in (4000, 16000):
        x = rng.random((n, 2)) if kind == "uniform" else rng.standard_cauchy((n, 2))
        weight = np.eye(3)[rng.integers(0, 3, n)]
        tree = D.Tree(x[::4], n // 50)
        at = tree.located(x)
        rows = {leaf: np.flatnonzero(at == leaf) for leaf in np.unique(at)}
        box = [(x[r].min(axis=0), x[r].max(axis=0)) for r in rows.values()]
        tree.describe(np.array(list(rows)), *np.array(box).transpose(1, 0, 2), np.stack([D.basis(x[r], *b).T @ weight[r] for r, b in zip(rows.values(), box)]))
        met.append(0)
        for leaf, r in rows.items():
            far, half, near = tree.meets(leaf)
            close = np.concatenate([rows[i] for i in near])
            met[-1] += len(r) * len(close)
            if leaf % 20 == 0:
                got = tree.away(leaf, x[r], far, half) + D.summed(x[r], x[close], weight[close])
                assert np.allclose(got, D.summed(x[r], x, weight), rtol=1e-9)
    assert met[1] < 6 * met[0] and met[1] < 0.2 * 16000**2  # four times the points; all pairs would be 16 times as many


def test_many_columns_take_matrix_products(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(700, 12)) + 1000, np.full((40, 12), 1000.5)])
    x[600:640] = x[:40] + 1e-9  # very close, and equal rows
    x[640:660] = x[:20]
    cols = [f"x{i}" for i in range(12)]
    pdf = pd.DataFrame(x, columns=cols).assign(row_id=range(740), label=rng.integers(0, 3, 740))
    df = spark.createDataFrame(pdf)
    d = np.sqrt(N.squared_distances(x, x, (1.0,) * 12))
    assert np.allclose(C._sums(x, x), d.sum(axis=1), rtol=1e-9)
    monkeypatch.setattr(N, "MANY_VISITS", 2)
    plans, plan = [], N._plan_leaves
    monkeypatch.setattr(N, "_plan_leaves", lambda *a: plans.append(a[3]) or plan(*a))
    got = N.nearest(df, df, cols, [1.0] * 12, 3, skip_self=True, broadcast_rows=0, leaf_rows=30).orderBy("qid", "rank").toPandas()
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, :3]
    assert np.array_equal(got.bid.to_numpy().reshape(-1, 3), order)
    assert np.allclose(got.dist.to_numpy().reshape(-1, 3), np.take_along_axis(d, order, 1), rtol=1e-12, atol=0)
    assert len(plans) == 2 and plans[1] > 30  # most leaves are visited, so they were made larger


def test_silhouette_block_salts_and_one_cluster(spark, monkeypatch):
    monkeypatch.setattr(C, "GROUP_ROWS", 30)
    pdf = cloud(300, 50, 4)
    pdf["label"] = pdf.row_id % 2
    df = spark.createDataFrame(pdf)
    some = C.silhouette(df, ["a", "b"]).orderBy("row_id").toPandas().s
    assert np.allclose(C.silhouette(df, ["a", "b"], broadcast_rows=0, block_rows=40).orderBy("row_id").toPandas().s, some)
    assert {r.s for r in C.silhouette(df.withColumn("label", F.lit(1)), ["a", "b"]).collect()} == {0.0}


@pytest.mark.parametrize("n_clusters, block", [(7, 4096), (2500, 900)])
def test_davies_bouldin_has_no_bound_on_clusters(spark, n_clusters, block):
    rng = np.random.default_rng(14)
    label = np.concatenate([np.arange(n_clusters), rng.integers(0, n_clusters, 2 * n_clusters)])
    x = rng.normal(size=(n_clusters, 2))[label] * 20 + rng.normal(size=(len(label), 2))
    pdf = pd.DataFrame({"label": label, "a": x[:, 0], "b": x[:, 1]})
    centre = pdf.groupby("label")[["a", "b"]].mean().to_numpy()
    s = np.sqrt(((x - centre[label]) ** 2).sum(axis=1))
    s = np.bincount(label, s) / np.bincount(label)
    gap = np.sqrt(((centre[:, None] - centre[None]) ** 2).sum(axis=2))
    np.fill_diagonal(gap, np.inf)
    want = ((s[:, None] + s[None]) / gap).max(axis=1).mean()
    assert C.davies_bouldin(spark.createDataFrame(pdf), ["a", "b"], pair_rows=block).first()[0] == pytest.approx(want)


def test_long_passes_use_all_cores(spark, tmp_path):
    from twinlens.session import SPREAD_ROWS, spread

    n = SPREAD_ROWS
    spark.range(n).coalesce(1).write.parquet(str(tmp_path / "one"))
    few = spark.read.parquet(str(tmp_path / "one"))
    dealt = spread(few, n)
    assert few.rdd.getNumPartitions() == 1 and dealt.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted(r.id for r in dealt.collect()) == list(range(n))
    assert spread(few, n - 1) is few


def test_metrics_are_built_side_by_side(spark):
    from threading import Barrier

    from twinlens.session import materialize_all

    met = Barrier(2)

    def made(x):
        met.wait(60)  # breaks where one is built after the other
        return spark.range(1).select(F.lit(x).alias("x"))

    got = materialize_all([lambda: made("a"), lambda: made("b"), spark.range(1).select(F.lit("c").alias("x"))])
    assert sorted(r.x for r in got.collect()) == ["a", "b", "c"]
