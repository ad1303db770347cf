"""Generators: exact sizes, reproducibility, ranges and hulls."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from twinlens.operators import generate as G
from twinlens.operators import oversample as O


def people(n: int = 300, seed: int = 0) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    return pd.DataFrame({
        "k": np.arange(n), "age": rng.integers(18, 90, n), "pay": np.round(rng.lognormal(10, 0.5, n), 2),
        "town": rng.choice(["Ayr", "Bex", "Cork"], n, p=[0.6, 0.3, 0.1]), "kind": rng.choice(["a", "b", "c"], n, p=[0.7, 0.2, 0.1])})


@pytest.fixture(scope="module")
def base(spark):
    return G.Table(spark.createDataFrame(people()), key="k")


NAMES = ["random_sampling", "noise_injection", "kde", "gaussian_mvn", "bayesian_network", "gaussian_copula", "dummy", "smote",
         "adasyn", "smotecdnn"]


@pytest.mark.parametrize("name", NAMES)
def test_exact_size_and_columns(base, name):
    df = G.generate(base, name, 457, 11)
    assert df.columns == ["age", "pay", "town", "kind"]
    assert df.count() == 457


@pytest.mark.parametrize("name", ["random_sampling", "kde", "smote"])
def test_same_rows_for_any_partitioning(spark, name):
    seen = []
    for parts in (1, 4, 16):
        t = G.Table(spark.createDataFrame(people()).repartition(parts), key="k")
        got = G.generate(t, name, 80, 5).toPandas().sort_values(["age", "pay", "town", "kind"]).reset_index(drop=True)
        seen.append(got)
    for other in seen[1:]:  # deviations are float sums, so the last bits may differ
        pd.testing.assert_frame_equal(seen[0], other, check_exact=False, rtol=1e-9)


def test_sampled_rows_are_originals(base):
    got = G.random_sampling(base, 500, 3)
    assert got.exceptAll(got.intersect(base.rows.select(*got.columns))).join(
        base.rows, ["age", "pay", "town", "kind"], "left_anti").count() == 0


def test_dummy_stays_in_range(base):
    row = G.dummy(base, 800, 4).agg(F.min("age"), F.max("age"), F.min("pay"), F.max("pay"), F.countDistinct("town")).first()
    p = people()
    assert row[0] >= p.age.min() and row[1] <= p.age.max() and row[2] >= p.pay.min() and row[3] <= p.pay.max() and row[4] == 3


def test_smote_stays_in_class_range_and_keeps_types(base):
    made = O.smote(base, 300, 2)
    assert dict(made.dtypes)["age"] == "bigint" and set(r.town for r in made.select("town").distinct().collect()) <= {"Ayr", "Bex", "Cork"}
    got, p = made.toPandas(), people()
    for kind, part in got.groupby("kind"):
        own = p[p.kind == kind]
        assert part.age.between(own.age.min(), own.age.max()).all() and part.pay.between(own.pay.min(), own.pay.max()).all()
    assert got.kind.value_counts()["c"] > got.kind.value_counts()["a"]  # inverse frequency


def test_smote_corner_classes(spark):
    one = G.Table(spark.createDataFrame(people(40).assign(kind="only")), key="k")
    assert O.smote(one, 25, 1).count() == 25
    p = people(60)
    p["kind"] = ["solo"] + ["many"] * 59
    got = O.smote(G.Table(spark.createDataFrame(p), key="k"), 50, 1)
    assert got.count() == 50
    solo = got.where("kind = 'solo'").toPandas()
    assert len(solo) > 40 and np.allclose(solo.pay, p.pay[0], atol=1e-4)


def test_allocation_sums_up(base):
    got = G.class_allocation(base.rows, "kind", 101).toPandas()
    inv = 1 / got.n_rows
    assert got.n_new.sum() == 101 and (abs(got.n_new - inv / inv.sum() * 101) < 1).all()


def test_covariance_is_kept(base):
    p = people()
    got = G.gaussian_mvn(base, 20000, 9).select("age", "pay").toPandas()
    assert abs(got.age.mean() - p.age.mean()) < 1 and abs(got.age.std() / p.age.std() - 1) < 0.05
    got = G.gaussian_copula(base, 5000, 9).select("age", "pay").toPandas()
    assert got.pay.min() >= p.pay.min() and got.pay.max() <= p.pay.max()
    assert abs(got.pay.median() / p.pay.median() - 1) < 0.05


def _displacement_keep(x: np.ndarray, y: np.ndarray, k: int) -> set[int]:
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    keep = set()
    for i in range(len(x)):
        near = np.argsort(d[i], kind="stable")[:k]
        best = None
        for label in dict.fromkeys(y[near]):
            pts = x[near][y[near] == label]
            moved = np.linalg.norm(pts.mean(0) - (pts.sum(0) + x[i]) / (len(pts) + 1))
            if best is None or moved < best[0] - 1e-9:
                best = (moved, label)
        if best[1] == y[i]:
            keep.add(i)
    return keep


def test_editing_against_definition(spark):
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(150, 2)), rng.integers(0, 3, 150)
    df = spark.createDataFrame(pd.DataFrame({G.IDX: np.arange(150), "a": x[:, 0], "b": x[:, 1], "y": y}))
    want = _displacement_keep(x, y, 5)
    got = {r[0] for r in O.edited(df, ["a", "b"], "y", 5, "cd", "all").select(G.IDX).collect()}
    assert got == want
    counts = np.bincount(y)
    for strategy, spared in (("auto", {counts.argmin()}), ("not majority", {counts.argmax()}),
                             ("majority", set(range(3)) - {counts.argmax()}), ("minority", set(range(3)) - {counts.argmin()})):
        got = {r[0] for r in O.edited(df, ["a", "b"], "y", 5, "cd", strategy).select(G.IDX).collect()}
        assert got == want | {i for i in range(150) if y[i] in spared}
    with pytest.raises(ValueError):
        O.edited(df, ["a", "b"], "y", 5, "cd", "some")


def test_exact_rows_and_difference(spark):
    df = spark.createDataFrame([(i, float(i), "x") for i in range(10)], "sid bigint, v double, w string")
    assert G.exact_rows(df, ["v"], 4).count() == 4 and G.exact_rows(df, ["v"], 10).count() == 10
    more = G.exact_rows(df, ["v"], 33).toPandas()
    assert sorted(more.sid) == list(range(33)) and np.allclose(more.v, more.v.round(), atol=1e-4)
    grown = spark.createDataFrame([(1.0,), (1.0,), (2.0,), (3.5,)], "v double")
    orig = spark.createDataFrame([(1.0,), (2.0,)], "v double")
    assert sorted(r.v for r in G.synthetic_only(grown, orig, ["v"]).collect()) == [1.0, 3.5]
    assert [r.v for r in G.synthetic_only(grown, orig, ["v"], multiset=False).collect()] == [3.5]


def test_decode_prefers_first_on_ties(spark, base):
    e = O.Encoding(["age"], {"town": ["Ayr", "Bex"]}, {"age": base.type_of("age"), "town": base.type_of("town")})
    rows = spark.createDataFrame([(1.9, 0.5, 0.5), (2.0, 0.1, 0.9)], "age double, town__is0 double, town__is1 double")
    assert [(r.age, r.town) for r in O.decode(rows, e, []).collect()] == [(1, "Ayr"), (2, "Bex")]


def test_own_generator_and_manifest(spark, base, tmp_path):
    @G.generator("first_rows")
    def first_rows(t, n, seed=42):
        return t.rows.where(F.col(G.IDX) < n).select(*t.columns)

    got = {r.technique: r for r in G.run_techniques(base, ["first_rows", "dummy", "nope"], 20, str(tmp_path), fmt="csv").collect()}
    assert got["first_rows"].n_rows == 20 and got["dummy"].n_rows == 20 and "unknown technique" in got["nope"].error


def test_adasyn_variants(base):
    assert G.generate(base, "adasyn", 90, 3, pseudo_label=True).count() == 90
    got = O.adasyn(base, 200, 3, label="town").toPandas()
    p = people()
    rare = p[p.town == p.town.value_counts().index[-1]]
    assert len(got) == 200 and got.pay.between(rare.pay.min(), rare.pay.max()).all()


def gaps(spark, kind):
    """Three classes with missing numbers, categories and labels."""
    rng = np.random.default_rng(6)
    rows = []
    for i in range(240):
        x = float(rng.normal() + 3 * (i % 3))
        rows.append((i, None if i % 10 == 0 else float("nan") if i % 10 == 5 and kind != "null" else x, float(rng.normal()),
                     None, int(rng.integers(0, 50)) if i % 7 else None, None if i % 11 == 0 else "ab"[i % 2], None, None if i % 40 == 39 else "xyz"[i % 3]))
    return spark.createDataFrame(rows, "k long, a double, b double, none double, n int, c string, empty string, y string")


@pytest.mark.parametrize("technique", ["random_sampling", "noise_injection", "kde", "gaussian_mvn", "gaussian_copula", "dummy", "smote", "adasyn", "smotecdnn"])
@pytest.mark.parametrize("kind", ["null", "nan"])
def test_missing_values_lose_no_rows(spark, technique, kind):
    from twinlens.operators.generate import Table, generate

    made = generate(Table(gaps(spark, kind), key="k", target="y"), technique, 300, seed=3)
    got = made.toPandas()
    assert len(got) == 300 and made.columns == ["a", "b", "none", "n", "c", "empty", "y"]
    assert got["none"].isna().all() and got["empty"].isna().all()


def test_neighbour_search_leaves_incomplete_rows_out(spark):
    from pyspark.sql import functions as F
    from twinlens.operators.neighbors import count_within, nearest

    rng = np.random.default_rng(7)
    rows = [(i, float(rng.normal()), float(rng.normal())) for i in range(500)]
    rows = [(i, None if i % 9 == 0 else x, float("nan") if i % 9 == 4 else y) for i, x, y in rows]
    df = spark.createDataFrame(rows, "row_id long, x double, y double")
    whole = df.where("x IS NOT NULL").where(~F.isnan("y"))
    for limit in (0, 50_000):
        for search in (lambda d: nearest(d, d, ["x", "y"], [1.0, 1.0], 3, broadcast_rows=limit, leaf_rows=64),
                       lambda d: count_within(d, d, ["x", "y"], [1.0, 1.0], 0.4, broadcast_rows=limit, leaf_rows=64)):
            order = lambda d: sorted(map(tuple, d.collect()))
            assert order(search(df)) == order(search(whole))


def test_points_decode_to_the_heavier_category(spark, base):
    e = O.Points(["age"], ["town"], {"age": base.type_of("age"), "town": base.type_of("town")})
    rows = spark.createDataFrame([(1.9, ("Bex", "Ayr", 0.5)), (2.0, ("Ayr", "Bex", 0.9)), (3.0, ("Ayr", None, 0.4)), (4.0, (None, "Bex", 0.5)), (5.0, (None, None, 0.0))],
                                 "age double, town struct<a:string,b:string,w:double>")
    assert [(r.age, r.town) for r in e.decode(rows, []).collect()] == [(1, "Ayr"), (2, "Bex"), (3, "Ayr"), (4, "Bex"), (5, None)]
    back = e.decode(e.encode(base.rows, [G.IDX]), [G.IDX])
    assert back.exceptAll(base.rows.select(G.IDX, "age", "town")).count() == 0


def test_editing_of_points_equals_one_hot_columns(spark):
    rng = np.random.default_rng(18)
    n, kinds = 140, 4
    x, y = rng.normal(size=(n, 1)), rng.integers(0, 3, n)  # no ties, which rounding would break differently
    one, two, w = rng.integers(0, kinds, n), rng.integers(0, kinds, n), np.where(rng.random(n) < 0.5, rng.random(n), 0.0)
    hot = np.zeros((n, kinds))
    np.add.at(hot, (np.arange(n), one), 1 - w)
    np.add.at(hot, (np.arange(n), two), w)
    rows = [(i, float(x[i, 0]), int(y[i]), (f"k{one[i]}", f"k{two[i]}", float(w[i]))) for i in range(n)]
    df = spark.createDataFrame(rows, f"{G.IDX} long, a double, y int, u struct<a:string,b:string,w:double>")
    got = {r[0] for r in O.edited(df, ["a"], "y", 5, "cd", "all", cats=["u"]).select(G.IDX).collect()}
    assert got == _displacement_keep(np.hstack([x, hot]), y, 5)


def test_thousands_of_categories(spark):
    n = 6000
    rng = np.random.default_rng(19)
    pdf = pd.DataFrame({"k": np.arange(n), "v": rng.normal(size=n), "tag": [f"t{i % 5000}" for i in range(n)], "y": rng.choice(["a", "b"], n, p=[0.8, 0.2])})
    t = G.Table(spark.createDataFrame(pdf), key="k")
    for name in ("smote", "smotecdnn"):
        got = G.generate(t, name, 400, 3).toPandas()
        assert len(got) == 400 and set(got.tag) <= set(pdf.tag) and got.tag.nunique() > 100


@pytest.mark.parametrize("n", [0, 7, 30_000, 123_457])
def test_allocation_over_very_many_classes(spark, n):
    sizes = np.array([1 + (i * i) % 7 for i in range(20_000)])
    df = spark.range(20_000).selectExpr("id", "concat('c', id) AS y").join(
        spark.createDataFrame(pd.DataFrame({"id": np.arange(20_000), "s": sizes})), "id").selectExpr("y", "explode(sequence(1, s)) AS i")
    got = G.class_allocation(df, "y", n).toPandas()
    labels = np.array([f"c{i}" for i in range(20_000)])
    raw = (1.0 / sizes) / (1.0 / sizes).sum() * n
    want = np.floor(raw).astype(int)
    order = np.lexsort((labels, -np.round(raw - np.floor(raw), 9)))
    want[order[: n - want.sum()]] += 1
    assert got.set_index("y").n_new.to_dict() == dict(zip(labels, want.tolist()))
    assert got.n_new.sum() == n


def test_smote_over_many_classes(spark):
    n = 4000
    pdf = pd.DataFrame({"k": np.arange(n), "v": np.arange(n) / 7.0, "y": [f"c{i % 1300}" for i in range(n)]})
    got = O.smote(G.Table(spark.createDataFrame(pdf), key="k"), 2000, 3).toPandas()
    assert len(got) == 2000 and got.y.nunique() > 1200
    span = pdf.groupby("y").v.agg(["min", "max"])
    assert (got.v >= span["min"][got.y].to_numpy() - 1e-4).all() and (got.v <= span["max"][got.y].to_numpy() + 1e-4).all()


def test_wide_tables_and_pairwise_complete_covariance(spark, monkeypatch):
    rng = np.random.default_rng(23)
    pdf = pd.DataFrame(rng.normal(size=(60, 3)) @ rng.normal(size=(3, 3)) + 1e6, columns=["x", "y", "z"])
    pdf.loc[::7, "x"] = np.nan
    pdf.loc[::5, "z"] = np.nan
    df = spark.createDataFrame(pdf).repartition(4)
    assert np.allclose(G.covariance(df, ["x", "y", "z"], [1e6] * 3), pdf.cov().to_numpy())
    t = G.Table(spark.createDataFrame(people(80)), key="k")
    plain = G.gaussian_mvn(t, 50, 4).toPandas()
    monkeypatch.setattr(G, "WIDE", 1)
    pd.testing.assert_frame_equal(G.gaussian_mvn(t, 50, 4).toPandas().sort_values("pay", ignore_index=True), plain.sort_values("pay", ignore_index=True), rtol=1e-9)
    names = [f"c{i}" for i in range(300)]
    wide = spark.createDataFrame(pd.DataFrame(rng.normal(size=(400, 300)), columns=names))
    assert G.gaussian_mvn(G.Table(wide), 20, 1).dropna().count() == 20
