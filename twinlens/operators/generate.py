"""Synthetic tables: DataFrame in, DataFrame out.

Randomness is a hash of (seed, stream, synthetic row number): a run gives the same rows
on any cluster and after any retry. Picking original rows is an equi-join on a gap-free
row number, never a collect.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinlens.facts import number, single_facts
from twinlens.functions.gaussian import normal_cdf, normal_ppf
from twinlens.functions.hashing import hash_index, hash_normal, hash_uniform
from twinlens.operators.gram import covariances, gram
from twinlens.operators.ranking import (
    add_buckets,
    bucket_splits,
    lookup_intervals,
    row_number_global,
    running_counts,
)
from twinlens.operators.summaries import collect_stats, feature_stats
from twinlens.pair import double_or_null, numeric_columns
from twinlens.session import materialize

SID = "sid"  # synthetic row number
IDX = "__idx"  # original row number
WIDE = 16  # columns above which rows are mixed by a matrix product
TINY = 1e-6  # fixed value: deviation of the noise on duplicated rows


@dataclass
class Table:
    """An original table with numbered rows. ``key`` fixes the order and is not generated."""

    df: DataFrame
    key: str | None = None
    target: str | None = None
    columns: list[str] = field(default_factory=list)
    n: int = 0

    def __post_init__(self) -> None:
        self.columns = self.columns or [c for c in self.df.columns if c != self.key]
        self.target = self.target or self.columns[-1]
        self.n = self.n or self.df.count()
        source = self.df.select(*self.columns, *([self.key] if self.key else []))
        self.rows = row_number_global(source, self.key, IDX, n_rows=self.n).select(IDX, *self.columns)

    @property
    def numeric(self) -> list[str]:
        num = set(numeric_columns(self.df))
        return [c for c in self.columns if c in num]

    @property
    def other(self) -> list[str]:
        num = set(self.numeric)
        return [c for c in self.columns if c not in num]

    def type_of(self, name: str) -> T.DataType:
        return self.df.schema[name].dataType


def numbered(t: Table, n: int) -> DataFrame:
    return t.df.sparkSession.range(n).withColumnRenamed("id", SID)


def finish(df: DataFrame, t: Table, keep_id: bool) -> DataFrame:
    return df.select(*([SID] if keep_id else []), *t.columns)


def random_sampling(t: Table, n: int, seed: int = 42, keep_id: bool = False) -> DataFrame:
    """Exactly n rows with replacement."""
    pick = numbered(t, n).withColumn(IDX, hash_index(seed, "pick", F.col(SID), t.n))
    return finish(pick.join(t.rows, IDX), t, keep_id)


def draw_columns(df: DataFrame, t: Table, cols: list[str], seed: int) -> DataFrame:
    """Add each column as an independent draw by row frequency."""
    for c in cols:
        df = (df.withColumn("__pick", hash_index(seed, f"draw.{c}", F.col(SID), t.n))
              .join(t.rows.select(F.col(IDX).alias("__pick"), c), "__pick").drop("__pick"))
    return df


def noise_injection(t: Table, n: int, seed: int = 42, noise_level: float = 0.1, keep_id: bool = False) -> DataFrame:
    """Sampled rows plus normal noise of ``noise_level`` deviations of the sampled column."""
    sample = random_sampling(t, n, seed, keep_id=True)
    if not t.numeric:
        return finish(sample, t, keep_id)
    spread = {c: s["std_samp"] or 0.0 for c, s in collect_stats(sample, t.numeric).items()}
    noisy = sample.withColumns({
        c: F.col(c).cast("double") + F.lit(spread[c] * noise_level) * hash_normal(seed, f"noise.{c}", F.col(SID))
        for c in t.numeric})
    return finish(noisy, t, keep_id)


def kde_sampling(t: Table, n: int, seed: int = 42, keep_id: bool = False) -> DataFrame:
    """Gaussian kernel density with Scott's bandwidth: a picked row plus kernel noise."""
    if not t.numeric:
        return random_sampling(t, n, seed, keep_id)
    d = len(t.numeric)
    width = t.n ** (-1.0 / (d + 4))
    spread = {c: s["std_pop"] or 1.0 for c, s in collect_stats(t.rows, t.numeric).items()}
    centre = (numbered(t, n).withColumn(IDX, hash_index(seed, "pick", F.col(SID), t.n))
              .join(t.rows.select(IDX, *t.numeric), IDX))
    smooth = centre.withColumns({
        c: F.col(c).cast("double") + F.lit(width * spread[c]) * hash_normal(seed, f"kernel.{c}", F.col(SID))
        for c in t.numeric})
    return finish(draw_columns(smooth, t, t.other, seed), t, keep_id)


def covariance(df: DataFrame, cols: list[str], means: list[float] | None = None) -> np.ndarray:
    """Sample covariance matrix over pairwise complete rows; one pass, d x d numbers come back. ``means`` keep sums small."""
    found = gram(df, cols, shift=means).get(None)
    return covariances(*found, sample=True) if found else np.zeros((len(cols), len(cols)))


def _factor(cov: np.ndarray) -> np.ndarray:
    """Lower triangular factor of a covariance that may be singular."""
    d = len(cov)
    low = np.zeros_like(cov)
    for i in range(d):
        for j in range(i + 1):
            rest = cov[i, j] - low[i, :j] @ low[j, :j]
            if i == j:
                low[i, j] = np.sqrt(max(rest, 0.0))
            else:
                low[i, j] = rest / low[j, j] if low[j, j] > 1e-12 else 0.0
    return low


def correlated_normals(df: DataFrame, cols: list[str], low: np.ndarray, centre: list[float], seed: int) -> DataFrame:
    """Add one column per name: centre + low @ independent normals of the row."""
    df = df.withColumns({f"__z{i}": hash_normal(seed, f"mvn.{i}", F.col(SID)) for i in range(len(cols))})
    names = [f"__z{i}" for i in range(len(cols))]
    if len(cols) > WIDE:  # a matrix product per batch in place of d x d terms

        @F.pandas_udf("array<double>")
        def mixed(z: pd.DataFrame) -> pd.Series:
            return pd.Series(list(z.to_numpy() @ low.T + np.asarray(centre, float)))

        df = df.withColumn("__mixed", mixed(F.struct(*names)))
        return df.withColumns({c: F.col("__mixed")[i] for i, c in enumerate(cols)}).drop(*names, "__mixed")
    out = {}
    for i, c in enumerate(cols):
        terms = (F.lit(float(low[i, j])) * F.col(f"__z{j}") for j in range(i + 1))
        out[c] = sum(terms, F.lit(float(centre[i])))
    return df.withColumns(out).drop(*names)


def gaussian_mvn(t: Table, n: int, seed: int = 42, keep_id: bool = False) -> DataFrame:
    """One multivariate normal with the sample mean and covariance; other columns by frequency.

    Null and NaN cells take no part; a column without any value stays null.
    """
    if not t.numeric:
        return random_sampling(t, n, seed, keep_id)
    values = t.rows.select(*[double_or_null(t.rows, c) for c in t.numeric])
    means = {c: s["mean"] for c, s in collect_stats(values, t.numeric).items()}
    cols = [c for c in t.numeric if means[c] is not None]
    base = numbered(t, n)
    if cols:
        base = correlated_normals(base, cols, _factor(covariance(values, cols, [means[c] for c in cols])), [means[c] for c in cols], seed)
    base = base.withColumns({c: F.lit(None).cast("double") for c in t.numeric if means[c] is None})
    return finish(draw_columns(base, t, t.other, seed), t, keep_id)


def gaussian_copula(t: Table, n: int, seed: int = 42, keep_id: bool = False) -> DataFrame:
    """Normal scores, their covariance, correlated draws, and back through the empirical quantiles.

    Null and NaN cells have no rank: every column is ranked, and drawn, over its own values. A column without any
    value stays null.
    """
    if not t.numeric:
        return random_sampling(t, n, seed, keep_id)
    values = t.rows.select(*[double_or_null(t.rows, c) for c in t.numeric])
    have = dict(zip(t.numeric, values.agg(*[F.count(F.col(c)) for c in t.numeric]).first()))
    cols = [c for c in t.numeric if have[c]]
    if not cols:
        return random_sampling(t, n, seed, keep_id)
    size = F.coalesce(*[F.when(F.col("feature") == c, F.lit(float(have[c]))) for c in cols])
    splits = bucket_splits(values, cols, t.n)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value"),
                                         F.col(c + "__b").alias("bucket")) for c in cols])).alias("cell")
    counts = (add_buckets(values, splits).select(cells).select("cell.*").where(F.col("value").isNotNull())
              .groupBy("feature", "bucket", "value").agg(F.count(F.lit(1)).alias("w")))
    placed = running_counts(counts, ["feature"], "bucket", "value", ["w"], not any(splits.values()))
    # ties share the mean of their ranks
    scores = (placed.withColumn("u", (F.col("w_before") + (F.col("w") + 1) / 2) / (size + 1.0))
              .withColumn("z", normal_ppf("u")).select("feature", "value", "z"))
    scored = values
    for c in cols:
        one = scores.where(F.col("feature") == c).select(F.col("value").alias(c), F.col("z").alias(f"{c}__z"))
        scored = scored.join(one, c, "left")
    low = _factor(covariance(scored, [f"{c}__z" for c in cols]))
    base = correlated_normals(numbered(t, n), cols, low, [0.0] * len(cols), seed)
    base = base.withColumns({f"{c}__h": normal_cdf(c) * F.lit(float(have[c] - 1)) for c in cols})
    ranks = base.select(SID, F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.least(F.floor(f"{c}__h") + shift, F.lit(have[c] - 1)).cast("bigint").alias("rank"),
                 F.lit(shift).alias("upper"), (F.col(f"{c}__h") - F.floor(f"{c}__h")).alias("part"))
        for c in cols for shift in (0, 1)])).alias("p")).select(SID, "p.*")
    found = lookup_intervals(ranks, "rank", placed.select("feature", "value", "w_before", "w_upto"),
                             "w_before", "w_upto", ["feature"])
    def at(c: str, upper: int) -> Column:
        return F.max(F.when((F.col("feature") == c) & (F.col("upper") == upper), F.col("value")))

    wide = found.groupBy(SID).agg(*[
        (at(c, 0) + (at(c, 1) - at(c, 0)) * F.max(F.when(F.col("feature") == c, F.col("part")))).alias(c) for c in cols])
    wide = wide.withColumns({c: F.lit(None).cast("double") for c in t.numeric if not have[c]})
    return finish(draw_columns(wide, t, t.other, seed), t, keep_id)


def dummy(t: Table, n: int, seed: int = 42, keep_id: bool = False) -> DataFrame:
    """Uniform values: integers and doubles between the extremes, else over distinct values, a missing one included.

    A numeric column without any value stays null.
    """
    out = numbered(t, n)
    edges = collect_stats(t.rows.select(*[double_or_null(t.rows, c) for c in t.numeric]), t.numeric) if t.numeric else {}
    for c in t.columns:
        u = hash_uniform(seed, f"dummy.{c}", F.col(SID))
        if c in edges:
            lo, hi = edges[c]["lo"], edges[c]["hi"]
            if lo is None:
                out = out.withColumn(c, F.lit(None).cast(t.type_of(c)))
                continue
            if isinstance(t.type_of(c), T.IntegralType):
                out = out.withColumn(c, (F.floor(u * F.lit(hi - lo + 1.0)) + F.lit(lo)).cast(t.type_of(c)))
            else:
                out = out.withColumn(c, F.lit(lo) + u * F.lit(hi - lo))
            continue
        kinds = t.rows.select(c).distinct()
        m, known = kinds.agg(F.count(F.lit(1)), F.count(F.col(c))).first()
        indexed = row_number_global(kinds.where(F.col(c).isNotNull()), c, "__pick", n_rows=known)
        # the missing value, if there is one, is the last number and has no row to meet
        out = (out.withColumn("__pick", hash_index(seed, f"dummy.{c}", F.col(SID), m))
               .join(indexed, "__pick", "left").drop("__pick"))
    return finish(out, t, keep_id)


def class_allocation(df: DataFrame, label: str, n: int) -> DataFrame:
    """(label, n_rows, n_new): inverse-frequency shares, rounded by largest remainder.

    Classes stay a table: the remainder that decides comes from running counts over the distinct remainders, and only
    classes that share it are ranked by label.
    """
    counts = materialize(df.groupBy(label).agg(F.count(F.lit(1)).alias("n_rows")))
    total, classes = counts.agg(F.sum(F.lit(1.0) / F.col("n_rows")), F.count(F.lit(1))).first()
    raw = (F.lit(1.0) / F.col("n_rows")) / F.lit(total or 1.0) * F.lit(float(n))
    part = counts.withColumn("__raw", raw).withColumn("__base", F.floor("__raw").cast("bigint")).withColumn("__o", -F.round(F.col("__raw") - F.col("__base"), 9))
    left = n - (part.agg(F.sum("__base")).first()[0] or 0)
    given = lambda f, extra: f.select(label, "n_rows", (F.col("__base") + extra.cast("bigint")).alias("n_new"))
    if left <= 0 or left >= classes:
        return given(part, F.lit(int(left >= classes > 0)))
    remainders = part.groupBy("__o").agg(F.count(F.lit(1)).alias("m"))
    splits = bucket_splits(remainders, ["__o"], classes)
    placed = running_counts(add_buckets(remainders, splits).withColumn("one", F.lit(1)), ["one"], "__o__b", "__o", ["m"], not splits["__o"])
    last = placed.where(F.col("m_upto") >= left).orderBy("__o").select("__o", "m", "m_before").first()
    tied = row_number_global(part.where(F.col("__o") == last["__o"]), label, "__r", n_rows=last["m"])
    return given(part.where(F.col("__o") != last["__o"]), F.col("__o") < last["__o"]).unionByName(given(tied, F.col("__r") < left - last["m_before"]))


def exact_rows(df: DataFrame, cols: list[str], n: int, seed: int = 42, id_col: str = SID) -> DataFrame:
    """Exactly n rows: a hashed choice when there are more, noisy duplicates when fewer.

    ``id_col`` is unique; numeric ``cols`` get the tiny noise. The result is renumbered.
    """
    have = df.count()
    names = [c for c in df.columns if c != id_col]
    if have == 0:
        return df
    if have >= n:
        mixed = df.withColumn("__mix", hash_uniform(seed, "cut", F.col(id_col)))
        ranked = row_number_global(mixed, "__mix", "__rank", n_rows=have, tie=[id_col]) if have > n else (
            row_number_global(df, id_col, "__rank", n_rows=have))
        return ranked.where(F.col("__rank") < n).select(F.col("__rank").alias(SID), *names)
    base = row_number_global(df, id_col, "__rank", n_rows=have).drop(id_col)
    extra = (df.sparkSession.range(have, n).withColumnRenamed("id", SID)
             .withColumn("__rank", hash_index(seed, "again", F.col(SID), have)).join(base, "__rank").drop("__rank"))
    extra = extra.withColumns({c: F.col(c) + F.lit(TINY) * hash_normal(seed, f"again.{c}", F.col(SID)) for c in cols})
    return base.withColumnRenamed("__rank", SID).select(SID, *names).unionByName(extra.select(SID, *names))


def synthetic_only(resampled: DataFrame, original: DataFrame, cols: list[str], multiset: bool = True) -> DataFrame:
    """Rows of ``resampled`` whose rounded values are not original ones.

    ``multiset``: every original row cancels one equal row; otherwise all equal rows go.
    """
    def rounded(df: DataFrame) -> DataFrame:
        return df.select(*[F.round(F.col(c).cast("double"), 8).alias(c) for c in cols])

    if multiset:
        return rounded(resampled).exceptAll(rounded(original))
    keys = rounded(original).distinct().select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(cols)])
    match = [F.round(F.col(c).cast("double"), 8).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(cols)]
    condition = match[0]
    for m in match[1:]:
        condition = condition & m
    return resampled.join(keys, condition, "left_anti")


def simple_quality(orig: DataFrame, synth: DataFrame) -> DataFrame:
    """Mean agreement of means and deviations over the original's numeric columns."""
    cols = numeric_columns(orig)
    if not cols:
        return single_facts(orig.sparkSession.range(1), "score", "simple_quality", [number("score", F.lit(0.5))])
    o = feature_stats(orig.select(*[F.col(c).cast("double").alias(c) for c in cols]), cols, ("mean", "std_samp"))
    s = feature_stats(synth.select(*[F.col(c).cast("double").alias(c) for c in cols]), cols, ("mean", "std_samp"))
    both = o.selectExpr("feature", "mean AS m1", "std_samp AS s1").join(
        s.selectExpr("feature", "mean AS m2", "std_samp AS s2"), "feature")
    base = F.col("s1") + F.lit(1e-10)
    part = (F.greatest(F.lit(0.0), 1 - F.abs(F.col("m1") - F.col("m2")) / base)
            + F.greatest(F.lit(0.0), 1 - F.abs(F.col("s1") - F.col("s2")) / base)) / 2
    return single_facts(both.agg(F.avg(part).alias("q")), "score", "simple_quality", [number("score", F.col("q"))])


GENERATORS: dict[str, Callable[..., DataFrame]] = {
    "random_sampling": random_sampling,
    "noise_injection": noise_injection,
    "kde": kde_sampling,
    "gaussian_mvn": gaussian_mvn,
    "bayesian_network": gaussian_mvn,
    "gaussian_copula": gaussian_copula,
    "dummy": dummy,
}


def generator(name: str) -> Callable:
    """Register an own technique: (table, n, seed, **params) -> DataFrame."""
    def wrap(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        GENERATORS[name] = fn
        return fn

    return wrap


def generate(t: Table, technique: str, n: int, seed: int = 42, **params) -> DataFrame:
    import twinlens.operators.oversample  # noqa: F401 - registers the oversampling techniques

    if technique not in GENERATORS:
        raise ValueError(f"unknown technique: {technique}")
    return GENERATORS[technique](t, n, seed, **params)


def run_techniques(t: Table, techniques: list[str], n: int, folder: str, seed: int = 42,
                   params: dict[str, dict] | None = None, fmt: str = "parquet") -> DataFrame:
    """Generate and write each technique on its own; returns the manifest.

    A failing technique leaves its error in the manifest and does not stop the others.
    """
    from twinlens.sources.tables import write_table

    spark, rows = t.df.sparkSession, []
    for name in techniques:
        start = time.time()
        path = f"{folder.rstrip('/')}/technique={name}"
        try:
            df = generate(t, name, n, seed, **(params or {}).get(name, {}))
            write_table(df, path, fmt)
            stored = spark.read.option("header", True).csv(path).count() if fmt == "csv" else spark.read.parquet(path).count()
            rows.append((name, path, stored, len(df.columns), None, time.time() - start))
        except Exception as e:  # noqa: BLE001 - recorded in the manifest
            rows.append((name, None, None, None, str(e)[:300], time.time() - start))
    return spark.createDataFrame(
        rows, "technique string, path string, n_rows bigint, n_columns int, error string, seconds double")
