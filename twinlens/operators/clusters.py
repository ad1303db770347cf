"""Cluster labels and cluster-quality measures in Euclidean space."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinlens.operators import distance_sums as D
from twinlens.operators.neighbors import PRODUCT_DIMS, product_distances, squared_distances
from twinlens.pair import ROW_ID, Pair
from twinlens.session import materialize

BROADCAST_ROWS = 8192
BLOCK_ROWS = 16_384  # rows of a cluster in one block
MOST_BLOCKS = 32  # of a table as long as blocks stay below BLOCK_ROWS, one more for each cluster
GROUP_ROWS = 32_768  # rows that ask for a block in one task, on average
PLACED_ROWS = 65_536  # copies of rows one frame holds at most while they are placed
HOT_SHARE = 1000
CLOSE = 1e8  # a matrix product must be right to 1 in so many, else the differences are taken
EXPAND_ROWS = 65_536  # from here on tables of few columns sum distances by node weights
EXPAND_LEAVES = 256  # leaves that must be possible for that
MAX_VALUES = 4_000_000  # bound on cluster facts that go to every task


def cluster_count(n_o: int, n_a: int) -> int:
    return max(2, min(8, n_o // 10, n_a // 10))


def scaled_side(df: DataFrame, pair: Pair, *more: Column) -> DataFrame:
    """Row id, ``more`` columns and metric columns standardised by the original."""
    return df.select(ROW_ID, *more, *[
        ((F.col(c) - F.lit(pair.o_stats[c]["mean"])) / F.lit(s)).alias(c) for c, s in zip(pair.cols, pair.scale)])


def fit_kmeans(scaled: DataFrame, cols: list[str], k: int, seeds: tuple[int, ...] = (42, 43, 44)) -> KMeansModel:
    """Cheapest of several seeded k-means|| runs (deterministic given the seeds)."""
    train = VectorAssembler(inputCols=cols, outputCol="features").transform(scaled).select("features").persist()
    try:
        models = [KMeans(k=k, seed=s, maxIter=50).fit(train) for s in seeds]
        return min(models, key=lambda m: m.summary.trainingCost)
    finally:
        train.unpersist()


def labelled(scaled: DataFrame, cols: list[str], model: KMeansModel) -> DataFrame:
    vectors = VectorAssembler(inputCols=cols, outputCol="features").transform(scaled)
    return model.transform(vectors).select(*scaled.columns, F.col("prediction").alias("label"))


def label_shares(df: DataFrame) -> DataFrame:
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def spread(orig: DataFrame, aug: DataFrame, k: int) -> DataFrame:
    """One row: similarity of the label shares, and evenness of the augmented ones."""
    both = (label_shares(orig).select("label", F.col("n").alias("o"), F.lit(0).alias("a"))
            .unionByName(label_shares(aug).select("label", F.lit(0).alias("o"), F.col("n").alias("a")))
            .groupBy("label").agg(F.sum("o").alias("o"), F.sum("a").alias("a")))
    cells = both.agg(F.collect_list(F.struct("o", "a")).alias("cells"),  # one entry per cluster
                     F.sum("o").cast("double").alias("so"), F.sum("a").cast("double").alias("sa"))
    cell = cells.select(F.explode("cells").alias("c"), "so", "sa")
    p, q = F.col("c.o") / F.col("so"), F.col("c.a") / F.col("sa")
    m = (p + q) / 2

    def part(x: Column) -> Column:
        return F.when(x > 0, x * F.log(x / m)).otherwise(F.lit(0.0))

    # shares are smoothed and renormalised before the entropy
    smooth = (q + F.lit(1e-10)) / F.lit(1.0 + k * 1e-10)
    empty = F.lit(float(k)) - F.count(F.lit(1))
    e0 = 1e-10 / (1.0 + k * 1e-10)
    return cell.agg(
        (1 - F.sqrt(F.greatest((F.sum(part(p)) + F.sum(part(q))) / 2, F.lit(0.0)))).alias("similarity"),
        ((-F.sum(smooth * F.log(smooth)) - empty * F.lit(e0 * float(np.log(e0)))) / F.lit(float(np.log(k))))
        .alias("uniformity"))


@dataclass(frozen=True)
class Clusters:
    """Size, centre and mean squared distance to the centre of every cluster."""

    labels: list
    sizes: np.ndarray
    centres: np.ndarray
    spread: np.ndarray

    def codes(self, labels: pd.Series) -> np.ndarray:
        return labels.map({label: i for i, label in enumerate(self.labels)}).to_numpy(dtype=np.int64)

    def wanted(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Clusters whose mean distance to a row has to be known: its own, and those that can be the nearest other one.

        A row's mean distance to a cluster is at least its distance to the centre, and at most the root of its mean
        squared distance, which is known without a sum; clusters beyond the least such upper bound are out.
        """
        to_centre = squared_distances(x, self.centres, (1.0,) * x.shape[1])
        rows = np.arange(len(x))
        upper = np.sqrt(to_centre + self.spread[None, :])
        upper[rows, own] = np.inf
        out = np.sqrt(to_centre) <= (upper.min(axis=1) * (1 + 1e-9) + 1e-12)[:, None]
        out[rows, own] = True
        return out


def cluster_facts(df: DataFrame, cols: list[str]) -> Clusters:
    """One aggregate pass; their numbers go to every task, so they are bounded."""
    most = MAX_VALUES // (len(cols) + 2)
    rows = centre_table(df, cols).orderBy("label").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} clusters for a silhouette on {len(cols)} columns")
    return Clusters([r["label"] for r in rows], np.array([r["__n"] for r in rows], dtype=float),
                    np.array([r["__centre"] for r in rows]).reshape(len(rows), len(cols)), np.array([r["__spread"] for r in rows]))


def centre_table(df: DataFrame, cols: list[str]) -> DataFrame:
    """(label, __n, __centre, __spread) of every cluster; one vector aggregate, however many columns there are."""
    whole = Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(F.array(*[F.col(c).cast("double") for c in cols])))
    n = F.col("v.count")
    within = F.aggregate(vector_to_array("v.variance"), F.lit(0.0), lambda acc, x: acc + x) * (n - 1) / n  # of the sample, made that of all rows
    return df.groupBy("label").agg(whole.alias("v")).select("label", n.alias("__n"), vector_to_array("v.mean").alias("__centre"), within.alias("__spread"))


def _sums(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sum of the distances from each left row to all right rows."""
    unit, out = (1.0,) * left.shape[1], np.zeros(len(left))
    step = max(64, 500_000 // max(1, len(right)))
    for s in range(0, len(left), step):
        out[s:s + step] = np.sqrt(_squared(left[s:s + step], right, unit)).sum(axis=1)
    return out


def _squared(left: np.ndarray, right: np.ndarray, unit: tuple[float, ...]) -> np.ndarray:
    """Squared distances, of many columns by a matrix product; pairs too close for it by their differences."""
    if len(unit) < PRODUCT_DIMS or not len(right):
        return squared_distances(left, right, unit)
    mid = right.mean(axis=0)
    out, off = product_distances(left - mid, right - mid)
    close = ~(out > CLOSE * off[:, None])
    if not close.any():
        return out
    r, c = np.nonzero(close)
    if len(r) * 32 > out.size:
        return squared_distances(left, right, unit)
    for a in range(0, len(r), 16_384):
        gap = left[r[a:a + 16_384]] - right[c[a:a + 16_384]]
        out[r[a:a + 16_384], c[a:a + 16_384]] = (gap * gap).sum(axis=1)
    return out


def silhouette(df: DataFrame, cols: list[str], broadcast_rows: int = BROADCAST_ROWS,
               block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(row_id, label, s): exact Euclidean silhouette per row.

    Distances are summed only to the row's own cluster and to those that can be its nearest other one (``Clusters.wanted``).
    A row is sent to the blocks of these clusters, their rows stay one per block (times the salts of a cluster that very
    many rows ask for); a block returns sums, never distances. A table of at most ``broadcast_rows`` rows travels instead.
    More than ``EXPAND_ROWS`` rows of one or two columns do not meet in pairs, see ``_by_nodes``.
    """
    known = cluster_facts(df, cols)
    n = int(known.sizes.sum())
    if _few_columns(known, cols):
        found = _by_nodes(df, cols, known).withColumnsRenamed({c: f"__p{i}" for i, c in enumerate(["label", *cols])})
        same = [df[c].eqNullSafe(found[f"__p{i}"]) for i, c in enumerate(["label", *cols])]
        rows = df.select(F.col(ROW_ID), "label", *cols).join(found, same)
        total = F.array(*[F.sum(F.col("sums")[c]) for c in range(len(known.labels))])  # rows that repeat an id count as one
        return _finished(rows.groupBy(ROW_ID, "label").agg(F.first("code").alias("code"), total.alias("sums")), [ROW_ID, "label"], known)
    base = df.select(F.col(ROW_ID), "label", *cols)
    part_schema = T.StructType([base.schema[ROW_ID], base.schema["label"], T.StructField("__c", T.IntegerType()), T.StructField("__part", T.DoubleType()), T.StructField("__own", T.BooleanType())])

    def parts(pdf: pd.DataFrame, c: np.ndarray, sums: np.ndarray) -> pd.DataFrame:
        """Shares of the mean distance to cluster ``c``; a row's own cluster counts one row less."""
        own = known.codes(pdf["label"]) == c
        return pdf[[ROW_ID, "label"]].assign(__c=c, __part=sums / np.maximum(known.sizes[c] - own, 1), __own=own)

    if n <= broadcast_rows:
        small = base.toPandas()
        of = known.codes(small["label"])
        members = [small.loc[of == c, cols].to_numpy(float) for c in range(len(known.labels))]

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                x = pdf[cols].to_numpy(float)
                wanted = known.wanted(x, known.codes(pdf["label"]))
                for c, right in enumerate(members):
                    rows = np.flatnonzero(wanted[:, c])
                    yield parts(pdf.iloc[rows], np.full(len(rows), c), _sums(x[rows], right))

        found = base.mapInPandas(search, part_schema)
    else:
        base = materialize(base)
        found = _searched_blocks(base, cols, known, block_rows, part_schema, parts)
    means = found.groupBy(ROW_ID, "label", "__c", "__own").agg(F.sum("__part").alias("m"))
    sides = means.groupBy(ROW_ID, "label").agg(F.max(F.when(F.col("__own"), F.col("m"))).alias("a"), F.min(F.when(~F.col("__own"), F.col("m"))).alias("b"))
    # a row alone in its cluster has no mates; its silhouette is 0 by definition
    alone = [label for label, size in zip(known.labels, known.sizes) if size == 1]
    widest = F.greatest("a", "b")
    s = F.when((widest > 0) & F.col("a").isNotNull() & F.col("b").isNotNull(), (F.col("b") - F.col("a")) / F.nullif(widest, F.lit(0.0))).otherwise(0.0)
    if alone:
        lonely = df.sparkSession.createDataFrame([(x,) for x in alone], T.StructType([base.schema["label"]])).withColumn("alone", F.lit(True))
        sides = sides.join(F.broadcast(lonely), "label", "left")  # a row per cluster, their number was checked
        s = F.when(F.col("alone"), 0.0).otherwise(s)
    return sides.select(ROW_ID, "label", s.alias("s"))


def mean_silhouette(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row (s): mean of ``silhouette``."""
    known = cluster_facts(df, cols)
    if _few_columns(known, cols) and df.groupBy(ROW_ID, "label").count().where(F.col("count") > 1).isEmpty():
        each = _finished(_by_nodes(df, cols, known), ["label", *cols, "w"], known)  # no need to go back to single rows
        return each.agg((F.sum(F.col("s") * F.col("w")) / F.sum("w")).alias("s"))
    return silhouette(df, cols).agg(F.avg("s").alias("s"))


def _few_columns(known: Clusters, cols: list[str]) -> bool:
    return (known.sizes.sum() > EXPAND_ROWS and len(cols) <= D.MAX_DIMS and D.most_leaves(len(cols), len(known.labels)) >= EXPAND_LEAVES
            and bool(np.isfinite(known.centres).all() and np.isfinite(known.spread).all()))


def _by_nodes(df: DataFrame, cols: list[str], known: Clusters) -> DataFrame:
    """(label, cols, w, code, sums) of each different row: how often it stands there, and its ``distance_sums``."""
    points = df.groupBy("label", *cols).agg(F.count(F.lit(1)).alias("w"))
    coded = T.StructType([*points.schema.fields, T.StructField("code", T.IntegerType())])

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(code=known.codes(pdf["label"]))

    points = materialize(points.mapInPandas(code, coded))
    return D.distance_sums(points, cols, len(known.labels), points.count())


def _finished(found: DataFrame, kept: list[str], known: Clusters) -> DataFrame:
    """``kept`` columns and s, from the sums of distances to every cluster."""
    shown = T.StructType([*(found.schema[c] for c in kept), T.StructField("s", T.DoubleType())])

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf) == 0:
                continue
            sums, own, rows = np.stack(pdf["sums"].to_list()), pdf["code"].to_numpy(), np.arange(len(pdf))
            a = sums[rows, own] / np.maximum(known.sizes[own] - 1, 1)
            others = sums / known.sizes
            others[rows, own] = np.inf
            b = others.min(axis=1)
            widest = np.maximum(a, b)
            some = np.isfinite(widest) & (widest > 0) & (known.sizes[own] > 1)
            yield pdf[kept].assign(s=np.where(some, (b - a) / np.where(some, widest, 1.0), 0.0))

    return found.mapInPandas(finish, shown)


def _searched_blocks(base: DataFrame, cols: list[str], known: Clusters, block_rows: int, schema: T.StructType, parts) -> DataFrame:
    """Shares of mean distances, from blocks of cluster rows that meet the rows which want them."""
    n = known.sizes.sum()
    block_rows = max(block_rows, min(BLOCK_ROWS, int(n) // MOST_BLOCKS))  # a row is copied to every block of a cluster that it wants
    blocks = np.maximum(1, np.ceil(known.sizes / block_rows)).astype(np.int64)
    trial = base.sample(min(1.0, 5000 / n), 29).limit(10_000).toPandas()
    load = np.zeros(len(blocks))
    if len(trial):
        load = known.wanted(trial[cols].to_numpy(float), known.codes(trial["label"])).sum(axis=0) * (n / len(trial))
    salts = np.maximum(1, np.ceil(load / GROUP_ROWS)).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(blocks * salts)])  # cell number of a cluster's first block and salt

    def hashed(pdf: pd.DataFrame) -> np.ndarray:
        return pd.util.hash_array(pdf[ROW_ID].to_numpy())

    def spread(index: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(index, times), np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)

    ask = T.StructType([*base.schema.fields, T.StructField("__c", T.IntegerType()), T.StructField("__cell", T.LongType())])
    stay = T.StructType([*base.schema.fields, T.StructField("__cell", T.LongType())])

    def asks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf) == 0:
                continue
            row, c = np.nonzero(known.wanted(pdf[cols].to_numpy(float), known.codes(pdf["label"])))
            salt = (hashed(pdf)[row] % salts[c].astype(np.uint64)).astype(np.int64)
            at, block = spread(np.arange(len(row)), blocks[c])
            for a in range(0, len(at), PLACED_ROWS):
                some, which = at[a:a + PLACED_ROWS], block[a:a + PLACED_ROWS]
                yield pdf.iloc[row[some]].assign(__c=c[some], __cell=first[c[some]] + which * salts[c[some]] + salt[some])

    def stays(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf) == 0:
                continue
            c = known.codes(pdf["label"])
            block = ((hashed(pdf) >> np.uint64(20)) % blocks[c].astype(np.uint64)).astype(np.int64)
            at, salt = spread(np.arange(len(pdf)), salts[c])
            for a in range(0, len(at), PLACED_ROWS):
                some = at[a:a + PLACED_ROWS]
                yield pdf.iloc[some].assign(__cell=first[c[some]] + block[some] * salts[c[some]] + salt[a:a + PLACED_ROWS])

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return parts(left, left["__c"].to_numpy(dtype=np.int64), _sums(left[cols].to_numpy(float), right[cols].to_numpy(float)))

    return base.mapInPandas(asks, ask).groupBy("__cell").cogroup(base.mapInPandas(stays, stay).groupBy("__cell")).applyInPandas(meet, schema)


def davies_bouldin(df: DataFrame, cols: list[str], pair_rows: int = 4096) -> DataFrame:
    """One row (db): mean over clusters of the worst (scatter + scatter) / centre distance.

    Centres are a table. They are cut into blocks of ``pair_rows``, blocks meet pairwise in tasks, and a task returns the
    worst ratio of every centre of its first block, so any number of clusters will do.
    """
    centres = materialize(centre_table(df, cols))
    n = centres.count()
    named = centres.select(F.col("label").alias("__of"), "__n", "__centre")
    if n * (len(cols) + 2) <= MAX_VALUES:
        near = df.join(F.broadcast(named), df["label"].eqNullSafe(named["__of"]))
    else:
        df = materialize(df.select("label", *cols))
        hot = F.col("__n") * HOT_SHARE >= F.lit(centres.agg(F.sum("__n")).first()[0])
        few, rest = F.broadcast(named.where(hot)), named.where(~hot)  # HOT_SHARE clusters at most
        match = lambda f: df["label"].eqNullSafe(f["__of"])
        near = df.join(few, match(few)).unionByName(df.join(few.select("__of"), match(few), "left_anti").join(rest, match(rest)))
    square = F.zip_with(F.array(*cols), "__centre", lambda x, y: (x - y) * (x - y))
    own = F.sqrt(F.aggregate(square, F.lit(0.0), lambda acc, x: acc + x))
    scatter = near.groupBy("label").agg(F.avg(own).alias("s"), F.first("__centre").alias("centre"))
    blocks = max(1, -(-n // pair_rows))
    part = F.pmod(F.xxhash64("centre"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    points = materialize(scatter.select(F.monotonically_increasing_id().alias("i"), "s", "centre"))

    def worst(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if len(left) == 0 or len(right) == 0:
            return pd.DataFrame({"i": [], "r": []})
        x, y = np.stack(left["centre"].to_list()), np.stack(right["centre"].to_list())
        best, unit = np.full(len(x), -1.0), (1.0,) * len(cols)
        for a in range(0, len(x), max(1, 2_000_000 // len(y))):
            some = slice(a, a + max(1, 2_000_000 // len(y)))
            gap = np.sqrt(squared_distances(x[some], y, unit))
            both = left["s"].to_numpy()[some, None] + right["s"].to_numpy()[None, :]
            ratio = np.divide(both, gap, out=np.zeros_like(gap), where=gap > 0)
            ratio[left["i"].to_numpy()[some, None] == right["i"].to_numpy()[None, :]] = -1.0  # a centre with itself
            best[some] = ratio.max(axis=1)
        return pd.DataFrame({"i": left["i"], "r": best})

    one = points.withColumns({"x": part, "y": every}).groupBy("x", "y")
    two = points.withColumns({"x": every, "y": part}).groupBy("x", "y")
    found = one.cogroup(two).applyInPandas(worst, "i long, r double").where(F.col("r") >= 0)
    return found.groupBy("i").agg(F.max("r").alias("r")).agg(F.coalesce(F.avg("r"), F.lit(0.0)).alias("db"))


def compactness(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row (icc): variance over all entries of a cluster, averaged over clusters of several rows."""
    long = df.select("label", F.explode(F.array(*cols)).alias("value"))
    per = (long.groupBy("label").agg(F.var_pop("value").alias("v"), F.count(F.lit(1)).alias("n"))
           .where(F.col("n") > len(cols)))
    return per.agg(F.coalesce(F.avg("v"), F.lit(0.0)).alias("icc"))
