"""Ranks, running counts, row numbers and exact quantiles without a one-task sort.

All of them cut the value axis into buckets at approximate quantiles (cheap, one
mergeable sketch per column, only a balance hint: results never depend on it),
sum each bucket with a map-side aggregate, turn the sums into offsets with a window
over the few bucket rows, and rank only inside buckets. A group that holds most of
the rows is therefore spread over as many tasks as it has buckets.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinlens.session import materialize

ROWS_PER_BUCKET = 2_000_000
MAX_BUCKETS = 16384
SMALL_ROWS = 2_000_000  # up to here one exact `percentile` aggregate is cheaper


def bucket_splits(df: DataFrame, cols: list[str], n_rows: int,
                  rows_per_bucket: int | None = None) -> dict[str, list[float]]:
    """Inner split points per column so that buckets hold similar row counts."""
    per = rows_per_bucket or ROWS_PER_BUCKET
    buckets = min(MAX_BUCKETS, math.ceil(n_rows / per))
    if buckets < 2:
        return {c: [] for c in cols}
    probs = [i / buckets for i in range(1, buckets)]
    found = df.approxQuantile(cols, probs, 1.0 / (4 * buckets))
    return {c: sorted(set(values)) for c, values in zip(cols, found)}


def add_buckets(df: DataFrame, splits: dict[str, list[float]], suffix: str = "__b") -> DataFrame:
    """Add an integer bucket column per split column (JVM binary search)."""
    cut = {c: s for c, s in splits.items() if s}
    out = df
    if cut:
        out = Bucketizer(
            splitsArray=[[-math.inf, *s, math.inf] for s in cut.values()],
            inputCols=list(cut), outputCols=[c + suffix for c in cut],
        ).transform(out)
    return out.withColumns({
        c + suffix: (F.col(c + suffix).cast("int") if c in cut else F.lit(0)) for c in splits
    })


def running_counts(counts: DataFrame, by: list[str], bucket: str, value: str,
                   weights: list[str], single: bool = False) -> DataFrame:
    """Add ``<w>_before``, ``<w>_upto`` and ``<w>_all`` to rows distinct on (by, value).

    ``single``: the table was small enough for one bucket, so no offsets are needed.
    """
    if single:
        inside = W.partitionBy(*by).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
        whole = W.partitionBy(*by)
        return counts.withColumns({
            **{f"{w}_all": F.sum(w).over(whole) for w in weights},
            **{f"{w}_upto": F.sum(w).over(inside) for w in weights},
        }).withColumns({f"{w}_before": F.col(f"{w}_upto") - F.col(w) for w in weights})
    sums = counts.groupBy(*by, bucket).agg(*[F.sum(w).alias(w) for w in weights])
    ahead = W.partitionBy(*by).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*by)
    offsets = sums.select(
        *by, bucket,
        *[F.coalesce(F.sum(w).over(ahead), F.lit(0)).alias(f"{w}_offset") for w in weights],
        *[F.sum(w).over(whole).alias(f"{w}_all") for w in weights],
    )
    inside = W.partitionBy(*by, bucket).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    joined = counts.join(offsets, [*by, bucket])
    return joined.withColumns({
        f"{w}_upto": F.col(f"{w}_offset") + F.sum(w).over(inside) for w in weights
    }).withColumns({
        f"{w}_before": F.col(f"{w}_upto") - F.col(w) for w in weights
    }).drop(*[f"{w}_offset" for w in weights])


def ecdf(pair, rows_per_bucket: int | None = None) -> DataFrame:
    """(feature, bucket, value, o, a, o_upto, a_upto, o_all, a_all) per distinct value."""
    n_o, n_a = pair.counts()
    return ecdf_tagged(pair.tagged(), pair.cols, n_o + n_a, rows_per_bucket)


def ecdf_tagged(tagged: DataFrame, cols: list[str], n_rows: int,
                rows_per_bucket: int | None = None) -> DataFrame:
    """Running counts of both sides over the union of their values."""
    splits = bucket_splits(tagged, cols, n_rows, rows_per_bucket)
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("value"), F.col(c + "__b").alias("bucket"))
        for c in cols
    ])).alias("cell")
    counts = (add_buckets(tagged, splits).select("side", cells).select("side", "cell.*")
              .groupBy("feature", "bucket", "value")
              .agg(F.sum(1 - F.col("side")).alias("o"), F.sum("side").cast("bigint").alias("a")))
    return running_counts(counts, ["feature"], "bucket", "value", ["o", "a"], not any(splits.values()))


def row_number_global(df: DataFrame, order: str | None, name: str = "row_id", by: list[str] | None = None,
                      n_rows: int | None = None, rows_per_bucket: int | None = None,
                      tie: list[str] | None = None) -> DataFrame:
    """Add a gap-free zero-based number following ``order``, per group of ``by``.

    ``order`` must be unique, or unique together with the ``tie`` columns.

    Without ``order`` rows follow a hash of their content; equal rows are
    interchangeable, so the numbered table is the same on every run.
    """
    by = list(by or [])
    by_hash = order is None
    base = df.withColumn("__order", F.xxhash64(*df.columns) if by_hash else F.col(order))
    n = n_rows if n_rows is not None else base.count()
    ties = [F.col(c) for c, t in df.dtypes if not t.startswith("map")] if by_hash else list(tie or [])
    kind = base.schema["__order"].dataType
    if by_hash or not isinstance(kind, T.NumericType):
        cut, several = _range_buckets(base, by_hash, n, rows_per_bucket)
        ties += ["__salt"] if by_hash and several else []
    else:
        spread = base.withColumn("__axis", F.col("__order").cast("double"))
        splits = bucket_splits(spread, ["__axis"], n, rows_per_bucket)
        cut, several = add_buckets(spread, splits), bool(splits["__axis"])
    part = [*by, "__axis__b"]
    inside = W.partitionBy(*part).orderBy("__order", *ties)
    if not several:
        return cut.withColumn(name, (F.row_number().over(inside) - 1).cast("bigint")).select(*df.columns, name)
    ahead = W.partitionBy(*by).orderBy("__axis__b").rowsBetween(W.unboundedPreceding, -1)
    offsets = (cut.groupBy(*part).agg(F.count(F.lit(1)).alias("__n"))  # a row per group and bucket
               .select(*part, F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__offset")))
    return (cut.join(offsets, part)
            .withColumn(name, (F.row_number().over(inside) - 1 + F.col("__offset")).cast("bigint"))
            .select(*df.columns, name))


def _range_buckets(base: DataFrame, by_hash: bool, n_rows: int, rows_per_bucket: int | None) -> tuple[DataFrame, bool]:
    """Buckets by sampled ranges of the whole key, written once so that they stay as they are.

    Rows of equal content are told apart by a random number, so a content that many rows share is cut over buckets; which
    of them gets which number is of no account.
    """
    buckets = min(MAX_BUCKETS, math.ceil(n_rows / (rows_per_bucket or ROWS_PER_BUCKET)))
    if buckets < 2:
        return base.withColumn("__axis__b", F.lit(0)), False
    keys = ["__order"]
    if by_hash:
        base, keys = base.withColumn("__salt", F.rand(17)), ["__order", "__salt"]
    ranged = base.repartitionByRange(buckets, *keys).withColumn("__axis__b", F.spark_partition_id())
    return materialize(ranged), True


INTERVAL_BLOCK = 256


def lookup_intervals(points: DataFrame, position: str, intervals: DataFrame, start: str, end: str,
                     by: list[str] | None = None) -> DataFrame:
    """Join every point to the one interval [start, end) that holds its position.

    Both sides are cut into blocks of positions and meet in an equi-join on the block, so
    a wide interval is spread over its blocks and a block offers at most a block's worth
    of intervals per point.
    """
    by = list(by or [])
    first, last = F.floor(F.col(start) / INTERVAL_BLOCK), F.floor((F.col(end) - 1) / INTERVAL_BLOCK)
    pieces = (intervals.where(F.col(end) > F.col(start))
              .withColumn("__block", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint")))))
    placed = points.withColumn("__block", F.floor(F.col(position) / INTERVAL_BLOCK).cast("bigint"))
    return (placed.join(pieces, [*by, "__block"])
            .where((F.col(position) >= F.col(start)) & (F.col(position) < F.col(end))).drop("__block"))


def interpolation_ranks(n: int, prob: float) -> tuple[int, int, float]:
    """Zero-based order statistics and weight of numpy's linear quantile."""
    h = (n - 1) * prob
    low = math.floor(h)
    return low, min(low + 1, n - 1), h - low


def order_statistics(df: DataFrame, wanted: dict[str, tuple[int, list[int]]],
                     rows_per_bucket: int | None = None) -> dict[str, dict[int, float]]:
    """Values at the given zero-based ranks: {column: (row count, ranks)}.

    Bucket sizes come from one map-side aggregate; only the buckets that hold a
    wanted rank are then ranked value by value.
    """
    cols = list(wanted)
    n_rows = max(n for n, _ in wanted.values())
    splits = bucket_splits(df, cols, n_rows, rows_per_bucket)
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("value"), F.col(c + "__b").alias("bucket"))
        for c in cols
    ])).alias("cell")
    long = add_buckets(df.select(*cols), splits).select(cells).select("cell.*").where("value IS NOT NULL")
    sizes: dict[str, dict[int, int]] = {c: {} for c in cols}
    for r in long.groupBy("feature", "bucket").count().collect():
        sizes[r["feature"]][r["bucket"]] = r["count"]
    targets = []  # (feature, bucket, rank inside the bucket, rank)
    for c, (_, ranks) in wanted.items():
        start = 0
        for bucket in sorted(sizes[c]):
            end = start + sizes[c][bucket]
            targets += [(c, bucket, r - start, r) for r in ranks if start <= r < end]
            start = end
    spark = df.sparkSession
    aim = spark.createDataFrame(targets, "feature string, bucket int, inner_rank bigint, rank bigint")
    hot = spark.createDataFrame([(f, b) for f, b in {(t[0], t[1]) for t in targets}], "feature string, bucket int")
    counts = (long.join(F.broadcast(hot), ["feature", "bucket"])
              .groupBy("feature", "bucket", "value").agg(F.count(F.lit(1)).alias("n")))
    inside = W.partitionBy("feature", "bucket").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    placed = counts.withColumn("upto", F.sum("n").over(inside))
    hits = (placed.join(F.broadcast(aim), ["feature", "bucket"])
            .where((F.col("inner_rank") < F.col("upto")) & (F.col("inner_rank") >= F.col("upto") - F.col("n")))
            .select("feature", "rank", "value").collect())
    out: dict[str, dict[int, float]] = {c: {} for c in cols}
    for r in hits:
        out[r["feature"]][r["rank"]] = r["value"]
    return out


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float],
                    counts: dict[str, int], small_rows: int | None = None,
                    rows_per_bucket: int | None = None) -> dict[str, list[float | None]]:
    """Exact linear-interpolated quantiles of every column, on the driver.

    ``counts`` holds the number of non-null values per column.
    """
    limit = SMALL_ROWS if small_rows is None else small_rows
    if max(counts.values()) <= limit:
        row = df.agg(*[F.percentile(F.col(c), F.array(*map(F.lit, probs))).alias(f"q{i}")
                       for i, c in enumerate(cols)]).first()
        return {c: list(row[i]) if row[i] is not None else [None] * len(probs)
                for i, c in enumerate(cols)}
    live = [c for c in cols if counts[c] > 0]
    places = {c: [interpolation_ranks(counts[c], p) for p in probs] for c in live}
    found = order_statistics(
        df, {c: (counts[c], sorted({r for lo, hi, _ in places[c] for r in (lo, hi)})) for c in live},
        rows_per_bucket)
    out: dict[str, list[float | None]] = {}
    for c in cols:
        if c not in places:
            out[c] = [None] * len(probs)
            continue
        out[c] = [found[c][lo] + (found[c][hi] - found[c][lo]) * w for lo, hi, w in places[c]]
    return out


def quantile_of(df: DataFrame, column: str, probs: list[float]) -> list[float | None]:
    """Exact quantiles of a single column whose row count is not known yet."""
    n = df.agg(F.count(column)).first()[0]
    return exact_quantiles(df, [column], probs, {column: n})[column]
