"""Equivalence classes over quantile-binned columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlens.functions.binning import right_closed_bin
from twinlens.functions.numbers import sql_name
from twinlens.operators.ranking import add_buckets, bucket_splits, exact_quantiles, running_counts
from twinlens.pair import Pair

N_BINS = 10


def quantile_edges(pair: Pair, cols: list[str], n_bins: int = N_BINS) -> dict[str, list[float]]:
    """Distinct exact quantile edges of the original, at most ``n_bins + 1`` per column."""
    counts = {c: int(pair.o_stats[c]["n"]) for c in cols}
    q = max(1, min(n_bins, max(counts.values())))
    found = exact_quantiles(pair.o, cols, [i / q for i in range(q + 1)], counts)
    return {c: sorted({v for v in found[c] if v is not None}) for c in cols}


def class_key(cols: list[str], edges: dict[str, list[float]]) -> Column:
    return F.struct(*[right_closed_bin(F.col(c), edges[c]).cast("int").alias(c) for c in cols])


def class_sizes(df: DataFrame, cols: list[str], edges: dict[str, list[float]]) -> DataFrame:
    """(key, n): partial sums are merged, so a hot class costs one row per task."""
    return df.groupBy(class_key(cols, edges).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def within_class_bins(df: DataFrame, keys: list[str], value: str, n_rows: int, n_bins: int = N_BINS,
                      rows_per_bucket: int | None = None) -> DataFrame:
    """(keys..., n, distinct_bins, entropy_bits) of ``value`` re-binned inside each class.

    Each class of n rows is cut at its own linear quantiles j/q, q = min(n_bins, max(2, n)),
    bins right-closed with the lowest edge included. All order statistics and the bin
    populations are read off running counts, which are built per (class, value bucket):
    a class holding a third of all rows is ranked by many tasks.
    """
    splits = bucket_splits(df, [value], n_rows, rows_per_bucket)
    bucket = value + "__b"
    counts = (add_buckets(df, splits).groupBy(*keys, bucket, value)
              .agg(F.count(F.lit(1)).alias("w")))
    placed = running_counts(counts, keys, bucket, value, ["w"], not splits[value])
    q = f"least({n_bins}, greatest(2, w_all))"
    marks = range(n_bins + 1)

    def picked(j: int, upper: bool) -> str:
        """(value, rows up to it) at the lower or upper order statistic of quantile j/q."""
        low = f"floor(cast(w_all - 1 AS double) * (cast({j} AS double) / cast({q} AS double)))"
        rank = f"least({low} + 1, w_all - 1)" if upper else low
        return (f"max(CASE WHEN {j} <= {q} AND w_before <= {rank} AND {rank} < w_upto "
                f"THEN named_struct('v', {sql_name(value)}, 'upto', w_upto) END) AS {'hi' if upper else 'lo'}{j}")

    v = sql_name(value)
    stats = placed.groupBy(*keys).agg(*[F.expr(t) for t in (
        "first(w_all) AS n", f"min({v}) = max({v}) AS flat",
        *[picked(j, False) for j in marks], *[picked(j, True) for j in marks])])
    # rows at or below each edge; equal edges repeat the same number, and edges equal to the
    # lowest one bound no bin (a constant class is a single bin)
    upto = []
    for j in marks[1:]:
        h = f"(cast(n - 1 AS double) * (cast({j} AS double) / cast(least({n_bins}, greatest(2, n)) AS double)))"
        edge = f"(lo{j}.v + (hi{j}.v - lo{j}.v) * ({h} - floor({h})))"
        upto.append(f"CASE WHEN {edge} > lo0.v THEN CASE WHEN {edge} >= hi{j}.v THEN hi{j}.upto ELSE lo{j}.upto END "
                    f"WHEN flat THEN n WHEN {edge} IS NOT NULL THEN 0 END AS u{j}")
    cut = stats.selectExpr(*keys, "n", *upto)
    sizes = ["u1"] + [f"(u{j} - u{j - 1})" for j in marks[2:]]
    entropy = F.expr(" + ".join(f"CASE WHEN {s} > 0 THEN -({s} / n) * log2({s} / n) ELSE 0D END" for s in sizes))
    distinct = F.expr(" + ".join(f"CASE WHEN {s} > 0 THEN 1 ELSE 0 END" for s in sizes))
    return cut.select(*keys, "n", distinct.alias("distinct_bins"), entropy.alias("entropy_bits"))
