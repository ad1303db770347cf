"""Binned counts per feature and side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.functions.binning import equal_width_bin

BINS = 50


def binned_counts(df: DataFrame, ranges: dict[str, tuple[float, float]], bins: int = BINS) -> DataFrame:
    """(feature, bin, n) over the given range per feature; rows outside are left out."""
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"),
                 equal_width_bin(F.col(c), F.lit(lo), F.lit(hi), bins).alias("bin"))
        for c, (lo, hi) in ranges.items()
    ])).alias("cell")
    return (df.select(cells).select("cell.*").where("bin IS NOT NULL")
            .groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n")))


def pair_histogram(pair, bins: int = BINS) -> DataFrame:
    """(feature, bin, o, a): dense bins on the original's range, both sides counted."""
    ranges = {c: (s["lo"], s["hi"]) for c, s in pair.o_stats.items() if s["n"]}
    flat = [c for c in pair.cols
            if min(pair.o_stats[c]["n"], pair.a_stats[c]["n"]) < 2
            or not pair.o_stats[c]["std_pop"] or not pair.a_stats[c]["std_pop"]]
    ranges = {c: r for c, r in ranges.items() if c not in flat}
    spark = pair.orig.sparkSession
    names = spark.createDataFrame([(c,) for c in ranges] or [], "feature string")
    dense = names.select("feature", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    if not ranges:
        return dense.select("feature", "bin", F.lit(0).alias("o"), F.lit(0).alias("a"))
    counts = (binned_counts(pair.o, ranges, bins).select("feature", "bin", F.col("n").alias("o"), F.lit(0).alias("a"))
              .unionByName(binned_counts(pair.a, ranges, bins)
                           .select("feature", "bin", F.lit(0).alias("o"), F.col("n").alias("a")))
              .groupBy("feature", "bin").agg(F.sum("o").alias("o"), F.sum("a").alias("a")))
    return (dense.join(counts, ["feature", "bin"], "left")
            .select("feature", "bin", F.coalesce("o", F.lit(0)).alias("o"), F.coalesce("a", F.lit(0)).alias("a")))
