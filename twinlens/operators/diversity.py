"""How varied the augmented table is, alone and against the original."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlens.facts import feature_facts, number, single_facts, word
from twinlens.functions.hashing import hash_order, uniform_value
from twinlens.functions.numbers import grade, ratio
from twinlens.operators import clusters as C
from twinlens.operators.histogram import BINS, binned_counts
from twinlens.operators.neighbors import nearest
from twinlens.operators.pairwise import pair_distances
from twinlens.operators.ranking import exact_quantiles, row_number_global
from twinlens.operators.summaries import joined_stats
from twinlens.pair import ROW_ID, Pair
from twinlens.session import materialize, spread

DIM = "diversity"


def feature_entropy(pair: Pair) -> DataFrame:
    """Entropy (nats) of 50 bins on the augmented column's own range."""
    live = {c: (s["lo"], s["hi"]) for c, s in pair.a_stats.items() if s["n"] >= 2 and s["std_pop"]}
    names = pair.orig.sparkSession.createDataFrame([(c,) for c in pair.cols], "feature string")
    if live:
        h = binned_counts(pair.a, live, BINS)
        n = F.coalesce(*[F.when(F.col("feature") == c, F.lit(pair.a_stats[c]["n"])) for c in live])
        p = F.col("n") / n
        got = h.groupBy("feature").agg((-F.sum(p * F.log(p))).alias("e"))
        names = names.join(got, "feature", "left")
    else:
        names = names.withColumn("e", F.lit(0.0))
    df = names.select("feature", F.coalesce("e", F.lit(0.0)).alias("e"))
    return feature_facts(df, DIM, "feature_entropy", [number("entropy", F.col("e"))],
                         [number("average_entropy", F.avg("e")), number("total_entropy", F.sum("e"))])


def coverage(pair: Pair, threshold: float | None = None) -> DataFrame:
    """Share of originals whose nearest augmented row is closer than the threshold.

    The default threshold is the 90th percentile of those very distances.
    """
    found = materialize(nearest(pair.o_keyed, pair.a_keyed, pair.cols, pair.scale, 1, n_base=pair.counts()[1]).select("dist"))
    if threshold is None:
        threshold = exact_quantiles(found, ["dist"], [0.9], {"dist": pair.counts()[0]})["dist"][0]
    t = F.lit(threshold)
    row = found.agg(F.avg((F.col("dist") < t).cast("double")).alias("c"), F.avg("dist").alias("m"),
                    F.max("dist").alias("x"))
    return single_facts(row, DIM, "coverage", [
        number("coverage_ratio", F.col("c")), number("average_distance_to_nearest", F.col("m")),
        number("max_distance_to_nearest", F.col("x")), number("threshold_used", t)])


def range_coverage(pair: Pair) -> DataFrame:
    """Overlap of the value ranges and how far the augmented one reaches beyond."""
    width = F.col("o_hi") - F.col("o_lo")
    overlap = F.greatest(F.lit(0.0), F.least("o_hi", "a_hi") - F.greatest("o_lo", "a_lo"))
    inside = (F.col("a_lo") <= F.col("o_lo")) & (F.col("o_lo") <= F.col("a_hi"))
    below = F.greatest(F.lit(0.0), F.col("o_lo") - F.col("a_lo"))
    above = F.greatest(F.lit(0.0), F.col("a_hi") - F.col("o_hi"))
    df = joined_stats(pair).select(
        "feature",
        F.when(width == 0, F.when(inside, 1.0).otherwise(0.0)).otherwise(ratio(overlap, width)).alias("c"),
        F.when(width == 0, 0.0).otherwise(ratio(below, width)).alias("b"),
        F.when(width == 0, 0.0).otherwise(ratio(above, width)).alias("u")).fillna(0.0)
    return feature_facts(df, DIM, "range_coverage", [
        number("coverage_ratio", F.col("c")), number("extension_below", F.col("b")),
        number("extension_above", F.col("u")), number("total_extension", F.col("b") + F.col("u"))],
        [number("average_coverage", F.avg("c")), number("average_extension", F.avg(F.col("b") + F.col("u")))])


def shifts_of(n: int, shifts: int, seed: int) -> list[int]:
    """Distinct shifts of a ring of ``n`` rows: all when there are no more than asked for, else drawn by ``seed``."""
    if n - 1 <= shifts:
        return list(range(1, n))
    return sorted({1 + math.floor(uniform_value(seed, "intra.shift", i) * (n - 1)) for i in range(shifts)})


def intra_diversity(pair: Pair, shifts: int | None = None, seed: int = 42) -> DataFrame:
    """Distances between standardised augmented rows: of all pairs, or of a sample of ``shifts`` pairs a row.

    For the sample rows stand in a ring in hashed key order; each is compared with the rows ``shifts`` drawn distances further
    on, by an equi-join on the place in the ring. A table of no more rows than that is compared completely.
    """
    if shifts is None:
        scaled = pair.a.select(*[((F.col(c) - F.lit(pair.a_stats[c]["mean"])) / F.lit(pair.a_stats[c]["std_pop"] or 1.0)).alias(c) for c in pair.cols])
        got = pair_distances(scaled, pair.cols)
        return _intra_facts(pair.orig.sparkSession.range(1).select(*[F.lit(float(v)).alias(k) for k, v in vars(got).items()]))
    n = pair.counts()[1]
    cols = [(c, pair.a_stats[c]["std_pop"] or 1.0) for c in pair.cols]
    mixed = pair.a_keyed.withColumn("__mix", hash_order(seed, "intra", F.col(ROW_ID)))
    ring = materialize(row_number_global(mixed, "__mix", "__at", n_rows=n).select("__at", *[(F.col(c) / F.lit(s)).alias(c) for c, s in cols]))
    steps = shifts_of(n, shifts, seed)
    asked = ring.withColumn("__to", F.explode(F.array(*[(F.col("__at") + F.lit(s)) % F.lit(n) for s in steps]) if steps
                                              else F.array().cast("array<bigint>")))
    other = ring.select(F.col("__at").alias("__to"), *[F.col(c).alias(f"{c}__o") for c, _ in cols])
    d = F.sqrt(sum(((F.col(c) - F.col(f"{c}__o")) * (F.col(c) - F.col(f"{c}__o")) for c, _ in cols), F.lit(0.0)))
    row = asked.join(other, "__to").select(d.alias("d")).agg(
        *[F.coalesce(f("d"), F.lit(0.0)).alias(k) for k, f in (("mean", F.avg), ("std", F.stddev_pop), ("lo", F.min), ("hi", F.max))])
    return _intra_facts(row)


def _intra_facts(row: DataFrame) -> DataFrame:
    return single_facts(row, DIM, "intra_diversity", [
        number("mean_pairwise_distance", F.col("mean")), number("std_pairwise_distance", F.col("std")),
        number("min_pairwise_distance", F.col("lo")), number("max_pairwise_distance", F.col("hi")),
        number("diversity_score", F.col("mean"))])


@dataclass
class Clustered:
    """Both sides standardised and labelled; ``cols`` are the scaled columns."""

    orig: DataFrame
    aug: DataFrame
    cols: list[str]
    k: int


def clustered(pair: Pair, label: Column | None = None, k: int | None = None) -> Clustered:
    """K-means fitted once on the original and applied to both sides, or ``k`` clusters that a ``label`` of each row names."""
    if label is not None:
        sides = (materialize(spread(C.scaled_side(df, pair, label.alias("label")), n)) for df, n in zip((pair.o_keyed, pair.a_keyed), pair.counts()))
        return Clustered(*sides, pair.cols, k)
    k = C.cluster_count(*pair.counts())
    o, a = C.scaled_side(pair.o_keyed, pair), C.scaled_side(pair.a_keyed, pair)
    model = C.fit_kmeans(o, pair.cols, k)
    return Clustered(materialize(C.labelled(o, pair.cols, model)), materialize(C.labelled(a, pair.cols, model)),
                     pair.cols, k)


def cluster_spread(c: Clustered) -> DataFrame:
    return single_facts(C.spread(c.orig, c.aug, c.k), DIM, "cluster_spread", [
        number("cluster_distribution_similarity", F.col("similarity")),
        number("augmented_uniformity", F.col("uniformity")), number("n_clusters", F.lit(float(c.k)))])


def _compared(o: DataFrame, a: DataFrame, metric: str, entries) -> DataFrame:
    """Join the one-row results of both sides and build the facts."""
    both = (o.select(F.col(o.columns[0]).alias("v"), F.lit(0).alias("side"))
            .unionByName(a.select(F.col(a.columns[0]).alias("v"), F.lit(1).alias("side")))
            .agg(F.max(F.when(F.col("side") == 0, F.col("v"))).alias("o"),
                 F.max(F.when(F.col("side") == 1, F.col("v"))).alias("a")))
    return single_facts(both, DIM, metric, entries)


def silhouette_score(c: Clustered) -> DataFrame:
    o, a = C.mean_silhouette(c.orig, c.cols), C.mean_silhouette(c.aug, c.cols)
    return _compared(o, a, "silhouette_score", [
        number("original_score", F.col("o")), number("augmented_score", F.col("a")),
        number("similarity", 1 - F.abs(F.col("o") - F.col("a"))), number("n_clusters", F.lit(float(c.k))),
        word("quality", grade(F.col("a"), [("high", ">", 0.5), ("medium", ">", 0.25)], "low"))])


def davies_bouldin_index(c: Clustered) -> DataFrame:
    gap = F.abs(F.col("o") - F.col("a"))
    return _compared(C.davies_bouldin(c.orig, c.cols), C.davies_bouldin(c.aug, c.cols), "davies_bouldin_index", [
        number("original_score", F.col("o")), number("augmented_score", F.col("a")),
        number("similarity", 1 / (1 + gap)), number("difference", gap), number("n_clusters", F.lit(float(c.k))),
        word("quality", grade(F.col("a"), [("high", "<", 1.0), ("medium", "<", 2.0)], "low"))])


def intra_class_compactness(c: Clustered) -> DataFrame:
    gap = F.abs(F.col("o") - F.col("a"))
    return _compared(C.compactness(c.orig, c.cols), C.compactness(c.aug, c.cols), "intra_class_compactness", [
        number("original_icc", F.col("o")), number("augmented_icc", F.col("a")),
        number("similarity", 1 / (1 + gap)), number("difference", gap), number("n_clusters", F.lit(float(c.k))),
        word("quality", grade(F.col("a"), [("high", "<", 0.5), ("medium", "<", 1.0)], "low"))])


PAIR_METRICS = {
    "feature_entropy": feature_entropy,
    "coverage": coverage,
    "intra_diversity": intra_diversity,
    "range_coverage": range_coverage,
}
CLUSTER_METRICS = {
    "cluster_spread": cluster_spread,
    "silhouette_score": silhouette_score,
    "davies_bouldin_index": davies_bouldin_index,
    "intra_class_compactness": intra_class_compactness,
}
