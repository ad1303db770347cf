"""How closely the augmented table follows the original."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinlens.facts import feature_facts, number, single_facts, union_all, word
from twinlens.functions.hashing import normal_value, uniform_value
from twinlens.functions.numbers import clamp, grade
from twinlens.functions.pvalue import exact_pvalue_udf, kolmogorov_pvalue
from twinlens.operators.histogram import pair_histogram
from twinlens.operators.neighbors import mean_nearest
from twinlens.operators.ranking import ecdf, ecdf_tagged
from twinlens.operators.summaries import joined_stats
from twinlens.pair import Pair
from twinlens.session import materialize, spread

DIM = "fidelity"
# Fixed value: default weights of the composite moment score.
MOMENT_WEIGHTS = {"mean": 0.4, "std": 0.2, "skew": 0.2, "kurt": 0.2}
_SINE = [(-1) ** k * math.pi ** (2 * k + 1) / math.factorial(2 * k + 1) for k in range(11)]  # of sin(pi t), for half a turn at most


def mean_absolute_distance(pair: Pair) -> DataFrame:
    """Mean shift per feature in original standard deviations."""
    shift = F.abs(F.col("o_mean") - F.col("a_mean")) / (F.col("o_std_samp") + F.lit(1e-10))
    df = joined_stats(pair).select("feature", shift.alias("d"))
    return feature_facts(df, DIM, "mean_absolute_distance", [number("distance", F.col("d"))],
                         [number("overall_distance", F.avg("d")), number("max_distance", F.max("d")),
                          number("min_distance", F.min("d"))])


def distribution_gaps(points: DataFrame, shift: dict[str, float] | None = None) -> DataFrame:
    """(feature, d, w, n_o, n_a): two-sample KS statistic and Wasserstein-1 distance.

    The distance integrates |F_o - F_a|; summed by parts over the jump at each value it
    needs only that value's counts before and after, not the next value.
    """
    after = F.abs(F.col("o_upto") / F.col("o_all") - F.col("a_upto") / F.col("a_all"))
    before = F.abs(F.col("o_before") / F.col("o_all") - F.col("a_before") / F.col("a_all"))
    centre = F.lit(0.0)
    if shift:
        centre = F.coalesce(*[F.when(F.col("feature") == c, F.lit(m)) for c, m in shift.items()])
    return points.groupBy("feature").agg(
        F.max(after).alias("d"), F.sum((F.col("value") - centre) * (before - after)).alias("w"),
        F.first("o_all").cast("double").alias("n_o"), F.first("a_all").cast("double").alias("n_a"))


def pair_gaps(pair: Pair) -> DataFrame:
    """Distribution gaps of every column, written once for the metrics that share them."""
    return materialize(distribution_gaps(ecdf(pair), {c: pair.o_stats[c]["mean"] for c in pair.cols}))


def ks_test(pair: Pair, exact: bool = False, gaps: DataFrame | None = None) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov per feature; ``exact`` counts paths and refuses samples too large for it.

    ``gaps`` may be those of ``pair_gaps``.
    """
    gaps = distribution_gaps(ecdf(pair)) if gaps is None else gaps
    p = exact_pvalue_udf(F.col("d"), F.col("n_o"), F.col("n_a")) if exact else kolmogorov_pvalue("d", "n_o", "n_a")
    df = gaps.withColumn("p", p)
    return feature_facts(df, DIM, "kolmogorov_smirnov",
                         [number("statistic", F.col("d")), number("pvalue", F.col("p")),
                          word("similar", (F.col("p") > 0.05).cast("string"))],
                         [number("average_pvalue", F.avg("p")), number("similarity_score", F.avg("p"))])


def cosines(turns: np.ndarray) -> np.ndarray:
    """Cosines of angles given in turns: 1 - 2 sin(pi t)^2 after whole turns are taken off, by the sine's series.

    Right to double precision, in a third of the time of ``np.cos``.
    """
    turns = turns - np.rint(turns)
    square, sine = turns * turns, np.full_like(turns, _SINE[-1])
    for c in _SINE[-2::-1]:
        sine *= square
        sine += c
    sine *= turns
    sine *= sine
    sine *= -2
    sine += 1
    return sine


def mmd(pair: Pair, gamma: float = 1.0, features: int = 512, seed: int = 42) -> DataFrame:
    """Maximum mean discrepancy with an RBF kernel over all rows.

    The kernel is written as the mean product of ``features`` random cosine features, so the squared discrepancy is the
    mean squared difference of the sides' mean features: one pass, and a task returns one sum per side and feature. The
    relative error of the square is about sqrt(2 / features). Columns are in original deviations.
    """
    cols, sd = list(pair.cols), np.array(pair.scale)
    w = np.array([[math.sqrt(2 * gamma) * normal_value(seed, f"mmd.{c}", j) / (2 * math.pi) for c in cols] for j in range(features)])
    phase = np.array([uniform_value(seed, "mmd.phase", j) for j in range(features)])

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, features))
        for pdf in batches:
            x, side = pdf[cols].to_numpy(float) / sd, pdf["side"].to_numpy()
            ones = np.stack([side == 0, side == 1]).astype(float)
            for a in range(0, len(pdf), 64):  # their cosines stay in a core's cache
                total += ones[:, a:a + 64] @ cosines(x[a:a + 64] @ w.T + phase)
        yield pd.DataFrame({"j": np.arange(features), "o": total[0], "a": total[1]})

    n_o, n_a = pair.counts()
    gap = F.sum("o") / F.lit(float(max(1, n_o))) - F.sum("a") / F.lit(float(max(1, n_a)))
    row = (spread(pair.tagged(), n_o + n_a).mapInPandas(sums, "j bigint, o double, a double").groupBy("j").agg(gap.alias("g"))
           .agg(F.sqrt(F.lit(2.0) * F.avg(F.col("g") * F.col("g"))).alias("m")))
    return single_facts(row, DIM, "mmd_score", [
        number("mmd_score", F.col("m")),
        word("quality", grade(F.col("m"), [("high", "<", 0.1), ("medium", "<", 0.3)], "low"))])


def pca_components(pair: Pair, max_components: int | None = None) -> tuple[DataFrame, list[str], list[float]]:
    """Both sides projected on the principal axes of the standardised original; all of them by default."""
    k = min(max_components or len(pair.cols), len(pair.cols))
    scaled = pair.tagged().select("side", *[
        ((F.col(c) - F.lit(pair.o_stats[c]["mean"])) / F.lit(s)).alias(c) for c, s in zip(pair.cols, pair.scale)])
    vectors = VectorAssembler(inputCols=pair.cols, outputCol="features").transform(scaled)
    model = PCA(k=k, inputCol="features", outputCol="pc").fit(vectors.where("side = 0"))
    names = [f"pc{i + 1}" for i in range(k)]
    parts = model.transform(vectors).select("side", vector_to_array("pc").alias("pc"))
    # rounding makes rows that tie mathematically tie in the comparison too
    wide = parts.select("side", *[F.round(F.col("pc")[i], 9).alias(n) for i, n in enumerate(names)])
    return wide, names, [float(v) for v in model.explainedVariance.toArray()]


def pca_similarity(pair: Pair, max_components: int | None = None) -> DataFrame:
    """KS p-value per principal component, and the explained variance of the fit."""
    wide, names, explained = pca_components(pair, max_components)
    points = ecdf_tagged(wide, names, sum(pair.counts()))
    df = distribution_gaps(points).withColumn("p", kolmogorov_pvalue("d", "n_o", "n_a"))
    share = F.coalesce(*[F.when(F.col("feature") == n, F.lit(v)) for n, v in zip(names, explained)])
    return feature_facts(df, DIM, "pca_comparison",
                         [number("component_similarity", F.col("p")), number("explained_variance", share)],
                         [number("average_component_similarity", F.avg("p")),
                          number("n_components", F.count("p"))])


def statistical_moments(pair: Pair, weights: dict[str, float] | None = None,
                        include_distribution_metrics: bool = True, gaps: DataFrame | None = None) -> DataFrame:
    """Differences of the first four moments, scaled, with a composite per feature; ``gaps`` may be those of ``pair_gaps``."""
    weights = weights or MOMENT_WEIGHTS
    s = joined_stats(pair)

    def moment(side: str, name: str, more_than: int):
        value = F.col(f"{side}_{name}")
        return F.when((F.col(f"{side}_n") > more_than) & ~F.isnan(value), value).otherwise(F.lit(0.0))

    so, sa = F.col("o_std_pop"), F.col("a_std_pop")
    sk_o, sk_a = moment("o", "skew", 2), moment("a", "skew", 2)
    ku_o, ku_a = moment("o", "kurt", 3), moment("a", "kurt", 3)
    pooled = F.greatest(F.sqrt((so * so + sa * sa) / 2), F.lit(1e-8))
    df = s.select(
        "feature", F.abs(F.col("o_mean") - F.col("a_mean")).alias("mean_diff"), F.abs(so - sa).alias("std_diff"),
        F.abs(sk_o - sk_a).alias("skew_diff"), F.abs(ku_o - ku_a).alias("kurt_diff"), pooled.alias("pooled"),
        F.greatest(F.abs(sk_o), F.abs(sk_a), F.lit(1.0)).alias("skew_scale"),
        F.greatest(F.abs(ku_o), F.abs(ku_a), F.lit(1.0)).alias("kurt_scale"))
    df = df.withColumns({
        "cohens_d": F.col("mean_diff") / F.col("pooled"), "std_rel": F.col("std_diff") / F.col("pooled"),
        "skew_norm": F.col("skew_diff") / F.col("skew_scale"), "kurt_norm": F.col("kurt_diff") / F.col("kurt_scale")})
    part = {"mean": "cohens_d", "std": "std_rel", "skew": "skew_norm", "kurt": "kurt_norm"}
    df = df.withColumn("composite", sum((F.lit(float(weights.get(m, 0.0))) * F.col(c) for m, c in part.items()),
                                        F.lit(0.0)))
    fields = ["mean_diff", "std_diff", "skew_diff", "kurt_diff", "cohens_d", "std_rel", "skew_norm", "kurt_norm"]
    entries = [number(f, F.col(f), 4) for f in fields] + [number("composite_score", F.col("composite"))]
    if include_distribution_metrics:
        if gaps is None:
            gaps = distribution_gaps(ecdf(pair), {c: pair.o_stats[c]["mean"] for c in pair.cols})
        df = df.join(gaps.select("feature", "w", "d"), "feature")
        entries += [number("wasserstein", F.col("w"), 4), number("ks_stat", F.col("d"))]
    return feature_facts(df, DIM, "statistical_moments", entries, [
        number("average_moment_difference", F.avg("composite")), number("max_moment_difference", F.max("composite")),
        word("stat_badge", lambda t: F.when(t("average_moment_difference") <= 0.2, "high")
             .when(t("average_moment_difference") >= 0.5, "low").otherwise("medium"))])


def divergences(pair: Pair) -> DataFrame:
    """(feature, kl, js) from the smoothed histograms; flat features give zero."""
    eps = F.lit(1e-10)
    h = pair_histogram(pair).select("feature", (F.col("o") + eps).alias("o"), (F.col("a") + eps).alias("a"))
    per = W.partitionBy("feature")  # 50 rows a feature
    h = h.withColumns({"so": F.sum("o").over(per), "sa": F.sum("a").over(per)})
    p, q = F.col("o") / F.col("so"), F.col("a") / F.col("sa")
    m = (p + q) / 2
    got = h.groupBy("feature").agg(
        F.sum(p * F.log(p / q)).alias("kl"),
        (F.sum(p * F.log(p / m)) / 2 + F.sum(q * F.log(q / m)) / 2).alias("js2"))
    names = pair.orig.sparkSession.createDataFrame([(c,) for c in pair.cols], "feature string")
    return names.join(got, "feature", "left").select(
        "feature", F.coalesce("kl", F.lit(0.0)).alias("kl"),
        F.coalesce(F.sqrt(F.greatest(F.col("js2"), F.lit(0.0))), F.lit(0.0)).alias("js"))


def kl_divergence(pair: Pair, found: DataFrame | None = None) -> DataFrame:
    """Kullback-Leibler divergence (nats) over 50 bins of the original's range; ``found`` may be the pair's ``divergences``."""
    return feature_facts(divergences(pair) if found is None else found, DIM, "kl_divergence", [number("kl", F.col("kl"))], [
        number("average_kl_divergence", F.avg("kl")),
        number("similarity_score", lambda t: 1 / (1 + t("average_kl_divergence"))),
        word("quality", lambda t: grade(t("average_kl_divergence"), [("high", "<", 0.1), ("medium", "<", 0.5)], "low"))])


def js_divergence(pair: Pair, found: DataFrame | None = None) -> DataFrame:
    """Jensen-Shannon distance (root of the divergence, nats) over the same bins; ``found`` may be the pair's ``divergences``."""
    return feature_facts(divergences(pair) if found is None else found, DIM, "js_divergence", [number("js", F.col("js"))], [
        number("average_js_divergence", F.avg("js")),
        number("similarity_score", lambda t: clamp(1 - t("average_js_divergence"), 0.0, 1.0)),
        word("quality", lambda t: grade(t("average_js_divergence"), [("high", "<", 0.1), ("medium", "<", 0.3)], "low"))])


def attribute_sets(cols: list[str]) -> list[tuple[str, ...]]:
    """All pairs of columns, and one triple of neighbouring columns starting at each (three columns have a single triple)."""
    d = len(cols)
    triples = [tuple(cols[(i + j) % d] for j in range(3)) for i in range(d if d > 3 else int(d == 3))]
    return list(combinations(cols, 2)) + triples


def q_function(pair: Pair, sets: list[tuple[str, ...]] | None = None, neighbors: DataFrame | None = None) -> DataFrame:
    """Nearest-original closeness of augmented rows on sets of columns; every column takes part by default.

    ``neighbors`` (qid, bid, dist, rank), the nearest originals by all columns, serve the set of all columns.
    """
    sets = attribute_sets(pair.cols) if sets is None else sets
    known = [s for s in sets if neighbors is not None and tuple(s) == tuple(pair.cols)]
    sets = [s for s in sets if s not in known] + known
    spark = pair.orig.sparkSession
    scale = dict(zip(pair.cols, pair.scale))
    if not sets:
        empty = spark.range(1).select(F.lit(None).cast("double").alias("q"))
        return single_facts(empty, DIM, "q_function", [number("q_score", F.col("q"))])
    searched = len(sets) - len(known)
    tables = mean_nearest(pair.a_keyed, pair.o_keyed, sets[:searched], scale, n_base=pair.counts()[0]) if searched else []
    tables += [neighbors.where("rank = 1").agg(F.lit(i).alias("at"), F.avg("dist").alias("m")) for i in range(searched, len(sets))]
    means = union_all(tables)
    names = F.element_at(F.array(*[F.lit("+".join(s)) for s in sets]), F.col("at") + 1)
    parts = [means.select(names.alias("feature"), (1 / (1 + F.col("m"))).alias("q"))]
    return feature_facts(union_all(parts), DIM, "q_function", [number("q", F.col("q"))], [
        number("q_score", F.avg("q")), number("privacy_score", F.avg("q")),
        number("n_combinations_tested", F.count("q")), number("min_q_score", F.min("q")),
        number("max_q_score", F.max("q")),
        word("privacy_quality", lambda t: grade(t("q_score"), [("high", ">", 0.7), ("medium", ">", 0.4)], "low"))])


METRICS = {
    "mean_absolute_distance": mean_absolute_distance,
    "kolmogorov_smirnov": ks_test,
    "mmd_score": mmd,
    "pca_comparison": pca_similarity,
    "statistical_moments": statistical_moments,
    "kl_divergence": kl_divergence,
    "js_divergence": js_divergence,
    "q_function": q_function,
}
