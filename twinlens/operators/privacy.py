"""What the augmented table gives away about original rows."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlens.facts import feature_facts, number, single_facts, word
from twinlens.functions.hashing import hash_order
from twinlens.functions.numbers import grade
from twinlens.operators.classes import class_key, class_sizes, quantile_edges, within_class_bins
from twinlens.operators.neighbors import count_within, nearest
from twinlens.operators.ranking import exact_quantiles
from twinlens.pair import ROW_ID, Pair
from twinlens.session import materialize

DIM = "privacy"
SMALL_CLASS = (1, 2, 5, 10)  # fixed values: class-size thresholds reported
DIVERSE_CLASS = (2, 3, 5)  # fixed values: l thresholds reported


def pair_neighbors(pair: Pair) -> DataFrame:
    """(qid, bid, dist, rank): two nearest originals of every augmented row.

    One search serves three metrics, so the result is written once.
    """
    return materialize(nearest(pair.a_keyed, pair.o_keyed, pair.cols, pair.scale, 2, n_base=pair.counts()[0]))


def nearest_neighbor_risk(neighbors: DataFrame) -> DataFrame:
    """Ratio of first to second neighbour distance; low ratios point at one original."""
    two = neighbors.groupBy("qid").agg(F.max(F.when(F.col("rank") == 1, F.col("dist"))).alias("d1"),
                                       F.max(F.when(F.col("rank") == 2, F.col("dist"))).alias("d2"))
    r = F.col("d1") / (F.col("d2") + F.lit(1e-10))
    row = two.agg(F.avg(r).alias("r"), F.avg(F.when(r < 0.5, 1.0).otherwise(0.0)).alias("h"),
                  F.min("d1").alias("lo"), F.avg("d1").alias("m"))
    return single_facts(row, DIM, "nearest_neighbor_risk", [
        number("average_nn_ratio", F.col("r")), number("high_risk_ratio", F.col("h")),
        number("min_distance_to_original", F.col("lo")), number("average_distance_to_nearest", F.col("m")),
        word("risk_level", grade(F.col("h"), [("high", ">", 0.3), ("medium", ">", 0.1)], "low"))])


def membership_inference(pair: Pair, train_rows: int = 700, seed: int = 42, trees: int = 50, depth: int = 10) -> DataFrame:
    """Accuracy of a forest telling original rows from augmented ones, the mean over both sides.

    The forest is fitted on the first ``train_rows`` rows of each side in hashed key order (the bound of the fit, at most
    seven tenths of the smaller side); all other rows of both sides are told apart.
    """
    n = min(train_rows, *(-(-7 * c // 10) for c in pair.counts()))
    parts = []
    for keyed, y in ((pair.o_keyed, 1.0), (pair.a_keyed, 0.0)):
        mixed = keyed.withColumn("__mix", hash_order(seed, f"member.{'oa'[y < 1]}", F.col(ROW_ID)))
        last = mixed.select("__mix").orderBy("__mix").limit(n).agg(F.max("__mix")).first()[0]
        parts.append(mixed.withColumn("train", F.col("__mix") <= F.lit(last)).withColumn("y", F.lit(y)).drop("__mix"))
    data = VectorAssembler(inputCols=pair.cols, outputCol="features").transform(materialize(parts[0].unionByName(parts[1])))
    model = RandomForestClassifier(labelCol="y", numTrees=trees, maxDepth=depth, seed=seed).fit(data.where("train"))
    return membership_facts(model.transform(data.where("NOT train")))


def membership_facts(told: DataFrame) -> DataFrame:
    """Facts of an attack of any kind: ``told`` has y (1 original, 0 augmented) and prediction of the rows told apart."""
    hit = (F.col("prediction") == F.col("y")).cast("double")
    row = told.groupBy("y").agg(F.avg(hit).alias("hit")).agg(F.avg("hit").alias("acc"))
    p = 1 - (F.col("acc") - 0.5) * 2
    return single_facts(row, DIM, "membership_inference", [
        number("classifier_accuracy", F.col("acc")), number("privacy_score", F.greatest(F.lit(0.0), p)),
        number("distinguishability", F.col("acc")),
        word("privacy_level", grade(p, [("high", ">", 0.7), ("medium", ">", 0.4)], "low"))])


def attribute_disclosure(pair: Pair, neighbors: DataFrame) -> DataFrame:
    """Mean raw difference to the closest original, per column, relative to its range."""
    link = neighbors.where("rank = 1").select("qid", "bid")
    a = pair.a_keyed.select(F.col(ROW_ID).alias("qid"), *[F.col(c).alias(f"a_{c}") for c in pair.cols])
    o = pair.o_keyed.select(F.col(ROW_ID).alias("bid"), *[F.col(c).alias(f"o_{c}") for c in pair.cols])
    near = link.join(a, "qid").join(o, "bid")
    cells = F.inline(F.array(*[
        F.struct(F.lit(i).alias("pos"), F.lit(c).alias("feature"), F.col(f"m{i}").alias("m"),
                 F.lit(pair.o_stats[c]["hi"] - pair.o_stats[c]["lo"]).alias("width"))
        for i, c in enumerate(pair.cols)]))
    means = near.agg(*[F.avg(F.abs(F.col(f"a_{c}") - F.col(f"o_{c}"))).alias(f"m{i}")
                       for i, c in enumerate(pair.cols)]).select(cells)
    df = means.withColumn("r", F.when(F.col("width") > 0, F.col("m") / F.nullif("width", F.lit(0.0))).otherwise(0.0))
    return feature_facts(df, DIM, "attribute_disclosure", [
        number("absolute_difference", F.col("m")), number("normalized_difference", F.col("r")),
        word("risk", grade(F.col("r"), [("high", "<", 0.1), ("medium", "<", 0.3)], "low"))],
        [number("average_attribute_risk", F.avg("r")),
         word("overall_risk", lambda t: grade(t("average_attribute_risk"),
                                              [("high", "<", 0.15), ("medium", "<", 0.35)], "low"))])


def distance_to_closest(pair: Pair, neighbors: DataFrame, threshold: float | None = None) -> DataFrame:
    """Distances to the closest original; the default threshold is their 10th percentile."""
    d = neighbors.where("rank = 1").select("dist")
    n = pair.counts()[1]
    tenth, middle = exact_quantiles(d, ["dist"], [0.1, 0.5], {"dist": n})["dist"]
    limit = F.lit(tenth if threshold is None else threshold)
    risky = F.sum((F.col("dist") < limit).cast("bigint"))
    row = d.agg(F.avg("dist").alias("m"), F.min("dist").alias("lo"), F.max("dist").alias("hi"),
                risky.alias("k"), F.count(F.lit(1)).alias("n"))
    return single_facts(row, DIM, "distance_to_closest", [
        number("mean_dcr", F.col("m")), number("median_dcr", F.lit(middle)), number("min_dcr", F.col("lo")),
        number("max_dcr", F.col("hi")), number("risky_records_count", F.col("k")),
        number("risky_records_ratio", F.col("k") / F.col("n")), number("privacy_threshold", limit)])


def uniqueness(pair: Pair, radius: float = 0.5) -> DataFrame:
    """1 / (1 + originals within the radius), averaged over augmented rows."""
    counted = count_within(pair.a_keyed, pair.o_keyed, pair.cols, pair.scale, radius, n_base=pair.counts()[0])
    # few distinct counts remain after this aggregate, the median is read off their frequencies
    table = counted.groupBy("n").agg(F.count(F.lit(1)).alias("f")).withColumn("u", 1.0 / (1 + F.col("n")))
    rows = F.sum("f")
    row = table.agg(
        (F.sum(F.col("u") * F.col("f")) / rows).alias("m"),
        F.percentile(F.col("u"), F.lit(0.5), F.col("f")).alias("mid"),
        (F.sum(F.when(F.col("u") > 0.7, F.col("f")).otherwise(0)) / rows).alias("high"),
        (F.sum(F.col("n") * F.col("f")) / rows).alias("near"))
    return single_facts(row, DIM, "uniqueness", [
        number("average_uniqueness", F.col("m")), number("median_uniqueness", F.col("mid")),
        number("highly_unique_ratio", F.col("high")), number("average_neighbors", F.col("near")),
        word("privacy_quality", grade(F.col("m"), [("good", ">", 0.6), ("fair", ">", 0.4)], "poor"))])


def k_anonymity(pair: Pair, quasi_columns: list[str] | None = None, n_bins: int = 10) -> DataFrame:
    """Sizes of the augmented equivalence classes after quantile binning by the original."""
    cols = quasi_columns or pair.cols
    sizes = class_sizes(pair.a, cols, quantile_edges(pair, cols, n_bins))
    table = sizes.groupBy("n").agg(F.count(F.lit(1)).alias("f"))  # classes per size
    groups, records = F.sum("f"), F.sum(F.col("n") * F.col("f"))

    def below(limit: int, weight: Column) -> Column:
        return F.sum(F.when(F.col("n") < limit, weight).otherwise(0))

    row = table.agg(
        F.min("n").alias("k"), groups.alias("g"), F.percentile(F.col("n"), F.lit(0.5), F.col("f")).alias("mid"),
        (records / groups).alias("mean"),
        *[(below(t, F.col("f")) / groups).alias(f"g{t}") for t in SMALL_CLASS],
        *[(below(t, F.col("n") * F.col("f")) / records).alias(f"r{t}") for t in SMALL_CLASS])
    return single_facts(row, DIM, "k_anonymity", [
        number("k_anonymity", F.col("k")), number("n_equivalence_classes", F.col("g")),
        number("median_equivalence_class_size", F.col("mid")), number("mean_equivalence_class_size", F.col("mean")),
        *[number(f"ratio_groups_lt_{t}", F.col(f"g{t}")) for t in SMALL_CLASS],
        *[number(f"ratio_records_in_groups_lt_{t}", F.col(f"r{t}")) for t in SMALL_CLASS]])


def l_diversity(pair: Pair, quasi_columns: list[str] | None = None, sensitive: str | None = None,
                n_bins: int = 10, exclude_sensitive: bool = False) -> DataFrame:
    """Distinct and entropy diversity of the sensitive column inside each class.

    By default the sensitive column (the last one) is also a quasi-identifier.
    """
    cols = list(quasi_columns or pair.cols)
    sensitive = sensitive or cols[-1]
    if exclude_sensitive:
        cols = [c for c in cols if c != sensitive]
    edges = quantile_edges(pair, cols, n_bins)
    keyed = pair.a.select(class_key(cols, edges).alias("key"), F.col(sensitive).alias("value"))
    per = within_class_bins(keyed, ["key"], "value", pair.counts()[1], 10)
    # distinct counts are at most ten; entropies are rounded before their frequencies are taken
    table = (per.groupBy("distinct_bins", F.round("entropy_bits", 9).alias("e"))
             .agg(F.count(F.lit(1)).alias("f")))
    groups = F.sum("f")
    row = table.agg(
        groups.alias("g"), (F.sum(F.col("distinct_bins") * F.col("f")) / groups).alias("d"),
        F.percentile(F.col("distinct_bins"), F.lit(0.5), F.col("f")).alias("dm"),
        (F.sum(F.col("e") * F.col("f")) / groups).alias("e"), F.percentile(F.col("e"), F.lit(0.5), F.col("f")).alias("em"),
        *[(F.sum(F.when(F.col("distinct_bins") >= t, F.col("f")).otherwise(0)) / groups).alias(f"l{t}")
          for t in DIVERSE_CLASS])
    return single_facts(row, DIM, "l_diversity", [
        number("average_distinct_sensitive_values", F.col("d")), number("median_distinct_sensitive_values", F.col("dm")),
        number("average_entropy_bits", F.col("e")), number("median_entropy_bits", F.col("em")),
        number("n_equivalence_classes", F.col("g")),
        *[number(f"ratio_classes_l_{t}", F.col(f"l{t}")) for t in DIVERSE_CLASS]])
