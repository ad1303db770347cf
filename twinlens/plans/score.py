"""Scores, ratings and comparison tables over metric facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlens.functions.numbers import clamp, tidy

# Default dimension weights.
WEIGHTS = {"fidelity": 0.33, "diversity": 0.33, "privacy": 0.34}

# Fixed values: (metric, field, shape, weight) per dimension score. Shapes: "as is",
# "one minus" (floored at 0), or a divisor with a ceiling of 1.
FIDELITY_TERMS = [
    ("kolmogorov_smirnov", "similarity_score", "as is", 0.3),
    ("mmd_score", "mmd_score", "one minus", 0.3),
    ("pca_comparison", "average_component_similarity", "as is", 0.3),
    ("mean_absolute_distance", "overall_distance", "as is", 0.3),
    ("kl_divergence", "average_kl_divergence", "as is", 0.3),
    ("js_divergence", "average_js_divergence", "as is", 0.3),
]
DIVERSITY_TERMS = [
    ("feature_entropy", "average_entropy", 4.0, 0.3),
    ("coverage", "coverage_ratio", "as is", 0.3),
    ("cluster_spread", "augmented_uniformity", "as is", 0.2),
    ("intra_diversity", "diversity_score", 10.0, 0.2),
    ("range_coverage", "average_coverage", "as is", 0.2),
    ("silhouette_score", "similarity", "as is", 0.2),
    ("davies_bouldin_index", "similarity", "as is", 0.2),
    ("intra_class_compactness", "similarity", "as is", 0.2),
]
PRIVACY_TERMS = [
    ("nearest_neighbor_risk", "high_risk_ratio", "as is", 0.35),
    ("membership_inference", "privacy_score", "as is", 0.35),
    ("attribute_disclosure", "average_attribute_risk", "as is", 0.35),
    ("uniqueness", "average_uniqueness", "as is", 0.25),
    ("distance_to_closest", "mean_dcr", 5.0, 0.15),
    ("k_anonymity", "k_anonymity", 20.0, 0.15),
    ("l_diversity", "average_distinct_sensitive_values", 10.0, 0.10),
]
TERMS = {"fidelity": FIDELITY_TERMS, "diversity": DIVERSITY_TERMS, "privacy": PRIVACY_TERMS}
# Terms where a larger value is worse; the corrected mode turns them round.
LARGER_IS_WORSE = {("mean_absolute_distance", "overall_distance"), ("kl_divergence", "average_kl_divergence"),
                   ("js_divergence", "average_js_divergence"), ("nearest_neighbor_risk", "high_risk_ratio")}
# Rating words by lower score bound.
RATINGS = [("Excellent", ">=", 0.8), ("Good", ">=", 0.6), ("Fair", ">=", 0.4), ("Adequate", ">=", 0.2)]


def pick(metric: str, field: str, dimension: str | None = None) -> Column:
    """Aggregate that reads one overall number out of fact rows."""
    on = (F.col("metric") == metric) & (F.col("field") == field) & F.col("feature").isNull()
    if dimension:
        on = on & (F.col("dimension") == dimension)
    return F.max(F.when(on, F.col("value")))


def _term(metric: str, field: str, shape, mode: str) -> Column:
    v = pick(metric, field)
    if mode == "corrected" and (metric, field) in LARGER_IS_WORSE:
        v = F.greatest(F.lit(0.0), 1 - v)
    elif shape == "one minus":
        v = F.greatest(F.lit(0.0), 1 - v)
    elif isinstance(shape, float):
        v = F.least(F.lit(1.0), v / F.lit(shape))
    return F.coalesce(v, F.lit(0.0))


def dimension_score(dimension: str, mode: str = "reference") -> Column:
    """Clamped weighted sum of a dimension's metrics; null when it has no facts.

    ``mode="corrected"`` turns distances into similarities and scales the weights to one.
    """
    terms = TERMS[dimension]
    total = sum(w for *_, w in terms) if mode == "corrected" else 1.0
    raw = sum((_term(m, f, s, mode) * F.lit(w / total) for m, f, s, w in terms), F.lit(0.0))
    present = F.max(F.when(F.col("dimension") == dimension, 1))
    return F.when(present.isNotNull(), clamp(raw))


def rating(score: Column) -> Column:
    out = None
    for word, _, bound in RATINGS:
        out = F.when(score >= bound, word) if out is None else out.when(score >= bound, word)
    return out.otherwise("Poor")


def variant_scores(facts: DataFrame, weights: dict[str, float] | None = None, mode: str = "reference") -> DataFrame:
    """(variant, fidelity, diversity, privacy, utility, overall, rating), one row per variant."""
    weights = dict(weights or WEIGHTS)
    total = sum(weights.values())
    if total > 0:
        weights = {k: v / total for k, v in weights.items()}
    s = facts.groupBy("variant").agg(*[dimension_score(d, mode).alias(d) for d in TERMS],
                                     pick("utility", "overall_utility_score").alias("utility"))
    overall = sum((F.coalesce(F.col(d), F.lit(0.0)) * F.lit(float(weights.get(d, 0.0))) for d in TERMS), F.lit(0.0))
    return s.withColumn("overall", overall).withColumn("rating", rating(F.col("overall")))


def score_facts(facts: DataFrame, weights: dict[str, float] | None = None, mode: str = "reference") -> DataFrame:
    """Scores as fact rows (dimension ``score``)."""
    s = variant_scores(facts, weights, mode)
    rows = [F.struct(F.lit("score").alias("dimension"), F.lit(f).alias("metric"), F.lit(None).cast("string").alias("feature"),
                     F.lit("score").alias("field"), tidy(F.col(f)).alias("value"),
                     (F.col("rating") if f == "overall" else F.lit(None).cast("string")).alias("label"))
            for f in ("fidelity", "diversity", "privacy", "overall")]
    return s.select("variant", F.inline(F.array(*rows))).where("value IS NOT NULL")


# Fixed values: (component, metric, field, transform) on the 0-100 scale of the charts.
COMPONENTS = {
    "fidelity": [
        ("KS Similarity", "kolmogorov_smirnov", "similarity_score", "v * 100"),
        ("PCA Similarity", "pca_comparison", "average_component_similarity", "v * 100"),
        ("MDD", "mmd_score", "mmd_score", "v * 100"),
        ("Mean Absolute Dist", "mean_absolute_distance", "overall_distance", "(1 - v) * 100"),
        ("KL Div", "kl_divergence", "similarity_score", "v * 100"),
        ("JS Div", "js_divergence", "similarity_score", "v * 100"),
        ("Q-Function", "q_function", "privacy_score", "v * 100"),
        ("Statistical Moments", "statistical_moments", "average_moment_difference", "v * 100"),
    ],
    "diversity": [
        ("Entropy", "feature_entropy", "average_entropy", "v / 4 * 100"),
        ("Coverage", "coverage", "coverage_ratio", "v * 100"),
        ("Silhouette", "silhouette_score", "augmented_score", "(v + 1) / 2 * 100"),
        ("DB Index", "davies_bouldin_index", "augmented_score", "1 / (1 + v) * 100"),
        ("ICC", "intra_class_compactness", "augmented_icc", "1 / (1 + v) * 100"),
        ("Uniformity", "cluster_spread", "augmented_uniformity", "v * 100"),
        ("Intra Diversity", "intra_diversity", "diversity_score", "v / 10 * 100"),
        ("Feature Range Coverage", "range_coverage", "average_coverage", "v * 100"),
    ],
    "privacy": [
        ("Privacy Score", "membership_inference", "privacy_score", "v * 100"),
        ("Uniqueness", "uniqueness", "average_uniqueness", "v * 100"),
        ("DCR (norm)", "distance_to_closest", "mean_dcr", "v / 5 * 100"),
        ("k-anonymity (scaled)", "k_anonymity", "k_anonymity", "least(100, v / 20 * 100)"),
        ("l-diversity (scaled)", "l_diversity", "average_distinct_sensitive_values", "least(100, v / 10 * 100)"),
        ("NNR", "nearest_neighbor_risk", "high_risk_ratio", "v * 100"),
        ("Attribute Disclosure", "attribute_disclosure", "average_attribute_risk", "v * 100"),
    ],
}
# What a missing metric shows as.
_ABSENT = {"Silhouette": 0.0, "DB Index": 100.0, "ICC": 100.0, "Mean Absolute Dist": 100.0}


def component_table(facts: DataFrame, dimension: str) -> DataFrame:
    """(variant, position, component, value): chart values of one dimension."""
    parts = COMPONENTS[dimension]
    wide = facts.groupBy("variant").agg(*[pick(m, f).alias(f"c{i}") for i, (_, m, f, _) in enumerate(parts)])
    rows = [F.struct(F.lit(i).alias("position"), F.lit(name).alias("component"),
                     tidy(F.coalesce(F.expr(text.replace("v", f"c{i}")), F.lit(_ABSENT.get(name, 0.0))), 4).alias("value"))
            for i, (name, _, _, text) in enumerate(parts)]
    return wide.select("variant", F.inline(F.array(*rows)))


# Badge thresholds (high, medium) and the transform of the value they look at.
BADGES = [
    ("kolmogorov_smirnov", "similarity_score", 1.0, 0.0, 0.5, 0.3),
    ("pca_comparison", "average_component_similarity", 1.0, 0.0, 0.7, 0.5),
    ("mean_absolute_distance", "overall_distance", -1.0, 1.0, 0.7, 0.5),
    ("feature_entropy", "average_entropy", 0.25, 0.0, 0.6, 0.4),
    ("coverage", "coverage_ratio", 1.0, 0.0, 0.7, 0.5),
    ("cluster_spread", "augmented_uniformity", 1.0, 0.0, 0.7, 0.5),
    ("intra_diversity", "diversity_score", 0.1, 0.0, 0.5, 0.3),
    ("range_coverage", "average_coverage", 1.0, 0.0, 0.8, 0.6),
    ("distance_to_closest", "mean_dcr", 0.2, 0.0, 0.6, 0.4),
]


def badges(facts: DataFrame) -> DataFrame:
    """(variant, metric, value, badge) through a small lookup of thresholds."""
    bands = facts.sparkSession.createDataFrame(
        BADGES, "metric string, field string, factor double, shift double, high double, medium double")
    shown = F.col("value") * F.col("factor") + F.col("shift")
    return (facts.where("feature IS NULL AND value IS NOT NULL").join(F.broadcast(bands), ["metric", "field"])
            .select("variant", "metric", "value", F.when(shown >= F.col("high"), "high")
                    .when(shown >= F.col("medium"), "medium").otherwise("low").alias("badge")))


def feature_rows(facts: DataFrame, metric: str, field: str) -> DataFrame:
    """(variant, feature, value) of one per-feature metric, e.g. information loss or risk."""
    return (facts.where((F.col("metric") == metric) & (F.col("field") == field) & F.col("feature").isNotNull())
            .select("variant", "feature", "value"))


def information_loss(facts: DataFrame) -> DataFrame:
    return feature_rows(facts, "kl_divergence", "kl")


def privacy_risk(facts: DataFrame) -> DataFrame:
    return feature_rows(facts, "attribute_disclosure", "normalized_difference")


def comparison_table(facts: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """One row per variant as on the summary sheet; missing scores show as zero."""
    s = variant_scores(facts, weights)
    cols = ["overall", "fidelity", "diversity", "privacy", "utility"]
    return s.select("variant", "rating", *[tidy(F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in cols])
