"""Report sheets and JSON export from metric facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.plans.score import comparison_table, pick

# Rows of the detail sheets (caption, metric, field).
SHEETS = {
    "Fidelity": [
        ("KS Test - Similarity Score", "kolmogorov_smirnov", "similarity_score"),
        ("KL Divergence - Average KL", "kl_divergence", "average_kl_divergence"),
        ("JS Divergence - Average JS", "js_divergence", "average_js_divergence"),
        ("MMD Score", "mmd_score", "mmd_score"),
        ("MAD - Overall Distance", "mean_absolute_distance", "overall_distance"),
        ("Statistical Moments - Avg Moment Difference", "statistical_moments", "average_moment_difference"),
        ("Q-Function Score", "q_function", "q_score"),
        ("PCA - Avg Component Similarity", "pca_comparison", "average_component_similarity"),
    ],
    "Diversity": [
        ("Feature Entropy - Avg", "feature_entropy", "average_entropy"),
        ("Coverage Ratio", "coverage", "coverage_ratio"),
        ("Silhouette Score (augmented)", "silhouette_score", "augmented_score"),
        ("Davies-Bouldin Index (augmented)", "davies_bouldin_index", "augmented_score"),
        ("Cluster Uniformity", "cluster_spread", "augmented_uniformity"),
        ("Intra-Cluster Diversity", "intra_diversity", "diversity_score"),
        ("Range Coverage - Avg", "range_coverage", "average_coverage"),
        ("ICC (augmented_icc)", "intra_class_compactness", "augmented_icc"),
    ],
    "Privacy": [
        ("Membership Inference - Privacy Score", "membership_inference", "privacy_score"),
        ("Uniqueness - Average", "uniqueness", "average_uniqueness"),
        ("Mean DCR (distance to closest)", "distance_to_closest", "mean_dcr"),
        ("NN Risk - High Risk Ratio", "nearest_neighbor_risk", "high_risk_ratio"),
        ("Attribute Disclosure - Avg Attribute Risk", "attribute_disclosure", "average_attribute_risk"),
        ("k-Anonymity (k)", "k_anonymity", "k_anonymity"),
        ("l-Diversity (avg distinct)", "l_diversity", "average_distinct_sensitive_values"),
    ],
    "Utility": [
        ("Overall Utility Score", "utility", "overall_utility_score"),
        ("Average Improvement (accuracy)", "utility", "average_improvement_accuracy"),
    ],
}
# Per-model rows of the utility sheet (caption, scenario, field).
MODEL_ROWS = [
    ("Combined CV - n_folds", "combined", "cv_n_folds"),
    ("Combined CV - accuracy mean", "combined", "cv_accuracy_mean"),
    ("Combined CV - accuracy std", "combined", "cv_accuracy_std"),
    ("Combined CV - f1 mean", "combined", "cv_f1_mean"),
    ("Combined CV - f1 std", "combined", "cv_f1_std"),
    ("Combined test accuracy", "combined", "accuracy"),
    ("Combined test f1 (weighted)", "combined", "f1_weighted"),
]


def detail_sheets(facts: DataFrame) -> DataFrame:
    """(variant, sheet, position, caption, value): value null where a metric is absent."""
    entries = [(sheet, i, *row) for sheet, rows in SHEETS.items() for i, row in enumerate(rows)]
    wide = facts.groupBy("variant").agg(*[pick(m, f).alias(f"c{j}") for j, (*_, m, f) in enumerate(entries)])
    rows = [F.struct(F.lit(sheet).alias("sheet"), F.lit(i).alias("position"), F.lit(caption).alias("caption"),
                     F.col(f"c{j}").alias("value")) for j, (sheet, i, caption, _, _) in enumerate(entries)]
    return wide.select("variant", F.inline(F.array(*rows)))


def model_sheet(facts: DataFrame) -> DataFrame:
    """(variant, model, position, caption, value): the per-model part of the utility sheet."""
    models = facts.where("dimension = 'utility' AND feature IS NOT NULL")
    wide = models.groupBy("variant", F.col("feature").alias("model")).agg(*[
        F.max(F.when((F.col("metric") == scenario) & (F.col("field") == field), F.col("value"))).alias(f"c{i}")
        for i, (_, scenario, field) in enumerate(MODEL_ROWS)])
    rows = [F.struct(F.lit(i).alias("position"), F.lit(caption).alias("caption"), F.col(f"c{i}").alias("value"))
            for i, (caption, _, _) in enumerate(MODEL_ROWS)]
    return wide.select("variant", "model", F.inline(F.array(*rows))).where("value IS NOT NULL")


def write_workbook(facts: DataFrame, path: str, fmt: str = "csv") -> dict[str, str]:
    """Write the summary and every detail sheet as a folder each."""
    sheets = detail_sheets(facts)
    frames = {"Summary": comparison_table(facts), "Models": model_sheet(facts)}
    frames |= {name: sheets.where(F.col("sheet") == name) for name in SHEETS}
    out = {}
    for name, df in frames.items():
        out[name] = f"{path.rstrip('/')}/{name}"
        writer = df.write.mode("overwrite")
        writer.option("header", True).csv(out[name]) if fmt == "csv" else writer.format(fmt).save(out[name])
    return out


def results_json(facts: DataFrame) -> DataFrame:
    """(variant, json): nested results per variant, dimension -> metric -> field/feature values.

    A variant has a few hundred facts at most, so a variant's document is one small group.
    """
    value = F.coalesce(F.col("value").cast("string"), F.col("label"))
    name = F.concat_ws(".", "feature", "field")
    per_metric = (facts.groupBy("variant", "dimension", "metric")
                  .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, value)))).alias("fields")))
    per_dim = (per_metric.groupBy("variant", "dimension")
               .agg(F.map_from_entries(F.collect_list(F.struct("metric", "fields"))).alias("m")))
    return per_dim.groupBy("variant").agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("dimension", "m")))).alias("json"))
