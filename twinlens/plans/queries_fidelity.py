"""Fidelity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinlens.operators import fidelity as M
from twinlens.plans.pairs import LINEITEM_COLS, LINEITEM_SQL, PART_COLS, PART_SQL, lineitem_pair, part_pair
from twinlens.plans.registry import register
from twinlens.plans.sql_metrics import fidelity_sql

_LINES = fidelity_sql(LINEITEM_SQL, LINEITEM_COLS)
_PARTS = fidelity_sql(PART_SQL, PART_COLS)


@register("f1_mean_absolute_distance", _LINES["f1_mean_absolute_distance"])
def f1(spark, sf_dir):
    return M.mean_absolute_distance(lineitem_pair(spark, sf_dir))


@register("f2_ks_statistic", _LINES["f2_ks_statistic"])
def f2(spark, sf_dir):
    return M.ks_test(lineitem_pair(spark, sf_dir))


@register("f3_mmd", _PARTS["f3_mmd"])
def f3(spark, sf_dir):
    return M.mmd(part_pair(spark, sf_dir))


@register("f4_pca_similarity", _PARTS["f4_pca_similarity"])
def f4(spark, sf_dir):
    return M.pca_similarity(part_pair(spark, sf_dir))


@register("f5_statistical_moments", _LINES["f5_statistical_moments"])
def f5(spark, sf_dir):
    return M.statistical_moments(lineitem_pair(spark, sf_dir))


@register("f6_wasserstein", _LINES["f6_wasserstein"])
def f6(spark, sf_dir):
    pair = lineitem_pair(spark, sf_dir)
    gaps = M.distribution_gaps(M.ecdf(pair), {c: pair.o_stats[c]["mean"] for c in pair.cols})
    return gaps.select("feature", (F.round("w", 4) + 0.0).alias("wasserstein"))


@register("f7_kl_divergence", _LINES["f7_kl_divergence"])
def f7(spark, sf_dir):
    return M.kl_divergence(lineitem_pair(spark, sf_dir))


@register("f8_js_divergence", _LINES["f8_js_divergence"])
def f8(spark, sf_dir):
    return M.js_divergence(lineitem_pair(spark, sf_dir))


@register("f9_q_function", _PARTS["f9_q_function"])
def f9(spark, sf_dir):
    return M.q_function(part_pair(spark, sf_dir))
