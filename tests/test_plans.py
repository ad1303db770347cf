"""Registered queries: wiring, plan shape, and a quick comparison with SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
import verify

SMALL = "/root/testdata/sf0.001"
QUICK = ["f1_mean_absolute_distance", "f2_ks_statistic", "f7_kl_divergence", "f9_q_function", "d2_coverage", "v3_attribute_disclosure",
         "v5_uniqueness", "v7_l_diversity", "p4_describe", "g1_random_sampling", "g7_smote", "g10_edited_auto", "u2_stratified_split",
         "u4_classification_metrics", "m14_lda", "h2_recent_analyses", "h7_parse_suggestions", "s1_csv_round_trip"]


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 90


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    got = entry.queries()[name](spark, SMALL).toPandas()
    assert verify.compare(got, verify.connect(SMALL).execute(entry.oracle_sql()[name]).fetchdf()) == ""


@pytest.mark.parametrize("name", ["f1_mean_absolute_distance", "f2_ks_statistic", "f5_statistical_moments", "f7_kl_divergence",
                                  "d1_feature_entropy", "d5_range_coverage", "d7_davies_bouldin", "v3_attribute_disclosure",
                                  "v6_k_anonymity", "v7_l_diversity", "g1_random_sampling", "g5_gaussian_copula", "g7_smote",
                                  "g10_edited_auto", "u2_stratified_split", "k5_nearest_two"])
def test_no_cross_join_in_the_plan(spark, name):
    plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_only_needed_columns_are_read(spark):
    plan = entry.queries()["v6_k_anonymity"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_discount:double,l_tax:double>" in plan


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["dimension", "metric", "feature", "field", "value", "label"] and df.count() > 0
