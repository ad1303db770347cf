"""Scores, reports, sources and history over facts of two real comparisons."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.functions.numbers import tidy
from twinlens.learning.utility import utility_facts
from twinlens.operators import diversity, fidelity, privacy
from twinlens.operators.profile import table_counts, validate_pair
from twinlens.plans import report, score
from twinlens.plans.analyze import history_rows, summary_facts, validation_facts
from twinlens.plans import sqlkit as S
from twinlens.plans.pairs import (
    ACCOUNT_COLS,
    ACCOUNT_SQL,
    PART_COLS,
    PART_SQL,
    account_pair,
    part_pair,
    table,
)
from twinlens.plans.queries_utility import order_results, utility_sql
from twinlens.plans.registry import register
from twinlens.plans.sql_metrics import DRAWN_SHIFTS, cluster_sql, diversity_sql, fidelity_sql, membership_sql, privacy_sql
from twinlens.session import materialize, materialize_all, shared_folder
from twinlens.sources import history, tables

_CACHE: dict[tuple[str, str, bool], DataFrame] = {}


# Clusters and attack given for each pair, as text that Spark and the check SQL both read: the label of a row, and what
# is taken for an original row. Fitted clusters and the fitted attack are k8 and v2.
CLUSTERS = 5
GIVEN = {"parts": ("CAST(least(4, floor(p_size / 10.0)) AS int)", "p_retailprice < 1480"),
         "accounts": ("CAST(least(4, floor(nation / 5.0)) AS int)", "balance >= 5000")}


def _told(pair, guess: str) -> DataFrame:
    """Rows of both sides with the answer of an attack that takes a row for an original where ``guess`` holds."""
    sides = [df.select(F.lit(y).alias("y"), F.expr(guess).cast("double").alias("prediction")) for df, y in ((pair.orig, 1.0), (pair.aug, 0.0))]
    return sides[0].unionByName(sides[1])


def _named(make: Callable[[], DataFrame], variant: str) -> Callable[[], DataFrame]:
    return lambda: make().withColumn("variant", F.lit(variant))


def checked_facts(spark, sf_dir: str, all_pairs: bool = False) -> DataFrame:
    """Facts of both pairs, every metric of the scores among them; written once per session.

    Intra-diversity is of ``all_pairs`` of rows or of the drawn pairs that a query's SQL names; all else is shared by both.
    """
    key = (spark.sparkContext.applicationId, sf_dir, all_pairs)
    other = _CACHE.get((*key[:2], not all_pairs))
    if key not in _CACHE:
        shared_folder(spark)  # named before threads ask for it
        pairs = {"parts": part_pair(spark, sf_dir), "accounts": account_pair(spark, sf_dir)}
        intra = [_named(partial(diversity.intra_diversity, pair, None if all_pairs else DRAWN_SHIFTS), variant) for variant, pair in pairs.items()]
        if other is not None:
            _CACHE[key] = other.where("metric <> 'intra_diversity'").unionByName(materialize_all(intra))
            return _CACHE[key]
        longest, alone, waiting = [], [], []
        with ThreadPoolExecutor(4 * len(pairs)) as pool:  # what several metrics share is made while the others run
            utility = pool.submit(lambda: materialize(utility_facts(order_results(spark, sf_dir))))
            for variant, pair in pairs.items():
                pair.scale, pair.counts()  # threads find the statistics taken
                label, guess = GIVEN[variant]
                groups = pool.submit(diversity.clustered, pair, F.expr(label), CLUSTERS)
                near = pool.submit(privacy.pair_neighbors, pair)
                gaps = pool.submit(fidelity.pair_gaps, pair)
                bins = pool.submit(lambda pair=pair: materialize(fidelity.divergences(pair)))
                shared = {"kolmogorov_smirnov": ("gaps", gaps), "statistical_moments": ("gaps", gaps), "kl_divergence": ("found", bins),
                          "js_divergence": ("found", bins), "q_function": ("neighbors", near)}
                makers = [partial(f, pair) for f in (*(f for m, f in fidelity.METRICS.items() if m not in shared),
                                                     *(f for m, f in diversity.PAIR_METRICS.items() if m != "intra_diversity"),
                                                     privacy.uniqueness, privacy.k_anonymity, privacy.l_diversity)]
                makers += [lambda pair=pair, guess=guess: privacy.membership_facts(_told(pair, guess))]
                alone += [_named(f, variant) for f in makers]
                makers = [lambda m=m, name=name, part=part, pair=pair: fidelity.METRICS[m](pair, **{name: part.result()}) for m, (name, part) in shared.items()]
                makers += [lambda f=f, groups=groups: f(groups.result()) for m, f in diversity.CLUSTER_METRICS.items() if m != "silhouette_score"]
                longest += [_named(lambda groups=groups: diversity.silhouette_score(groups.result()), variant)]
                makers += [lambda near=near: privacy.nearest_neighbor_risk(near.result())]
                makers += [lambda f=f, pair=pair, near=near: f(pair, near.result()) for f in (privacy.attribute_disclosure, privacy.distance_to_closest)]
                makers += [lambda: utility.result().drop("variant").withColumn("value", tidy(F.col("value")))]
                waiting += [_named(f, variant) for f in makers]
            _CACHE[key] = materialize_all(longest + intra + alone + waiting, 2 * len(longest) + 4)  # no long one is left to the end
    return _CACHE[key]


def _facts_cte(all_pairs: bool = False) -> str:
    sides = []
    for variant, sql, cols in (("parts", PART_SQL, PART_COLS), ("accounts", ACCOUNT_SQL, ACCOUNT_COLS)):
        label, guess = GIVEN[variant]
        texts = {**fidelity_sql(sql, cols), **diversity_sql(sql, cols, all_pairs), **privacy_sql(sql, cols),
                 **cluster_sql(sql, cols, label, CLUSTERS), "v2": membership_sql(sql, guess), "u": utility_sql()}
        texts.pop("f6_wasserstein")
        sides += [f"SELECT '{variant}' AS variant, * FROM ({t})" for t in texts.values()]
    return "facts AS MATERIALIZED (" + "\nUNION ALL\n".join(sides) + ")"


FACTS = _facts_cte()
ALL_PAIRS = _facts_cte(all_pairs=True)


def _pick(metric: str, field: str) -> str:
    return f"max(CASE WHEN metric = '{metric}' AND field = '{field}' AND feature IS NULL THEN value END)"


# The scores written out, apart from the library's own tables of terms.
_WEIGHED = {
    "fidelity": """0.3 * {kolmogorov_smirnov.similarity_score} + 0.3 * greatest(0, 1 - {mmd_score.mmd_score}) + 0.3 * {pca_comparison.average_component_similarity}
     + 0.3 * {mean_absolute_distance.overall_distance} + 0.3 * {kl_divergence.average_kl_divergence} + 0.3 * {js_divergence.average_js_divergence}""",
    "diversity": """0.3 * least(1, {feature_entropy.average_entropy} / 4) + 0.3 * {coverage.coverage_ratio} + 0.2 * {cluster_spread.augmented_uniformity}
     + 0.2 * least(1, {intra_diversity.diversity_score} / 10) + 0.2 * {range_coverage.average_coverage} + 0.2 * {silhouette_score.similarity}
     + 0.2 * {davies_bouldin_index.similarity} + 0.2 * {intra_class_compactness.similarity}""",
    "privacy": """0.35 * {nearest_neighbor_risk.high_risk_ratio} + 0.35 * {membership_inference.privacy_score} + 0.35 * {attribute_disclosure.average_attribute_risk}
     + 0.25 * {uniqueness.average_uniqueness} + 0.15 * least(1, {distance_to_closest.mean_dcr} / 5) + 0.15 * least(1, {k_anonymity.k_anonymity} / 20)
     + 0.10 * least(1, {l_diversity.average_distinct_sensitive_values} / 10)"""}


def _score_sql(dimension: str) -> str:
    return "least(1, greatest(0, " + re.sub(r"\{(\w+)\.(\w+)\}", lambda m: _pick(m[1], m[2]), _WEIGHED[dimension]) + "))"


def _scores_sql(facts: str) -> str:
    return (f"WITH {facts}, sc AS (SELECT variant, {_score_sql('fidelity')} AS fidelity, {_score_sql('diversity')} AS diversity, "
            f"{_score_sql('privacy')} AS privacy, "
            f"{_pick('utility', 'overall_utility_score')} AS utility FROM facts GROUP BY variant), "
            "sa AS (SELECT *, 0.33::DOUBLE * fidelity + 0.33::DOUBLE * diversity + 0.34::DOUBLE * privacy AS overall FROM sc)")


SCORES, ALL_PAIRS_SCORES = _scores_sql(FACTS), _scores_sql(ALL_PAIRS)
_RATING = ("CASE WHEN overall >= 0.8 THEN 'Excellent' WHEN overall >= 0.6 THEN 'Good' WHEN overall >= 0.4 THEN 'Fair' "
           "WHEN overall >= 0.2 THEN 'Adequate' ELSE 'Poor' END")

for _id, _dim in (("a1", "fidelity"), ("a2", "diversity"), ("a3", "privacy")):
    def _query(spark, sf_dir, dim=_dim):
        s = score.variant_scores(checked_facts(spark, sf_dir))
        return s.select("variant", tidy(F.col(dim)).alias("score"))

    register(f"{_id}_{_dim}_score", f"{SCORES} SELECT variant, {S.num(_dim)} AS score FROM sa")(_query)


@register("a4_overall_score", f"{SCORES} SELECT variant, {S.num('overall')} AS overall FROM sa")
def a4(spark, sf_dir):
    return score.variant_scores(checked_facts(spark, sf_dir)).select("variant", tidy(F.col("overall")).alias("overall"))


def _corrected_sql(dimension: str) -> str:
    terms, total = [], sum(w for *_, w in score.TERMS[dimension])
    for metric, field, shape, weight in score.TERMS[dimension]:
        v = _pick(metric, field)
        if shape == "one minus" or (metric, field) in score.LARGER_IS_WORSE:
            v = f"greatest(0, 1 - {v})"
        elif shape != "as is":
            v = f"least(1, {v} / {shape})"
        terms.append(f"{weight / total!r}::DOUBLE * coalesce({v}, 0)")
    return f"least(1, greatest(0, {' + '.join(terms)}))"


@register("a4_corrected_scores", f"""WITH {FACTS}, c AS (SELECT variant, {_corrected_sql('fidelity')} AS fidelity, {_corrected_sql('diversity')} AS diversity,
 {_corrected_sql('privacy')} AS privacy FROM facts GROUP BY variant)
SELECT variant, {S.num('fidelity')} AS fidelity, {S.num('diversity')} AS diversity, {S.num('privacy')} AS privacy,
{S.num('0.5 * fidelity + 0.25 * diversity + 0.25 * privacy')} AS overall FROM c""")
def a4_corrected(spark, sf_dir):
    s = score.variant_scores(checked_facts(spark, sf_dir), {"fidelity": 2, "diversity": 1, "privacy": 1}, "corrected")
    return s.select("variant", *[tidy(F.col(c)).alias(c) for c in ("fidelity", "diversity", "privacy", "overall")])


@register("a5_rating", f"""SELECT o_orderkey, CASE WHEN s >= 0.8 THEN 'Excellent' WHEN s >= 0.6 THEN 'Good' WHEN s >= 0.4 THEN 'Fair'
 WHEN s >= 0.2 THEN 'Adequate' ELSE 'Poor' END AS rating FROM (SELECT o_orderkey, o_totalprice / (SELECT max(o_totalprice) FROM orders) AS s FROM orders)""")
def a5(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    top = o.agg(F.max("o_totalprice")).first()[0]
    return o.select("o_orderkey", score.rating(F.col("o_totalprice") / F.lit(top)).alias("rating"))


def _component_sql(dimension: str) -> str:
    rows = []
    for i, (name, metric, field, text) in enumerate(score.COMPONENTS[dimension]):
        v = "coalesce(" + text.replace("v", "v.v") + f", {score._ABSENT.get(name, 0.0)})"
        rows.append(f"SELECT variant, {i}::INTEGER AS position, '{name}' AS component, {S.num(v, 4)} AS value "
                    f"FROM (SELECT variant, {_pick(metric, field)} AS v FROM facts GROUP BY variant) v")
    return f"WITH {FACTS} " + " UNION ALL ".join(rows)


for _dim in ("fidelity", "diversity", "privacy"):
    def _query(spark, sf_dir, dim=_dim):
        return score.component_table(checked_facts(spark, sf_dir), dim)

    register(f"a6_{_dim}_components", _component_sql(_dim))(_query)

_BANDS = ", ".join(f"('{m}', '{f}', {k}, {b}, {h}, {d})" for m, f, k, b, h, d in score.BADGES)


@register("a7_badges", f"""WITH {ALL_PAIRS}, b(metric, field, k, s, h, m) AS (VALUES {_BANDS})
SELECT variant, metric, value, CASE WHEN value * k::DOUBLE + s::DOUBLE >= h THEN 'high' WHEN value * k::DOUBLE + s::DOUBLE >= m
 THEN 'medium' ELSE 'low' END AS badge FROM facts JOIN b USING (metric, field) WHERE feature IS NULL AND value IS NOT NULL""")
def a7(spark, sf_dir):
    return score.badges(checked_facts(spark, sf_dir, all_pairs=True))


@register("a8_feature_rows", f"""WITH {FACTS} SELECT variant, 'information_loss' AS kind, feature, value FROM facts
WHERE metric = 'kl_divergence' AND field = 'kl' UNION ALL SELECT variant, 'privacy_risk', feature, value FROM facts
WHERE metric = 'attribute_disclosure' AND field = 'normalized_difference'""")
def a8(spark, sf_dir):
    facts = checked_facts(spark, sf_dir)
    return (score.information_loss(facts).withColumn("kind", F.lit("information_loss"))
            .unionByName(score.privacy_risk(facts).withColumn("kind", F.lit("privacy_risk"))))


@register("a9_variant_comparison", f"""{SCORES} SELECT variant, {_RATING} AS rating, {S.num('overall')} AS overall,
{S.num('fidelity')} AS fidelity, {S.num('diversity')} AS diversity, {S.num('privacy')} AS privacy, {S.num('utility')} AS utility FROM sa""")
def a9(spark, sf_dir):
    return score.comparison_table(checked_facts(spark, sf_dir))


_SHEETS = " UNION ALL ".join(
    f"SELECT variant, '{sheet}' AS sheet, {i}::INTEGER AS position, '{caption}' AS caption, {_pick(metric, field)} AS value FROM facts GROUP BY variant"
    for sheet, rows in report.SHEETS.items() for i, (caption, metric, field) in enumerate(rows))


@register("s7_report_sheets", f"WITH {ALL_PAIRS} {_SHEETS}")
def s7(spark, sf_dir):
    return report.detail_sheets(checked_facts(spark, sf_dir, all_pairs=True))


@register("s7_model_sheet", f"""WITH {FACTS} SELECT variant, feature AS model, p::INTEGER AS position, c AS caption, max(value) AS value FROM facts
JOIN (VALUES (5, 'Combined test accuracy', 'accuracy'), (6, 'Combined test f1 (weighted)', 'f1_weighted')) r(p, c, field) USING (field)
WHERE dimension = 'utility' AND metric = 'combined' AND feature IS NOT NULL GROUP BY ALL""")
def s7_models(spark, sf_dir):
    return report.model_sheet(checked_facts(spark, sf_dir))


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register("s1_csv_round_trip", """SELECT p_brand, count(*)::BIGINT AS n, sum(p_size)::BIGINT AS sizes, round(sum(p_retailprice), 3) + 0.0 AS price
FROM part GROUP BY p_brand""")
def s1(spark, sf_dir):
    """Write CSV, read it back with inferred types, aggregate."""
    path = tables.write_table(table(spark, sf_dir, "part"), _folder(spark, "part") + ".csv")
    return (tables.load_table(spark, path).groupBy("p_brand")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("sizes"),
                 (F.round(F.sum("p_retailprice"), 3) + 0.0).alias("price")))


@register("s2_parquet_source", """SELECT c_mktsegment, count(*)::BIGINT AS n, round(sum(c_acctbal), 3) + 0.0 AS balance
FROM customer GROUP BY c_mktsegment""")
def s2(spark, sf_dir):
    c = tables.load_table(spark, f"{sf_dir}/customer.parquet")
    return c.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), (F.round(F.sum("c_acctbal"), 3) + 0.0).alias("balance"))


@register("s5_partitioned_sink", """SELECT o_orderstatus AS technique, count(*)::BIGINT AS n, round(sum(o_totalprice), 3) + 0.0 AS price
FROM orders GROUP BY o_orderstatus""")
def s5(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("technique", F.col("o_orderstatus"))
    path = tables.write_table(o, _folder(spark, "orders"), "parquet", ["technique"])
    return (spark.read.parquet(path).groupBy("technique")
            .agg(F.count(F.lit(1)).alias("n"), (F.round(F.sum("o_totalprice"), 3) + 0.0).alias("price")))


@register("s6_results_json", f"""WITH {ALL_PAIRS} SELECT variant, dimension, metric, (feature IS NOT NULL) AS per_feature,
coalesce(feature || '.', '') || field AS name, {S.num('value')} AS value, label FROM facts""")
def s6(spark, sf_dir):
    """Export to nested JSON and read the leaves back."""
    text = report.results_json(checked_facts(spark, sf_dir, all_pairs=True))
    parsed = text.select("variant", F.from_json("json", "map<string,map<string,map<string,string>>>").alias("d"))
    leaves = (parsed.select("variant", F.explode("d").alias("dimension", "m"))
              .select("variant", "dimension", F.explode("m").alias("metric", "f"))
              .select("variant", "dimension", "metric", F.explode("f").alias("name", "value")))
    return leaves.select("variant", "dimension", "metric", F.contains("name", F.lit(".")).alias("per_feature"), "name",
                         tidy(F.expr("try_cast(value AS double)")).alias("value"),
                         F.when(F.expr("try_cast(value AS double)").isNull(), F.col("value")).alias("label"))


@register("s8_tagged_variants", """SELECT variant, count(*)::BIGINT AS n, count(segment)::BIGINT AS segments, round(avg(balance), 4) + 0.0 AS balance FROM (
SELECT 'customer' AS variant, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL
SELECT 'supplier', s_acctbal, NULL FROM supplier) GROUP BY variant""")
def s8(spark, sf_dir):
    both = tables.tagged_variants({
        "customer": table(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")),
        "supplier": table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("balance"))})
    return both.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.count("segment").alias("segments"),
                                       (F.round(F.avg("balance"), 4) + 0.0).alias("balance"))


@register("s9_pair_ingest", f"""SELECT 'customer' AS name, count(*)::DOUBLE AS n_rows, NULL::DOUBLE AS size_ratio FROM customer UNION ALL
SELECT 'orders', count(*), NULL FROM orders UNION ALL
SELECT 'pair', NULL, {S.num('(SELECT count(*) FROM orders) / (SELECT count(*) FROM customer)::DOUBLE')}""")
def s9(spark, sf_dir):
    left, right = (tables.load_table(spark, f"{sf_dir}/{n}.parquet") for n in ("customer", "orders"))
    counts = table_counts(left, "customer").unionByName(table_counts(right, "orders"))
    check = validate_pair(left, right).where("item = 'size_ratio'")
    return (counts.select("name", F.col("n_rows").cast("double").alias("n_rows"), F.lit(None).cast("double").alias("size_ratio"))
            .unionByName(check.select(F.lit("pair").alias("name"), F.lit(None).cast("double").alias("n_rows"),
                                      F.col("value").alias("size_ratio"))))


@register("s3_jdbc_query", "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier WHERE s_acctbal > 0")
def s3(spark, sf_dir):
    """Write suppliers to an in-process database and read a query back in four tasks."""
    url = f"jdbc:derby:memory:m{uuid.uuid4().hex};create=true"
    driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    (table(spark, sf_dir, "supplier").coalesce(1).write.format("jdbc").option("url", url).option("dbtable", "supplier")
     .option("driver", driver).save())
    top = table(spark, sf_dir, "supplier").agg(F.max("s_suppkey")).first()[0]
    return tables.load_query(spark, {
        "url": url, "driver": driver, "query": 'SELECT "s_suppkey", "s_nationkey", "s_acctbal" FROM supplier WHERE "s_acctbal" > 0',
        "partition_column": '"s_suppkey"', "lower": 0, "upper": top + 1, "partitions": 4})


@register("s4_database_landing", """SELECT 'nation' AS name, count(*) AS n_rows, 3::INTEGER AS n_columns, 2::INTEGER AS n_numeric, 1::INTEGER AS n_categorical,
'n_nationkey,n_name,n_regionkey' AS columns, 'n_nationkey,n_regionkey' AS numeric_columns, 'n_name' AS categorical_columns FROM nation""")
def s4(spark, sf_dir):
    url = f"jdbc:derby:memory:m{uuid.uuid4().hex};create=true"
    driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    (table(spark, sf_dir, "nation").coalesce(1).write.format("jdbc").option("url", url).option("dbtable", "nation")
     .option("driver", driver).save())
    _, counts = tables.land_query(spark, {"url": url, "driver": driver, "query": "SELECT * FROM nation", "name": "nation"},
                                  _folder(spark, "nation"))
    return counts


def analysis_rows(spark, sf_dir) -> DataFrame:
    """Orders read as analysis records, so history work grows with the table."""
    o = table(spark, sf_dir, "orders")
    s = F.col("o_totalprice") / 600011.0
    return o.select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderdate").cast("timestamp").alias("timestamp"),
        F.col("o_orderpriority").alias("dataset_name"), F.col("o_custkey").alias("original_dataset_rows"),
        F.col("o_orderkey").alias("augmented_dataset_rows"), s.alias("overall_score"), score.rating(s).alias("rating"),
        F.to_json(F.struct(F.struct(F.struct(F.col("o_orderstatus").alias("status")).alias("order")).alias("summary"))).alias("metrics_json"))


_HIST_COLS = "id, dataset_name, original_dataset_rows, rating, overall_score"
_HIST_SQL = f"""h AS (SELECT o_orderkey::VARCHAR AS id, o_orderdate AS ts, o_orderpriority AS dataset_name, o_custkey AS original_dataset_rows,
 round(o_totalprice / 600011.0, 6) + 0.0 AS overall_score, CASE WHEN o_totalprice / 600011.0 >= 0.8 THEN 'Excellent' WHEN o_totalprice / 600011.0 >= 0.6 THEN 'Good'
 WHEN o_totalprice / 600011.0 >= 0.4 THEN 'Fair' WHEN o_totalprice / 600011.0 >= 0.2 THEN 'Adequate' ELSE 'Poor' END AS rating, o_orderstatus FROM orders)"""


def _history(spark, sf_dir) -> DataFrame:
    path = _folder(spark, "history")
    history.append_analyses(analysis_rows(spark, sf_dir), path)
    return history.read_analyses(spark, path)


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("id", "dataset_name", "original_dataset_rows", "rating", tidy(F.col("overall_score")).alias("overall_score"))


@register("h1_append_analyses", f"WITH {_HIST_SQL} SELECT {_HIST_COLS} FROM h")
def h1(spark, sf_dir):
    return _shown(_history(spark, sf_dir))


@register("h8_analysis_record", f"""{ALL_PAIRS_SCORES}, n AS (SELECT 'parts' AS variant, (SELECT count(*) FROM part) AS o, (SELECT count(*) FROM part) AS a UNION ALL
SELECT 'accounts', (SELECT count(*) FROM customer), (SELECT count(*) FROM supplier))
SELECT variant AS dataset_name, o AS original_dataset_rows, a AS augmented_dataset_rows, {S.num('fidelity')} AS fidelity_score,
{S.num('diversity')} AS diversity_score, {S.num('privacy')} AS privacy_score, {S.num('utility')} AS utility_score, {S.num('overall')} AS overall_score,
{_RATING} AS rating, TRUE AS has_summary FROM sa JOIN n USING (variant)""")
def h8(spark, sf_dir):
    """An analysis with its validation and summaries, stored and read back."""
    parts = [checked_facts(spark, sf_dir, all_pairs=True)]
    for variant, pair in (("parts", part_pair(spark, sf_dir)), ("accounts", account_pair(spark, sf_dir))):
        parts += [f.withColumn("variant", F.lit(variant)) for f in (
            validation_facts(pair.orig, pair.aug), summary_facts(pair.orig, "original"), summary_facts(pair.aug, "augmented"))]
    path = _folder(spark, "history")
    history.append_analyses(history_rows(materialize_all(parts)), path)
    return history.read_analyses(spark, path).select(
        "dataset_name", "original_dataset_rows", "augmented_dataset_rows", "fidelity_score", "diversity_score", "privacy_score",
        "utility_score", "overall_score", "rating", F.get_json_object("metrics_json", "$.summary.original").isNotNull().alias("has_summary"))


@register("h2_recent_analyses", f"WITH {_HIST_SQL} SELECT {_HIST_COLS} FROM (SELECT * FROM h ORDER BY ts DESC, id LIMIT 10)")
def h2(spark, sf_dir):
    return _shown(history.recent(_history(spark, sf_dir), 10))


@register("h3_analysis_by_id", f"WITH {_HIST_SQL} SELECT {_HIST_COLS} FROM h WHERE id = (SELECT max(o_orderkey)::VARCHAR FROM orders)")
def h3(spark, sf_dir):
    last = table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0]
    return _shown(history.by_id(_history(spark, sf_dir), str(last)))


@register("h6_parsed_metrics", f"WITH {_HIST_SQL} SELECT id, o_orderstatus AS status FROM h")
def h6(spark, sf_dir):
    return history.with_metrics(_history(spark, sf_dir)).select("id", F.col("metrics")["summary"]["order"]["status"].alias("status"))


def _suggestions(spark, sf_dir) -> DataFrame:
    path = _folder(spark, "suggestions")
    c = table(spark, sf_dir, "conversations")
    rows = c.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("conv_id").cast("string").alias("analysis_id"),
                    F.timestamp_seconds(F.col("conv_id") * 100 + F.col("turn")).alias("timestamp"),
                    F.col("role").alias("suggestion_type"), F.col("text").alias("suggestion_text"), F.lit("medium").alias("priority"))
    history.append_suggestions(rows, path)
    return history.read_suggestions(spark, path)


_SUG = """s AS (SELECT conv_id || '-' || turn AS id, conv_id::VARCHAR AS analysis_id, conv_id * 100 + turn AS ts, role AS suggestion_type,
 length(text)::BIGINT AS n FROM conversations)"""


@register("h4_append_suggestions", f"WITH {_SUG} SELECT id, analysis_id, suggestion_type, n FROM s")
def h4(spark, sf_dir):
    return _suggestions(spark, sf_dir).select("id", "analysis_id", "suggestion_type",
                                              F.length("suggestion_text").cast("bigint").alias("n"))


@register("h5_suggestions_for", f"""WITH {_SUG} SELECT id, suggestion_type FROM s WHERE analysis_id = (SELECT max(conv_id)::VARCHAR FROM conversations)
ORDER BY ts DESC, id LIMIT 10""")
def h5(spark, sf_dir):
    last = table(spark, sf_dir, "conversations").agg(F.max("conv_id")).first()[0]
    return history.suggestions_for(_suggestions(spark, sf_dir), str(last), 10).select("id", "suggestion_type")


_TAGGED = """CASE turn % 4 WHEN 0 THEN '[PRIORITY: HIGH] [CATEGORY: Privacy] ' WHEN 1 THEN '[priority: low] [CATEGORY: FIDELITY] '
 WHEN 2 THEN '[CATEGORY: Diversity] ' ELSE '' END || text"""
_STRIP = "l"
for _m in history.MARKERS:
    _STRIP = f"replace(replace({_STRIP}, '{_m}', ''), '{_m.lower()}', '')"
_WS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


@register("h7_parse_suggestions", f"""WITH t AS (SELECT conv_id, turn, unnest(string_split({_TAGGED}, chr(10))) AS raw,
 generate_subscripts(string_split({_TAGGED}, chr(10)), 1) - 1 AS line FROM conversations),
l AS (SELECT conv_id, turn, line, trim(raw, {_WS}) AS l FROM t), u AS (SELECT *, upper(l) AS u FROM l WHERE length(l) >= 10),
p AS (SELECT conv_id, turn, line::INTEGER AS line, CASE WHEN contains(u, '[PRIORITY:') AND contains(u, 'HIGH') THEN 'high'
 WHEN contains(u, '[PRIORITY:') AND contains(u, 'LOW') THEN 'low' ELSE 'medium' END AS priority,
 CASE WHEN NOT contains(u, '[CATEGORY:') THEN 'general' WHEN contains(u, 'FIDELITY') THEN 'fidelity' WHEN contains(u, 'DIVERSITY') THEN 'diversity'
 WHEN contains(u, 'PRIVACY') THEN 'privacy' WHEN contains(u, 'UTILITY') THEN 'utility' ELSE 'general' END AS "type", trim({_STRIP}, {_WS}) AS text FROM u)
SELECT * FROM p WHERE text <> ''""")
def h7(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    tag = (F.when(F.col("turn") % 4 == 0, "[PRIORITY: HIGH] [CATEGORY: Privacy] ")
           .when(F.col("turn") % 4 == 1, "[priority: low] [CATEGORY: FIDELITY] ")
           .when(F.col("turn") % 4 == 2, "[CATEGORY: Diversity] ").otherwise(""))
    keyed = c.select(F.struct("conv_id", "turn").alias("k"), F.concat(tag, F.col("text")).alias("text"))
    return history.parse_suggestions(keyed, "k", "text").select("k.conv_id", "k.turn", "line", "priority", "type", "text")
