"""The whole analysis of one pair, or of one original and many variants."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.facts import union_all
from twinlens.functions.numbers import tidy
from twinlens.learning.utility import utility_facts
from twinlens.operators import diversity, fidelity, privacy, profile
from twinlens.pair import Pair, numeric_columns
from twinlens.plans.report import results_json
from twinlens.plans.score import pick, score_facts, variant_scores
from twinlens.session import materialize_all

_EXTRA_METRICS: dict[str, Callable[[Pair], DataFrame]] = {}


def metric(name: str) -> Callable:
    """Register an own metric: a function from a pair to fact rows."""
    def wrap(fn: Callable[[Pair], DataFrame]) -> Callable[[Pair], DataFrame]:
        _EXTRA_METRICS[name] = fn
        return fn

    return wrap


def _error(pair: Pair, dimension: str, message: str) -> DataFrame:
    return pair.orig.sparkSession.range(1).select(
        F.lit("validation").alias("dimension"), F.lit(dimension).alias("metric"), F.lit(None).cast("string").alias("feature"),
        F.lit("error").alias("field"), F.lit(None).cast("double").alias("value"), F.lit(message).alias("label"))


def _guarded(pair: Pair, dimension: str, build: Callable[[], list[DataFrame]], common: bool = True) -> DataFrame:
    """Facts of a dimension, written once; a failure leaves an error fact instead. ``common``: it needs common columns."""
    if common and not pair.cols:
        return _error(pair, dimension, "no common numeric column")
    try:
        return materialize_all(build())
    except Exception as e:  # noqa: BLE001 - one failing dimension must not stop the others
        return _error(pair, dimension, str(e)[:500])


def validation_facts(orig: DataFrame, aug: DataFrame) -> DataFrame:
    """Shapes, errors and warnings of the two tables as facts."""
    return profile.validate_pair(orig, aug).select(
        F.lit("validation").alias("dimension"), F.col("kind").alias("metric"), F.lit(None).cast("string").alias("feature"),
        F.col("item").alias("field"), F.col("value").cast("double").alias("value"), F.lit(None).cast("string").alias("label"))


def summary_facts(df: DataFrame, side: str) -> DataFrame:
    """Exact column summaries of one table as facts of metric ``side``."""
    if not numeric_columns(df):
        return df.sparkSession.createDataFrame([], "dimension string, metric string, feature string, field string, value double, label string")
    d = profile.describe(df)
    fields = [c for c in d.columns if c != "column"]
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in fields])
    return d.select("column", F.inline(cells)).select(
        F.lit("summary").alias("dimension"), F.lit(side).alias("metric"), F.col("column").alias("feature"), "field", "value",
        F.lit(None).cast("string").alias("label"))


def analyze(pair: Pair, variant: str = "main") -> DataFrame:
    """Metric, validation and summary facts of a pair with a ``variant`` column."""
    def diversity_parts() -> list[DataFrame]:
        c = diversity.clustered(pair)
        return [f(pair) for f in diversity.PAIR_METRICS.values()] + [f(c) for f in diversity.CLUSTER_METRICS.values()]

    def privacy_parts() -> list[DataFrame]:
        near = privacy.pair_neighbors(pair)
        return [privacy.nearest_neighbor_risk(near), privacy.membership_inference(pair),
                privacy.attribute_disclosure(pair, near), privacy.distance_to_closest(pair, near),
                privacy.uniqueness(pair), privacy.k_anonymity(pair), privacy.l_diversity(pair)]

    parts = [_guarded(pair, "fidelity", lambda: [f(pair) for f in fidelity.METRICS.values()]),
             _guarded(pair, "diversity", diversity_parts), _guarded(pair, "privacy", privacy_parts),
             validation_facts(pair.orig, pair.aug),
             _guarded(pair, "summary", lambda: [summary_facts(pair.orig, "original"), summary_facts(pair.aug, "augmented")], common=False)]
    parts += [_guarded(pair, name, lambda fn=fn: [fn(pair)]) for name, fn in _EXTRA_METRICS.items()]
    return union_all(parts).withColumn("variant", F.lit(variant))


def compare(orig: DataFrame, variants: dict[str, DataFrame], key: str | None = None,
            weights: dict[str, float] | None = None, utility: dict[str, DataFrame] | None = None) -> DataFrame:
    """Metric facts and scores of every variant against one original.

    ``utility`` holds the results of ``learning.utility.evaluate`` of some variants.
    """
    parts = [analyze(Pair(orig, aug, key), name) for name, aug in variants.items()]
    parts += [utility_facts(results, name) for name, results in (utility or {}).items()]
    facts = union_all(parts)
    return facts.unionByName(score_facts(facts, weights))


def history_rows(facts: DataFrame, dataset_name: str | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """One record per variant for ``sources.history.append_analyses``: counts, scores, rating and all results as JSON.

    The record is named after ``dataset_name``, or the variant.
    """
    scores = variant_scores(facts, weights)
    counts = facts.groupBy("variant").agg(pick("info", "original_rows", "validation").cast("bigint").alias("original_dataset_rows"),
                                          pick("info", "augmented_rows", "validation").cast("bigint").alias("augmented_dataset_rows"))
    named = F.col("variant") if dataset_name is None else F.concat(F.lit(dataset_name + " / "), F.col("variant"))
    score = lambda c: F.coalesce(tidy(F.col(c)), F.lit(0.0)).alias(f"{c}_score")
    return (scores.join(counts, "variant").join(results_json(facts).withColumnRenamed("json", "metrics_json"), "variant")
            .select(named.alias("dataset_name"), "original_dataset_rows", "augmented_dataset_rows",
                    *[score(c) for c in ("fidelity", "diversity", "privacy", "utility", "overall")], "rating", "metrics_json"))
