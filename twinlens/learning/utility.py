"""Does the augmented table help a classifier? Train on original, augmented, both."""

from __future__ import annotations

import math
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinlens.functions.hashing import hash_uniform
from twinlens.functions.numbers import grade, sql_name
from twinlens.learning.models import Context, predict
from twinlens.operators.ranking import row_number_global
from twinlens.operators.summaries import collect_stats
from twinlens.pair import double_or_null, numeric_columns
from twinlens.session import materialize

MAX_CLASSES = 10_000
SCENARIOS = ("original_only", "augmented_only", "combined")


def target_column(orig: DataFrame, aug: DataFrame, wanted: str | None = None) -> str:
    """The named column, else ``category``, else the last one if both tables agree."""
    both = set(orig.columns) & set(aug.columns)
    for name in (wanted, "category"):
        if name and name in both:
            return name
    if orig.columns[-1] != aug.columns[-1]:
        raise ValueError(f"last columns differ: {orig.columns[-1]} and {aug.columns[-1]}")
    return orig.columns[-1]


def label_codes(tables: list[DataFrame], target: str) -> dict:
    """Label -> code in sorted order over all tables; the number of classes is checked."""
    labels = None
    for df in tables:
        one = df.select(target).where(F.col(target).isNotNull()).distinct()
        labels = one if labels is None else labels.unionByName(one)
    values = [r[0] for r in labels.distinct().limit(MAX_CLASSES + 1).collect()]
    if len(values) > MAX_CLASSES:
        raise ValueError(f"column {target} has too many values to be a class")
    return {v: float(i) for i, v in enumerate(sorted(values))}


def prepare(df: DataFrame, features: list[str], target: str, codes: dict, key: str | None = None) -> DataFrame:
    """(row_id, label, features...): numeric columns with means filled in, coded label."""
    ids = [F.col(key).alias("row_id")] if key else []
    x = df.select(*ids, F.col(target).alias("__y"), *[double_or_null(df, c) for c in features])
    means = {c: s["mean"] for c, s in collect_stats(x, features).items()}
    schema = T.StructType([T.StructField("__y", df.schema[target].dataType), T.StructField("label", T.DoubleType())])
    lookup = df.sparkSession.createDataFrame(list(codes.items()), schema)
    filled = x.join(F.broadcast(lookup), "__y").select(  # one row per class
        *(["row_id"] if key else []), "label",
        *[F.coalesce(F.col(c), F.lit(means[c])).alias(c) for c in features])
    return filled if key else row_number_global(filled, None, "row_id")


def stratified_rank(df: DataFrame, stream: str, seed: int = 42) -> DataFrame:
    """Add ``__rank``: position of a row inside its label in hashed order."""
    mixed = df.withColumn("__u", hash_uniform(seed, stream, F.col("row_id")))
    return row_number_global(mixed, "__u", "__rank", by=["label"], tie=["row_id"]).drop("__u")


def stratified_split(df: DataFrame, stream: str = "split", share: float = 0.7, seed: int = 42) -> DataFrame:
    """Add ``train``: the first ceil(share * n) rows of every label."""
    sizes = df.groupBy("label").agg(F.count(F.lit(1)).alias("__n"))
    ranked = stratified_rank(df, stream, seed).join(F.broadcast(sizes), "label")  # a row per class, bounded by label_codes
    return ranked.withColumn("train", F.col("__rank") < F.ceil(F.round(F.lit(share) * F.col("__n"), 6))).drop("__rank", "__n")


def folds(df: DataFrame, k: int, stream: str = "fold", seed: int = 42) -> DataFrame:
    """Add ``fold`` in 0..k-1, dealt out in hashed order inside every label."""
    return (stratified_rank(df, stream, seed)
            .withColumn("fold", F.pmod(F.col("__rank"), F.lit(k)).cast("int")).drop("__rank"))


def confusion(predictions: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by..., label, prediction, n)."""
    return predictions.groupBy(*by, "label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(predictions: DataFrame, classes: int) -> DataFrame:
    """A row per true label, a column per predicted one."""
    return (confusion(predictions).groupBy("label").pivot("prediction", [float(c) for c in range(classes)])
            .agg(F.sum("n")).fillna(0))


def classification_metrics(predictions: DataFrame, by: list[str] = (), weighted: bool = False) -> DataFrame:
    """(by..., accuracy, precision, recall, f1, n): weighted over labels, or of class 1.

    Two labels in the test rows mean the figures of class 1, unless ``weighted``.
    """
    by = list(by)
    c = confusion(predictions, by)
    sides = F.explode(F.array(
        F.struct(F.col("label").alias("k"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("guessed"),
                 F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("prediction").alias("k"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("guessed"),
                 F.lit(0).cast("bigint").alias("hit")))).alias("s")
    per = (c.select(*by, sides).select(*by, "s.*").groupBy(*by, "k")
           .agg(F.sum("support").alias("support"), F.sum("guessed").alias("guessed"), F.sum("hit").alias("hit")))
    per = per.selectExpr(
        *[sql_name(b) for b in by], "k", "support", "hit", "coalesce(hit / nullif(guessed, 0), 0D) AS p",
        "coalesce(hit / nullif(support, 0), 0D) AS r", "coalesce(2 * hit / nullif(support + guessed, 0), 0D) AS f")

    def figure(x: str) -> str:
        whole = f"sum(support * {x}) / sum(support)"
        if weighted:
            return whole
        return (f"CASE WHEN count_if(support > 0) = 2 THEN coalesce(max(CASE WHEN k = 1 THEN {x} END), 0D) ELSE {whole} END")

    return per.groupBy(*by).agg(
        F.expr("sum(hit) / sum(support)").alias("accuracy"), F.expr(figure("p")).alias("precision"),
        F.expr(figure("r")).alias("recall"), F.expr(figure("f")).alias("f1"), F.sum("support").alias("n"))


ROWS_PER_TASK = 100_000  # iterative fits run a job per step: tiny tables need no more than one task


def standardized(train: DataFrame, others: list[DataFrame], cols: list[str]) -> tuple[list[DataFrame], int]:
    """Scale by the training rows' mean and population deviation; add ``features``.

    Also returns the number of training rows.
    """
    s = collect_stats(train, cols)
    text = [f"({sql_name(c)} - ({s[c]['mean']!r}D)) / ({(s[c]['std_pop'] or 1.0)!r}D) AS {sql_name(c)}" for c in cols]
    vectors = VectorAssembler(inputCols=cols, outputCol="features")
    scaled = [vectors.transform(df.selectExpr("row_id", "label", *text)) for df in [train, *others]]
    return scaled, int(s[cols[0]]["n"])


def in_rounds(train: DataFrame, n_rows: int) -> DataFrame:
    """Training rows for iterative fits: one task if they are few, else even shares in full rounds over all cores."""
    few = max(1, -(-n_rows // ROWS_PER_TASK))
    if few == 1:
        return train.coalesce(1)
    cores = train.sparkSession.sparkContext.defaultParallelism
    return train.repartition(-(-few // cores) * cores)


def fit_predict(name: str, params: dict, train: DataFrame, test: DataFrame, cols: list[str], classes: int) -> DataFrame:
    (scaled, probe), n = standardized(train, [test], cols)
    scaled = in_rounds(scaled, n).persist()
    try:
        ctx = Context(tuple(cols), classes, n)
        return materialize(predict(name, scaled, probe, ctx, params))
    finally:
        scaled.unpersist()


def cross_validate(name: str, params: dict, train: DataFrame, cols: list[str], classes: int, k: int) -> DataFrame:
    """(fold, accuracy, precision, recall, f1, n), weighted figures; folds run side by side."""
    dealt = materialize(folds(train, k))

    def one(f: int) -> DataFrame:
        return fit_predict(name, params, dealt.where(F.col("fold") != f), dealt.where(F.col("fold") == f), cols,
                           classes).withColumn("fold", F.lit(f))

    with ThreadPoolExecutor(4) as pool:
        parts = list(pool.map(one, range(k)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return classification_metrics(out, ["fold"], weighted=True)


@dataclass
class Prepared:
    """Training rows per scenario and the held-out original rows."""

    trains: dict[str, DataFrame]
    test: DataFrame
    features: list[str]
    classes: int
    info: DataFrame


def prepare_scenarios(orig: DataFrame, aug: DataFrame, target: str | None = None, key: str | None = None,
                      leaky: bool = False) -> Prepared:
    """Split, and build the three training sets.

    The combined set leaves held-out rows out unless ``leaky``.
    """
    target = target_column(orig, aug, target)
    features = [c for c in numeric_columns(orig) if c not in (target, key) and c in set(aug.columns)]
    codes = label_codes([orig, aug], target)
    o = materialize(stratified_split(prepare(orig, features, target, codes, key), "split.o"))
    a = materialize(stratified_split(prepare(aug, features, target, codes, key), "split.a"))
    pool = (o if leaky else o.where("train")).withColumn("row_id", F.concat(F.lit("o"), F.col("row_id")))
    mixed = pool.unionByName(a.withColumn("row_id", F.concat(F.lit("a"), F.col("row_id")))).drop("train")
    both = materialize(stratified_split(mixed, "split.c"))
    trains = {"original_only": o.where("train"), "augmented_only": a.where("train"), "combined": both.where("train")}
    counts = (o.agg(F.count(F.lit(1)).alias("original_samples"), F.sum((~F.col("train")).cast("bigint")).alias("test_samples"),
                    F.countDistinct("label").alias("n_classes")))
    info = counts.withColumns({"augmented_samples": F.lit(a.count()), "n_features": F.lit(len(features))})
    return Prepared({k: v.drop("train") for k, v in trains.items()}, o.where("NOT train").drop("train"), features,
                    len(codes), info)


def fold_rows(name: str, scenario: str, cv: DataFrame, k: int, cv_metric: str) -> list[tuple]:
    """Figures of every fold, their means and deviations; k rows come back."""
    figures, out = ("accuracy", "precision", "recall", "f1"), [(name, scenario, "cv_n_folds", float(k))]
    folds = sorted(cv.select("fold", *figures).collect(), key=lambda r: r["fold"])
    short = cv_metric.replace("_weighted", "")
    for m in figures:
        values = [float(r[m]) for r in folds]
        mean = sum(values) / len(values)
        spread = math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))
        out += [(name, scenario, f"cv_{m}_{r['fold']}", v) for r, v in zip(folds, values)]
        out += [(name, scenario, f"cv_{m}_mean", mean), (name, scenario, f"cv_{m}_std", spread)]
        if m == short:
            out += [(name, scenario, "cv_mean", mean), (name, scenario, "cv_std", spread)]
            out += [(name, scenario, f"cv_score_{r['fold']}", v) for r, v in zip(folds, values)]
    return out


def reason(problem: Exception) -> str:
    """Kind and first line of an error's message."""
    lines = str(problem).strip().splitlines()
    return f"{type(problem).__name__}: {lines[0]}" if lines else type(problem).__name__


def matrix_cells(predictions: DataFrame) -> DataFrame:
    """(field, value): ``confusion_<label>_<prediction>`` and how many rows it counts, for cells that are not zero."""
    code = lambda c: F.col(c).cast("int").cast("string")
    return confusion(predictions).select(F.concat_ws("_", F.lit("confusion"), code("label"), code("prediction")).alias("field"),
                                         F.col("n").cast("double").alias("value"))


def evaluate(p: Prepared, configs: list[dict], use_cv: bool = False, cv_folds: int = 5, cv_metric: str = "accuracy") -> DataFrame:
    """(model, scenario, field, value, label): test figures, sizes, fit seconds, fold figures with mean and deviation.

    A model that fails in a scenario leaves one row there, field ``failed``, with the reason as label; a failing
    cross-validation leaves ``cv_failed`` beside the test figures. The folds of ``cv_metric`` are repeated as
    ``cv_score_<fold>``. Cells of the confusion matrix that are not zero are ``confusion_<label>_<prediction>``; they
    stay a table, since their number grows with the classes.

    ``configs`` holds {type, params, cv}. Models and scenarios are submitted from a small
    pool; the scheduler overlaps their jobs.
    """
    spark = p.test.sparkSession
    jobs = [(c, s) for c in configs for s in SCENARIOS]
    sizes = {s: p.trains[s].count() for s in SCENARIOS}
    n_test = p.test.count()

    cells: list[DataFrame] = []

    def guarded(job: tuple[dict, str]) -> list[tuple]:
        try:
            return one(job)
        except Exception as problem:  # noqa: BLE001 - one failing model must not stop the others
            return [(job[0]["type"], job[1], "failed", 1.0, reason(problem))]

    def one(job: tuple[dict, str]) -> list[tuple]:
        config, scenario = job
        name, params = config["type"], config.get("params") or {}
        start = time.time()
        test = p.test.withColumn("row_id", F.concat(F.lit("o"), F.col("row_id"))) if scenario == "combined" else p.test
        predicted = fit_predict(name, params, p.trains[scenario], test, p.features, p.classes)
        figures = classification_metrics(predicted).first()
        rows = [(name, scenario, "accuracy", figures["accuracy"]), (name, scenario, "precision", figures["precision"]),
                (name, scenario, "recall", figures["recall"]), (name, scenario, "f1_weighted", figures["f1"]),
                (name, scenario, "training_time_seconds", time.time() - start),
                (name, scenario, "n_train_samples", float(sizes[scenario])), (name, scenario, "n_test_samples", float(n_test))]
        k = int(config.get("cv", cv_folds))
        if use_cv and k >= 2 and sizes[scenario] >= k:
            try:
                rows += fold_rows(name, scenario, cross_validate(name, params, p.trains[scenario], p.features, p.classes, k), k, cv_metric)
            except Exception as problem:  # noqa: BLE001 - the test figures stand without it
                rows.append((name, scenario, "cv_failed", 1.0, reason(problem)))
        cells.append(matrix_cells(predicted).select(F.lit(name).alias("model"), F.lit(scenario).alias("scenario"), "field", "value"))
        return rows

    with ThreadPoolExecutor(3) as pool:
        done = [(*row, None)[:5] for rows in pool.map(guarded, jobs) for row in rows]
    out = spark.createDataFrame(done, "model string, scenario string, field string, value double, label string")
    for part in cells:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def model_table(results: DataFrame) -> DataFrame:
    """(model, per-scenario accuracy and F1, improvements, quality word), one row per model."""
    def at(scenario: str, field: str):
        return F.max(F.when((F.col("scenario") == scenario) & (F.col("field") == field), F.col("value")))

    wide = results.groupBy("model").agg(
        *[at(s, "accuracy").alias(f"{s}_accuracy") for s in SCENARIOS],
        *[at(s, "f1_weighted").alias(f"{s}_f1") for s in SCENARIOS],
        at("combined", "cv_mean").alias("cv_mean"), at("combined", "cv_std").alias("cv_std"),
        at("original_only", "training_time_seconds").alias("seconds"))
    gain = F.col("combined_accuracy") - F.col("original_only_accuracy")
    quality = (F.when((gain > 0.05) & (F.col("augmented_only_accuracy") > 0.6), "high")
               .when((gain > 0.02) | (F.col("augmented_only_accuracy") > 0.5), "medium").otherwise("low"))
    return wide.withColumns({"improvement_accuracy": gain,
                             "improvement_f1": F.col("combined_f1") - F.col("original_only_f1"), "quality": quality})


def overall_row(models: DataFrame) -> DataFrame:
    """One row: average improvements, overall score, verdict and best model."""
    row = models.agg(
        F.avg("improvement_accuracy").alias("average_improvement_accuracy"),
        F.avg("improvement_f1").alias("average_improvement_f1"), F.avg("combined_accuracy").alias("__acc"),
        F.max(F.struct("combined_accuracy", "model", "combined_f1")).alias("__best"))
    gain = F.col("average_improvement_accuracy")
    lift = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (gain + 0.1) / 0.2))
    verdict = grade(gain, [("Excellent utility", ">", 0.05), ("Good utility", ">", 0.02), ("Neutral utility", ">", -0.02)],
                    "Poor utility")
    return row.select("average_improvement_accuracy", "average_improvement_f1",
                      (0.6 * lift + 0.4 * F.col("__acc")).alias("overall_utility_score"), verdict.alias("verdict"),
                      F.col("__best")["model"].alias("best_model"), F.col("__best")["combined_accuracy"].alias("best_accuracy"),
                      F.col("__best")["combined_f1"].alias("best_f1"))


def utility_facts(results: DataFrame, variant: str = "main") -> DataFrame:
    """Metric facts of dimension ``utility``: per model under ``feature``, and overall."""
    none = F.lit(None).cast("string")
    per = results.select(F.lit("utility").alias("dimension"), F.col("scenario").alias("metric"), F.col("model").alias("feature"),
                         "field", "value", F.col("label") if "label" in results.columns else none.alias("label"))
    o = overall_row(model_table(results))
    names = ["average_improvement_accuracy", "average_improvement_f1", "overall_utility_score", "best_accuracy", "best_f1"]
    cells = F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("value"), none.alias("label")) for n in names],
                    *[F.struct(F.lit(n).alias("field"), F.lit(None).cast("double").alias("value"), F.col(n).alias("label"))
                      for n in ("verdict", "best_model")])
    total = o.select(F.inline(cells)).select(F.lit("utility").alias("dimension"), F.lit("utility").alias("metric"),
                                             none.alias("feature"), "field", "value", "label")
    return per.unionByName(total).withColumn("variant", F.lit(variant))
