"""Utility and classifier queries on customers labelled by the side of the world they live on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.functions.hashing import hash_normal
from twinlens.functions.numbers import tidy
from twinlens.learning import boosting
from twinlens.learning import utility as U
from twinlens.plans import sqlkit as S
from twinlens.plans.pairs import table
from twinlens.plans.registry import register
from twinlens.session import materialize

FEATURES = ["nation", "balance"]


def people(spark, sf_dir) -> DataFrame:
    """Customers with gaps: nation, balance and the label ``side``."""
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("nation"),
                    F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"),
                    F.when(F.col("c_nationkey") * 100 + F.col("c_acctbal") / 20 < 1400, "east").otherwise("west").alias("side"))


def copies(spark, sf_dir) -> DataFrame:
    """The same customers with noisy measures: the augmented table."""
    p = people(spark, sf_dir)
    return p.select("c_custkey", (F.col("nation") + hash_normal(7, "copy.n", F.col("c_custkey"))).alias("nation"),
                    (F.col("balance") * 1.05).alias("balance"), "side")


_P = """p AS (SELECT c_custkey AS id, nullif(c_nationkey, 3)::DOUBLE AS nation, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance,
 CASE WHEN c_nationkey * 100 + c_acctbal / 20 < 1400 THEN 'east' ELSE 'west' END AS side FROM customer),
d AS (SELECT id AS row_id, (dense_rank() OVER (ORDER BY side) - 1)::DOUBLE AS label, coalesce(nation, avg(nation) OVER ()) AS nation,
 coalesce(balance, avg(balance) OVER ()) AS balance FROM p)"""


def _rank(stream: str) -> str:
    return f"row_number() OVER (PARTITION BY label ORDER BY {S.uniform(42, stream, 'row_id')}, row_id) - 1"


_SPLIT = f"""{_P}, sp AS (SELECT *, {_rank('split.o')} < ceil(round(0.7 * count(*) OVER (PARTITION BY label), 6)) AS train FROM d),
tr AS (SELECT * FROM sp WHERE train), te AS (SELECT * FROM sp WHERE NOT train)"""


def _prepared(spark, sf_dir) -> DataFrame:
    p = people(spark, sf_dir)
    return U.prepare(p, FEATURES, "side", U.label_codes([p, copies(spark, sf_dir)], "side"), "c_custkey")


@register("u1_prepared_data", f"WITH {_P} SELECT row_id, label, {S.num('nation')} AS nation, {S.num('balance')} AS balance FROM d")
def u1(spark, sf_dir):
    return _prepared(spark, sf_dir).select("row_id", "label", *[tidy(F.col(c)).alias(c) for c in FEATURES])


@register("u2_stratified_split", f"WITH {_SPLIT} SELECT row_id, label, train FROM sp")
def u2(spark, sf_dir):
    return U.stratified_split(_prepared(spark, sf_dir), "split.o").select("row_id", "label", "train")


@register("u5_fold_assignment", f"WITH {_P} SELECT row_id, (({_rank('fold')}) % 5)::INTEGER AS fold FROM d")
def u5(spark, sf_dir):
    return U.folds(_prepared(spark, sf_dir), 5).select("row_id", "fold")


def guesses(spark, sf_dir) -> DataFrame:
    """Two tasks with known predictions on every line: three classes, and two."""
    li = table(spark, sf_dir, "lineitem")
    flag = F.when(F.col("l_returnflag") == "A", 0.0).when(F.col("l_returnflag") == "N", 1.0).otherwise(2.0)
    three = li.select(F.lit("three").alias("task"), flag.alias("label"),
                      F.when(F.col("l_quantity") < 15, 0.0).when(F.col("l_quantity") < 30, 1.0).otherwise(2.0).alias("prediction"))
    two = li.select(F.lit("two").alias("task"), F.when(F.col("l_linestatus") == "F", 0.0).otherwise(1.0).alias("label"),
                    F.when(F.col("l_discount") < 0.03, 0.0).otherwise(1.0).alias("prediction"))
    return three.unionByName(two)


_GUESS = """g AS (SELECT 'three' AS task, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y,
 CASE WHEN l_quantity < 15 THEN 0 WHEN l_quantity < 30 THEN 1 ELSE 2 END AS z FROM lineitem UNION ALL
SELECT 'two', CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END, CASE WHEN l_discount < 0.03 THEN 0 ELSE 1 END FROM lineitem)"""


@register("u4_classification_metrics", f"""WITH {_GUESS}, k AS (SELECT DISTINCT task, y AS k FROM g),
c AS (SELECT k.task, k, sum((y = k)::INT) AS s, sum((z = k)::INT) AS gs, sum((y = k AND z = k)::INT) AS h FROM k JOIN g USING (task) GROUP BY k.task, k),
m AS (SELECT *, coalesce(h / nullif(gs, 0)::DOUBLE, 0) AS p, coalesce(h / nullif(s, 0)::DOUBLE, 0) AS r, 2 * h / (s + gs)::DOUBLE AS f FROM c)
SELECT task, {S.num('sum(h) / sum(s)')} AS accuracy, {S.num("CASE WHEN task = 'two' THEN max(p) FILTER (k = 1) ELSE sum(s * p) / sum(s) END")} AS "precision",
{S.num("CASE WHEN task = 'two' THEN max(r) FILTER (k = 1) ELSE sum(s * r) / sum(s) END")} AS recall,
{S.num("CASE WHEN task = 'two' THEN max(f) FILTER (k = 1) ELSE sum(s * f) / sum(s) END")} AS f1, sum(s)::BIGINT AS n FROM m GROUP BY task""")
def u4(spark, sf_dir):
    m = U.classification_metrics(guesses(spark, sf_dir), ["task"])
    return m.select("task", *[tidy(F.col(c)).alias(c) for c in ("accuracy", "precision", "recall", "f1")], "n")


@register("u4_confusion_matrix", f"""WITH {_GUESS} SELECT y::DOUBLE AS label, sum((z = 0)::INT)::BIGINT AS "0.0", sum((z = 1)::INT)::BIGINT AS "1.0",
sum((z = 2)::INT)::BIGINT AS "2.0" FROM g WHERE task = 'three' GROUP BY y""")
def u4_matrix(spark, sf_dir):
    return U.confusion_matrix(guesses(spark, sf_dir).where("task = 'three'").drop("task"), 3)


def order_results(spark, sf_dir) -> DataFrame:
    """Result rows read off the orders: a model per priority, a scenario per status."""
    o = table(spark, sf_dir, "orders")
    scenario = F.when(F.col("o_orderstatus") == "F", "original_only").when(F.col("o_orderstatus") == "O", "augmented_only").otherwise("combined")
    wide = o.groupBy(F.col("o_orderpriority").alias("model"), scenario.alias("scenario")).agg(
        F.avg((F.col("o_totalprice") > 100000).cast("double")).alias("accuracy"),
        F.avg((F.col("o_totalprice") > 150000).cast("double")).alias("f1_weighted"))
    return wide.unpivot(["model", "scenario"], ["accuracy", "f1_weighted"], "field", "value")


_RES = """w AS (SELECT o_orderpriority AS model, CASE o_orderstatus WHEN 'F' THEN 'o' WHEN 'O' THEN 'a' ELSE 'c' END AS sc,
 avg((o_totalprice > 100000)::INT) AS acc, avg((o_totalprice > 150000)::INT) AS f1 FROM orders GROUP BY ALL),
m AS (SELECT model, max(acc) FILTER (sc = 'o') AS oa, max(acc) FILTER (sc = 'a') AS aa, max(acc) FILTER (sc = 'c') AS ca,
 max(f1) FILTER (sc = 'o') AS o1, max(f1) FILTER (sc = 'c') AS c1 FROM w GROUP BY model),
t AS (SELECT avg(ca - oa) AS ia, avg(c1 - o1) AS i1, avg(ca) AS acc FROM m)"""


def utility_sql() -> str:
    """Facts of ``order_results``, per model and overall."""
    scenario = "CASE sc WHEN 'o' THEN 'original_only' WHEN 'a' THEN 'augmented_only' ELSE 'combined' END"
    per = " UNION ALL ".join(f"SELECT 'utility' AS dimension, {scenario} AS metric, model AS feature, '{field}' AS field, {S.num(c)} AS value, NULL::VARCHAR AS label FROM w"
                             for field, c in (("accuracy", "acc"), ("f1_weighted", "f1")))
    total = S.facts("utility", "utility", "x", [
        ("average_improvement_accuracy", "ia", 6), ("average_improvement_f1", "i1", 6),
        ("overall_utility_score", "0.6::DOUBLE * least(1, greatest(0, (ia + 0.1) / 0.2)) + 0.4::DOUBLE * acc", 6), ("best_accuracy", "ca", 6), ("best_f1", "c1", 6),
        ("verdict", S.grade("ia", [("Excellent utility", ">", 0.05), ("Good utility", ">", 0.02), ("Neutral utility", ">", -0.02)], "Poor utility"), "word"),
        ("best_model", "model", "word")])
    return f"WITH {_RES}, b AS (SELECT model, ca, c1 FROM m ORDER BY ca DESC, model DESC LIMIT 1), x AS (SELECT * FROM t, b) {per} UNION ALL {total}"


@register("u6_improvement", f"""WITH {_RES} SELECT model, {S.num('ca - oa')} AS accuracy, {S.num('c1 - o1')} AS f1 FROM m UNION ALL
SELECT 'average', {S.num('ia')}, {S.num('i1')} FROM t""")
def u6(spark, sf_dir):
    m = U.model_table(order_results(spark, sf_dir))
    per = m.select("model", tidy(F.col("improvement_accuracy")).alias("accuracy"), tidy(F.col("improvement_f1")).alias("f1"))
    o = U.overall_row(m)
    return per.unionByName(o.select(F.lit("average").alias("model"), tidy(F.col("average_improvement_accuracy")).alias("accuracy"),
                                    tidy(F.col("average_improvement_f1")).alias("f1")))


@register("u7_model_quality", f"""WITH {_RES} SELECT model, CASE WHEN ca - oa > 0.05 AND aa > 0.6 THEN 'high' WHEN ca - oa > 0.02 OR aa > 0.5
 THEN 'medium' ELSE 'low' END AS quality FROM m""")
def u7(spark, sf_dir):
    return U.model_table(order_results(spark, sf_dir)).select("model", "quality")


@register("u8_overall_score", f"WITH {_RES} SELECT {S.num('0.6 * least(1, greatest(0, (ia + 0.1) / 0.2)) + 0.4 * acc')} AS score FROM t")
def u8(spark, sf_dir):
    return U.overall_row(U.model_table(order_results(spark, sf_dir))).select(tidy(F.col("overall_utility_score")).alias("score"))


@register("u9_verdict", f"""WITH {_RES} SELECT CASE WHEN ia > 0.05 THEN 'Excellent utility' WHEN ia > 0.02 THEN 'Good utility' WHEN ia > -0.02
 THEN 'Neutral utility' ELSE 'Poor utility' END AS verdict FROM t""")
def u9(spark, sf_dir):
    return U.overall_row(U.model_table(order_results(spark, sf_dir))).select("verdict")


@register("u10_best_model", f"""WITH {_RES} SELECT model AS best_model, {S.num('ca')} AS accuracy, {S.num('c1')} AS f1 FROM m
ORDER BY ca DESC, model DESC LIMIT 1""")
def u10(spark, sf_dir):
    o = U.overall_row(U.model_table(order_results(spark, sf_dir)))
    return o.select("best_model", tidy(F.col("best_accuracy")).alias("accuracy"), tidy(F.col("best_f1")).alias("f1"))


@register("u11_dataset_info", f"""WITH {_SPLIT} SELECT (SELECT count(*) FROM d) AS original_samples, (SELECT count(*) FROM d) AS augmented_samples,
(SELECT count(*) FROM te) AS test_samples, 2::INTEGER AS n_features, (SELECT count(DISTINCT label) FROM d) AS n_classes""")
def u11(spark, sf_dir):
    return U.prepare_scenarios(people(spark, sf_dir), copies(spark, sf_dir), "side", "c_custkey").info


_SIDES = "coalesce(nation, avg(nation) OVER ()) AS nation, coalesce(balance, avg(balance) OVER ()) AS balance"


def _train_of(stream: str) -> str:
    return f"{_rank(stream)} < ceil(round(0.7 * count(*) OVER (PARTITION BY label), 6)) AS train"


# three training sets f, and two closed-form models m of each on the held-out originals
_SCENARIOS = f"""WITH {_SPLIT}, pa AS (SELECT id, nation + {S.normal(7, 'copy.n', 'id')} AS nation, balance * 1.05 AS balance, side FROM p),
da AS (SELECT id AS row_id, (dense_rank() OVER (ORDER BY side) - 1)::DOUBLE AS label, {_SIDES} FROM pa),
sa AS (SELECT *, {_train_of('split.a')} FROM da),
mx AS (SELECT 'o' || row_id AS row_id, label, nation, balance FROM tr UNION ALL SELECT 'a' || row_id, label, nation, balance FROM sa),
sc AS (SELECT *, {_train_of('split.c')} FROM mx),
al AS (SELECT 'original_only' AS f, label, nation, balance FROM tr UNION ALL SELECT 'augmented_only', label, nation, balance FROM sa WHERE train
 UNION ALL SELECT 'combined', label, nation, balance FROM sc WHERE train),
mo AS (SELECT f, count(*) AS nf, avg(nation) AS m1, stddev_pop(nation) AS s1, avg(balance) AS m2, stddev_pop(balance) AS s2 FROM al GROUP BY f),
zt AS (SELECT f, label, (nation - m1) / s1 AS x, (balance - m2) / s2 AS y FROM al JOIN mo USING (f)),
ze AS (SELECT f, row_id, label, (nation - m1) / s1 AS x, (balance - m2) / s2 AS y FROM te, mo),
cm AS (SELECT f, label AS k, count(*)::DOUBLE AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS c,
 sum(count(*)) OVER (PARTITION BY f)::DOUBLE AS nt FROM zt GROUP BY f, label),
po AS (SELECT f, sum(n * vx) / (max(nt) - count(*)) AS a, sum(n * vy) / (max(nt) - count(*)) AS b, sum(n * c) / (max(nt) - count(*)) AS c FROM cm GROUP BY f),
s AS (SELECT 'lda' AS m, f, row_id, label, k, ln(n / nt) + ((b * mx - po.c * my) * (x - mx / 2) + (a * my - po.c * mx) * (y - my / 2)) / (a * b - po.c * po.c) AS v
 FROM ze JOIN cm USING (f) JOIN po USING (f) UNION ALL
SELECT 'naive_bayes', f, row_id, label, k, ln(n / nt) - 0.5 * (ln(vx) + (x - mx) * (x - mx) / vx) - 0.5 * (ln(vy) + (y - my) * (y - my) / vy) FROM ze JOIN cm USING (f)),
g AS (SELECT m, f, label AS y, k AS z FROM s QUALIFY row_number() OVER (PARTITION BY m, f, row_id ORDER BY v DESC, k) = 1),
w AS (SELECT m, f, count(*)::DOUBLE AS n, sum((y = z)::INT)::DOUBLE AS hit, sum((y = 1 AND z = 1)::INT)::DOUBLE AS ones, sum((y = 1)::INT)::DOUBLE AS own,
 sum((z = 1)::INT)::DOUBLE AS guessed FROM g GROUP BY m, f),
r AS (SELECT m, f, unnest([{{'k': 'accuracy', 'v': hit / n}}, {{'k': 'precision', 'v': coalesce(ones / nullif(guessed, 0), 0)}}, {{'k': 'recall', 'v': ones / own}},
 {{'k': 'f1_weighted', 'v': 2 * ones / (own + guessed)}}, {{'k': 'n_train_samples', 'v': nf::DOUBLE}}, {{'k': 'n_test_samples', 'v': n}}]) AS e FROM w JOIN mo USING (f)
 UNION ALL SELECT m, f, {{'k': 'confusion_' || y::INT || '_' || z::INT, 'v': count(*)::DOUBLE}} FROM g GROUP BY m, f, y, z)
SELECT m AS model, f AS scenario, e.k AS field, {S.num('e.v')} AS value, NULL::VARCHAR AS label FROM r"""


@register("u3_scenarios", _SCENARIOS)
def u3(spark, sf_dir):
    """Train on original, augmented and both; test on held-out originals. All fields but the seconds, which differ by run."""
    p = U.prepare_scenarios(people(spark, sf_dir), copies(spark, sf_dir), "side", "c_custkey")
    found = U.evaluate(p, [{"type": "lda"}, {"type": "naive_bayes"}]).where("field <> 'training_time_seconds'")
    return found.withColumn("value", tidy(F.col("value")))


_CV = f"""WITH {_P}, fo AS (SELECT *, ({_rank('fold')}) % 5 AS fold FROM d), f AS (SELECT unnest(range(5)) AS f),
tr AS (SELECT f, fo.* FROM fo JOIN f ON fold <> f), te AS (SELECT f, fo.* FROM fo JOIN f ON fold = f),
mo AS (SELECT f, avg(nation) AS m1, stddev_pop(nation) AS s1, avg(balance) AS m2, stddev_pop(balance) AS s2 FROM tr GROUP BY f),
zt AS (SELECT f, label, (nation - m1) / s1 AS x, (balance - m2) / s2 AS y FROM tr JOIN mo USING (f)),
ze AS (SELECT f, row_id, label, (nation - m1) / s1 AS x, (balance - m2) / s2 AS y FROM te JOIN mo USING (f)),
cm AS (SELECT f, label AS k, count(*)::DOUBLE AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS c,
 sum(count(*)) OVER (PARTITION BY f)::DOUBLE AS nt FROM zt GROUP BY f, label),
po AS (SELECT f, sum(n * vx) / (max(nt) - count(*)) AS a, sum(n * vy) / (max(nt) - count(*)) AS b, sum(n * c) / (max(nt) - count(*)) AS c FROM cm GROUP BY f),
s AS (SELECT f, row_id, label, k, ln(n / nt) + ((b * mx - po.c * my) * (x - mx / 2) + (a * my - po.c * mx) * (y - my / 2)) / (a * b - po.c * po.c) AS sc
 FROM ze JOIN cm USING (f) JOIN po USING (f)),
g AS (SELECT f, label AS y, k AS z FROM s QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY sc DESC, k) = 1), k AS (SELECT DISTINCT f, y AS k FROM g),
c AS (SELECT k.f, k, sum((y = k)::INT) AS s, sum((z = k)::INT) AS gs, sum((y = k AND z = k)::INT) AS h FROM k JOIN g USING (f) GROUP BY k.f, k),
m AS (SELECT *, coalesce(h / nullif(gs, 0)::DOUBLE, 0) AS p, coalesce(h / nullif(s, 0)::DOUBLE, 0) AS r, 2 * h / (s + gs)::DOUBLE AS f1 FROM c)
SELECT f::INTEGER AS fold, {S.num('sum(h) / sum(s)')} AS accuracy, {S.num('sum(s * p) / sum(s)')} AS "precision", {S.num('sum(s * r) / sum(s)')} AS recall,
{S.num('sum(s * f1) / sum(s)')} AS f1, sum(s)::BIGINT AS n FROM m GROUP BY f"""


@register("u5_cross_validation", _CV)
def u5_cv(spark, sf_dir):
    cv = U.cross_validate("lda", {}, _prepared(spark, sf_dir), FEATURES, 2, 5)
    return cv.select("fold", *[tidy(F.col(c)).alias(c) for c in ("accuracy", "precision", "recall", "f1")], "n")


@register("a6_utility_models")
def a6_models(spark, sf_dir):
    p = U.prepare_scenarios(people(spark, sf_dir), copies(spark, sf_dir), "side", "c_custkey")
    return U.model_table(U.evaluate(p, [{"type": "ridge_classifier"}, {"type": "qda"}], use_cv=True))


# the label of a held-out row by a closed-form model, from training aggregates
_Z = f"""{_SPLIT}, mo AS (SELECT avg(nation) AS m1, stddev_pop(nation) AS s1, avg(balance) AS m2, stddev_pop(balance) AS s2 FROM tr),
zt AS (SELECT row_id, label, (nation - m1) / s1 AS x, (balance - m2) / s2 AS y FROM tr, mo),
ze AS (SELECT row_id, label, (nation - m1) / s1 AS x, (balance - m2) / s2 AS y FROM te, mo),
cm AS (SELECT label AS k, count(*)::DOUBLE AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS c,
 (SELECT count(*) FROM zt)::DOUBLE AS nt FROM zt GROUP BY label)"""
_BEST = "SELECT row_id, label, k AS prediction FROM s QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY sc DESC, k) = 1"
_POOL = ("po AS (SELECT sum(n * vx) / (max(nt) - count(*)) AS a, sum(n * vy) / (max(nt) - count(*)) AS b, "
         "sum(n * c) / (max(nt) - count(*)) AS c FROM cm)")
_MODEL_SQL = {
    "knn": f"""WITH {_Z}, nb AS (SELECT e.row_id, e.label, t.label AS v, row_number() OVER (PARTITION BY e.row_id ORDER BY
 sqrt((e.x - t.x) * (e.x - t.x) + (e.y - t.y) * (e.y - t.y)), t.row_id) AS r FROM ze e, zt t QUALIFY r <= 5),
s AS (SELECT row_id, label, v AS k, count(*) AS sc FROM nb GROUP BY ALL) {_BEST}""",
    "naive_bayes": f"""WITH {_Z}, s AS (SELECT row_id, label, k, ln(n / nt) - 0.5 * (ln(vx) + (x - mx) * (x - mx) / vx) - 0.5 * (ln(vy) + (y - my) * (y - my) / vy) AS sc
FROM ze, cm) {_BEST}""",
    "lda": f"""WITH {_Z}, {_POOL}, s AS (SELECT row_id, label, k, ln(n / nt) + ((b * mx - po.c * my) * (x - mx / 2) + (a * my - po.c * mx) * (y - my / 2)) / (a * b - po.c * po.c) AS sc
FROM ze, cm, po) {_BEST}""",
    "qda": f"""WITH {_Z}, q AS (SELECT k, n, nt, mx, my, vx * n / (n - 1) AS a, vy * n / (n - 1) AS b, c * n / (n - 1) AS c FROM cm),
s AS (SELECT row_id, label, k, ln(n / nt) - 0.5 * ln(a * b - c * c) - 0.5 * (b * (x - mx) * (x - mx) - 2 * c * (x - mx) * (y - my) + a * (y - my) * (y - my))
 / (a * b - c * c) AS sc FROM ze, q) {_BEST}""",
    "ridge_classifier": f"""WITH {_Z}, l AS (SELECT sum(x * x) - count(*) * avg(x) * avg(x) + 1 AS a, sum(y * y) - count(*) * avg(y) * avg(y) + 1 AS b,
 sum(x * y) - count(*) * avg(x) * avg(y) AS c, avg(x) AS ax, avg(y) AS ay FROM zt),
w AS (SELECT k, 2 * n / nt - 1 AS t, (b * 2 * n * (mx - ax) - l.c * 2 * n * (my - ay)) / (a * b - l.c * l.c) AS wx,
 (a * 2 * n * (my - ay) - l.c * 2 * n * (mx - ax)) / (a * b - l.c * l.c) AS wy, ax, ay FROM cm, l),
s AS (SELECT row_id, label, k, t + wx * (x - ax) + wy * (y - ay) AS sc FROM ze, w) {_BEST}""",
    "dummy": f"""WITH {_Z}, up AS (SELECT k, nt, sum(n) OVER (ORDER BY k) AS u FROM cm)
SELECT row_id, label, min(k) AS prediction FROM ze JOIN up ON {S.uniform(42, 'dummy', 'row_id')} * nt < u GROUP BY row_id, label""",
}
_MODELS = [
    ("m1", "logistic_regression"), ("m2", "random_forest"), ("m3", "svm"), ("m4", "knn"), ("m5", "decision_tree"), ("m6", "gradient_boosting"),
    ("m7", "mlp"), ("m8", "linear_svc"), ("m9", "naive_bayes"), ("m10", "ada_boost"), ("m11", "hist_gradient_boosting"),
    ("m12", "ridge_classifier"), ("m13", "sgd_classifier"), ("m14", "lda"), ("m15", "qda"), ("m16", "bagging"), ("m17", "dummy"),
    ("m18", "xgboost"), ("m19", "calibrated_cv"),
]

# Models without a closed form: the split, the labels and that the prediction is a class that beats the largest share.
_CHECKED = f"WITH {_SPLIT} SELECT row_id, label, TRUE AS is_class, TRUE AS beats_majority FROM te"
MARGIN = 0.05


def checked(predicted: DataFrame) -> DataFrame:
    """(row_id, label, is_class, beats_majority): whether a prediction is a class, and whether all of them together are
    right more often, by MARGIN, than always naming the most frequent label."""
    predicted = materialize(predicted)
    right = predicted.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    n, most = predicted.groupBy("label").count().agg(F.sum("count"), F.max("count")).first()
    return predicted.select("row_id", "label", F.coalesce(F.col("prediction").isin(0.0, 1.0), F.lit(False)).alias("is_class"),
                            F.lit(right > most / n + MARGIN).alias("beats_majority"))


for _id, _name in _MODELS:
    def _query(spark, sf_dir, name=_name):
        split = U.stratified_split(_prepared(spark, sf_dir), "split.o")
        found = U.fit_predict(name, {}, split.where("train").drop("train"), split.where("NOT train").drop("train"), FEATURES, 2)
        return found if name in _MODEL_SQL else checked(found)

    register(f"{_id}_{_name}", _MODEL_SQL.get(_name, _CHECKED))(_query)


_FIRST = boosting.Rules(rounds=1)
_EDGES = ", ".join(f"{i}/256.0::DOUBLE" for i in range(1, 256))
# the first round: every row has the gradient p - y and the Hessian p (1 - p) of the class shares
_ROOT = f"""WITH {_Z}, sh AS (SELECT avg(label) AS p FROM zt), long AS (SELECT 0 AS feature, x AS v, label FROM zt UNION ALL SELECT 1, y, label FROM zt),
e AS (SELECT feature, list_distinct(quantile_cont(v, [{_EDGES}])) AS cuts FROM long GROUP BY feature),
c AS (SELECT l.feature, len(list_filter(cuts, lambda c: c < v)) AS bin, p - label AS g, p * (1 - p) AS h FROM long l JOIN e USING (feature), sh),
b AS (SELECT feature, bin, count(*) AS n, sum(g) AS g, sum(h) AS h FROM c GROUP BY ALL),
r AS (SELECT *, sum(n) OVER w AS nl, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(n) OVER f AS nt, sum(g) OVER f AS gt, sum(h) OVER f AS ht FROM b
 WINDOW w AS (PARTITION BY feature ORDER BY bin), f AS (PARTITION BY feature))
SELECT feature::INTEGER AS feature, bin::INTEGER AS bin, n::BIGINT AS n, {S.num('g')} AS gradient, {S.num('h')} AS hessian,
CASE WHEN hl >= 1 AND ht - hl >= 1 THEN {S.num('0.5 * (gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) - gt * gt / (ht + 1))', 5)} END AS gain FROM r"""


@register("m18_first_split_gains", _ROOT)
def m18_gains(spark, sf_dir):
    """Histogram of the first tree's root and what every cut of it would gain."""
    split = U.stratified_split(_prepared(spark, sf_dir), "split.o").where("train")
    scaled = U.standardized(split.drop("train"), [], FEATURES)[0][0]
    found = boosting.root_gains(scaled, tuple(FEATURES), 2, _FIRST)
    return found.select("feature", "bin", "n", tidy(F.col("g")).alias("gradient"), tidy(F.col("h")).alias("hessian"), tidy(F.col("gain"), 5).alias("gain"))
