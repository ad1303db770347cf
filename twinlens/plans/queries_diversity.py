"""Diversity queries; cluster measures use the labels given with the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinlens.operators import clusters as C
from twinlens.operators import diversity as M
from twinlens.plans import sqlkit as S
from twinlens.plans.pairs import (
    LINEITEM_COLS,
    LINEITEM_SQL,
    PART_COLS,
    PART_SQL,
    account_pair,
    lineitem_pair,
    part_pair,
    table,
)
from twinlens.plans.registry import register
from twinlens.plans.sql_metrics import DRAWN_SHIFTS, diversity_sql

DIM = "diversity"
DIMS = 64  # fixed value: length of the given embedding vectors


def _f(metric, source, entries, feature="NULL::VARCHAR"):
    return S.facts(DIM, metric, source, entries, feature)


_LINES = diversity_sql(LINEITEM_SQL, LINEITEM_COLS)
_PARTS = diversity_sql(PART_SQL, PART_COLS)

@register("d1_feature_entropy", _LINES["d1_feature_entropy"])
def d1(spark, sf_dir):
    return M.feature_entropy(lineitem_pair(spark, sf_dir))



@register("d2_coverage", _PARTS["d2_coverage"])
def d2(spark, sf_dir):
    return M.coverage(part_pair(spark, sf_dir))



@register("d4_intra_diversity", _PARTS["d4_intra_diversity"])
def d4(spark, sf_dir):
    return M.intra_diversity(part_pair(spark, sf_dir), DRAWN_SHIFTS)



@register("d5_range_coverage", _LINES["d5_range_coverage"])
def d5(spark, sf_dir):
    return M.range_coverage(lineitem_pair(spark, sf_dir))


def labelled_embeddings(spark, sf_dir):
    """Original vectors and the same vectors stretched, both with the given labels."""
    e = table(spark, sf_dir, "embeddings")
    cols = [f"x{i}" for i in range(DIMS)]
    v = [F.col("embedding")[i].cast("double") for i in range(DIMS)]
    o = e.select(F.col("vec_id").alias("row_id"), "label", *[x.alias(c) for x, c in zip(v, cols)])
    a = e.select(F.col("vec_id").alias("row_id"), F.pmod(F.col("label") + F.when(F.col("vec_id") < 50, 1).otherwise(0),
                 F.lit(10)).alias("label"), *[(x * 1.25 + 0.01).alias(c) for x, c in zip(v, cols)])
    return M.Clustered(o, a, cols, 10)


_EMB = """WITH raw AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
o AS (SELECT vec_id, label, i, v FROM raw),
a AS (SELECT vec_id, (label + CASE WHEN vec_id < 50 THEN 1 ELSE 0 END) % 10 AS label, i, v * 1.25::DOUBLE + 0.01::DOUBLE AS v FROM raw)"""


@register("d3_cluster_spread", f"""{_EMB}, p AS (SELECT label, sum(x)::DOUBLE / (SELECT count(*) FROM embeddings) AS p,
 sum(y)::DOUBLE / (SELECT count(*) FROM embeddings) AS q FROM (SELECT DISTINCT vec_id, label, 1 AS x, 0 AS y FROM o UNION ALL
 SELECT DISTINCT vec_id, label, 0, 1 FROM a) GROUP BY label),
t AS (SELECT 1 - sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END
 + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2)) AS s,
 -sum((q + 1e-10) / (1 + 10 * 1e-10) * ln((q + 1e-10) / (1 + 10 * 1e-10))) / ln(10.0) AS u FROM p)
{_f('cluster_spread', 't', [('cluster_distribution_similarity', 's', 6), ('augmented_uniformity', 'u', 6), ('n_clusters', '10', 6)])}""")
def d3(spark, sf_dir):
    return M.cluster_spread(labelled_embeddings(spark, sf_dir))


def _sil(t: str) -> str:
    return f"""{t}d AS (SELECT l.vec_id, l.label AS own, r.vec_id AS rid, r.label AS other, sqrt(sum((l.v - r.v) * (l.v - r.v))) AS d
 FROM {t} l JOIN {t} r ON l.i = r.i GROUP BY ALL),
{t}c AS (SELECT vec_id, own, other, sum(d) AS s, count(*) AS n FROM {t}d GROUP BY ALL),
{t}sil AS (SELECT vec_id, max(CASE WHEN own = other THEN s / nullif(n - 1, 0) END) AS a, min(CASE WHEN own <> other THEN s / n END) AS b FROM {t}c GROUP BY vec_id),
{t}t AS (SELECT avg(coalesce((b - a) / greatest(a, b), 0)) AS s FROM {t}sil)"""


_D6 = f"""{_EMB}, {_sil('o')}, {_sil('a')}, t AS (SELECT ot.s AS o, at_.s AS a FROM ot, at AS at_)
{_f('silhouette_score', 't', [('original_score', 'o', 6), ('augmented_score', 'a', 6), ('similarity', '1 - abs(o - a)', 6),
 ('n_clusters', '10', 6), ('quality', S.grade('a', [('high', '>', 0.5), ('medium', '>', 0.25)], 'low'), 'word')])}"""
_D6 = _D6.replace("at AS (SELECT", "at_x AS (SELECT").replace("FROM ot, at AS at_", "FROM ot, at_x AS at_")


@register("d6_silhouette", _D6)
def d6(spark, sf_dir):
    return M.silhouette_score(labelled_embeddings(spark, sf_dir))


def _db(t: str) -> str:
    return f"""{t}k AS (SELECT label, i, avg(v) AS c FROM {t} GROUP BY label, i),
{t}p AS (SELECT {t}.vec_id, {t}.label, sqrt(sum((v - c) * (v - c))) AS d FROM {t} JOIN {t}k k ON k.label = {t}.label AND k.i = {t}.i GROUP BY ALL),
{t}q AS (SELECT label, avg(d) AS s FROM {t}p GROUP BY label),
{t}m AS (SELECT l.label AS x, r.label AS y, sqrt(sum((l.c - r.c) * (l.c - r.c))) AS m FROM {t}k l JOIN {t}k r ON l.i = r.i AND l.label <> r.label GROUP BY ALL),
{t}v AS (SELECT avg(w) AS v FROM (SELECT x, max((p.s + q.s) / m) AS w FROM {t}m JOIN {t}q p ON p.label = x JOIN {t}q q ON q.label = y GROUP BY x))"""


@register("d7_davies_bouldin", f"""{_EMB}, {_db('o')}, {_db('a')}, t AS (SELECT ov.v AS o, av.v AS a FROM ov, av)
{_f('davies_bouldin_index', 't', [('original_score', 'o', 6), ('augmented_score', 'a', 6), ('similarity', '1 / (1 + abs(o - a))', 6),
 ('difference', 'abs(o - a)', 6), ('n_clusters', '10', 6),
 ('quality', S.grade('a', [('high', '<', 1.0), ('medium', '<', 2.0)], 'low'), 'word')])}""")
def d7(spark, sf_dir):
    return M.davies_bouldin_index(labelled_embeddings(spark, sf_dir))


@register("d8_intra_class_compactness", f"""{_EMB}, t AS (SELECT (SELECT avg(v) FROM (SELECT var_pop(v) AS v FROM o GROUP BY label HAVING count(*) > {DIMS})) AS o,
 (SELECT avg(v) FROM (SELECT var_pop(v) AS v FROM a GROUP BY label HAVING count(*) > {DIMS})) AS a)
{_f('intra_class_compactness', 't', [('original_icc', 'o', 6), ('augmented_icc', 'a', 6), ('similarity', '1 / (1 + abs(o - a))', 6),
 ('difference', 'abs(o - a)', 6), ('n_clusters', '10', 6),
 ('quality', S.grade('a', [('high', '<', 0.5), ('medium', '<', 1.0)], 'low'), 'word')])}""")
def d8(spark, sf_dir):
    return M.intra_class_compactness(labelled_embeddings(spark, sf_dir))


@register("k8_kmeans_cluster_metrics")
def k8(spark, sf_dir):
    """All four cluster measures with labels from one k-means fit."""
    from twinlens.facts import union_all

    c = M.clustered(account_pair(spark, sf_dir))
    return union_all([fn(c) for fn in M.CLUSTER_METRICS.values()])


@register("k5_silhouette_per_row", f"""{_EMB}, {_sil('o')}
SELECT vec_id AS row_id, {S.num('coalesce((b - a) / greatest(a, b), 0)')} AS s FROM osil""")
def k5_silhouette(spark, sf_dir):
    c = labelled_embeddings(spark, sf_dir)
    return C.silhouette(c.orig, c.cols, broadcast_rows=0, block_rows=200).select("row_id", (F.round("s", 6) + 0.0).alias("s"))


