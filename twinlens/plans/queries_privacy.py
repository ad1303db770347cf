"""Privacy queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinlens.operators import privacy as M
from twinlens.operators.neighbors import nearest
from twinlens.plans import sqlkit as S
from twinlens.plans.pairs import (
    ACCOUNT_COLS,
    ACCOUNT_SQL,
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
from twinlens.plans.sql_metrics import nearest_sql, privacy_sql

VECTOR_DIMS = 64  # fixed value: length of the given embedding vectors
_LINES = privacy_sql(LINEITEM_SQL, LINEITEM_COLS)
_PARTS = privacy_sql(PART_SQL, PART_COLS)
_ACCOUNTS = privacy_sql(ACCOUNT_SQL, ACCOUNT_COLS)


@register("k5_nearest_two", f"""{nearest_sql(ACCOUNT_SQL, ACCOUNT_COLS)}
SELECT qid, bid, rank::INTEGER AS rank, {S.num('d')} AS dist FROM r""")
def k5(spark, sf_dir):
    """The leaf-partitioned path of the join, whatever the table size."""
    p = account_pair(spark, sf_dir)
    found = nearest(p.a_keyed, p.o_keyed, p.cols, p.scale, 2, broadcast_rows=0, leaf_rows=256)
    return found.select("qid", "bid", F.col("rank").cast("int").alias("rank"), (F.round("dist", 6) + 0.0).alias("dist"))


@register("k5_nearest_three_vectors", f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n AS (SELECT a.vec_id AS qid, b.vec_id AS bid, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id)
SELECT qid, bid, CAST(row_number() OVER (PARTITION BY qid ORDER BY d, bid) AS INTEGER) AS rank, {S.num('d')} AS dist FROM n QUALIFY rank <= 3""")
def k5_vectors(spark, sf_dir):
    """The two passes of the join over leaves, in 64 dimensions, whatever the table size."""
    e = table(spark, sf_dir, "embeddings")
    cols = [f"x{i}" for i in range(VECTOR_DIMS)]
    v = e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(cols)])
    found = nearest(v, v, cols, [1.0] * VECTOR_DIMS, 3, qid="vec_id", bid="vec_id", skip_self=True, broadcast_rows=0, leaf_rows=256)
    return found.select("qid", "bid", F.col("rank").cast("int").alias("rank"), (F.round("dist", 6) + 0.0).alias("dist"))


@register("v1_nearest_neighbor_risk", _PARTS["v1_nearest_neighbor_risk"])
def v1(spark, sf_dir):
    return M.nearest_neighbor_risk(M.pair_neighbors(part_pair(spark, sf_dir)))


@register("v2_membership_inference")
def v2(spark, sf_dir):
    return M.membership_inference(lineitem_pair(spark, sf_dir))


@register("v3_attribute_disclosure", _ACCOUNTS["v3_attribute_disclosure"])
def v3(spark, sf_dir):
    pair = account_pair(spark, sf_dir)
    return M.attribute_disclosure(pair, M.pair_neighbors(pair))


@register("v4_distance_to_closest", _PARTS["v4_distance_to_closest"])
def v4(spark, sf_dir):
    pair = part_pair(spark, sf_dir)
    return M.distance_to_closest(pair, M.pair_neighbors(pair))


@register("v5_uniqueness", _PARTS["v5_uniqueness"])
def v5(spark, sf_dir):
    return M.uniqueness(part_pair(spark, sf_dir))


@register("v6_k_anonymity", _LINES["v6_k_anonymity"])
def v6(spark, sf_dir):
    return M.k_anonymity(lineitem_pair(spark, sf_dir))


@register("v7_l_diversity", _LINES["v7_l_diversity"])
def v7(spark, sf_dir):
    return M.l_diversity(lineitem_pair(spark, sf_dir))


@register("v7_l_diversity_accounts", _ACCOUNTS["v7_l_diversity"])
def v7_accounts(spark, sf_dir):
    return M.l_diversity(account_pair(spark, sf_dir))
