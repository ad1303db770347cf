"""Connected components of an edge table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.session import materialize


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(v, label): the smallest vertex reachable from each vertex of ``edges`` (a, b). Every round is written, so a lost
    executor costs one round; stars and chains of stars take a few rounds, a path of n vertices about log2(n)."""
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).where(F.col("a") != F.col("b")).distinct())
    labels = materialize(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("label")))
    for _ in range(most_rounds):
        near = both.join(labels, both["b"] == labels["v"]).groupBy("a").agg(F.min("label").alias("near"))
        met = labels.join(near, labels["v"] == near["a"], "left").select("v", "label", F.least("label", F.coalesce("near", "label")).alias("new"))
        # the label's own label: labels are vertices, and those with many followers are few rows on the other side
        up = labels.select(F.col("v").alias("w"), F.col("label").alias("up"))
        jumped = materialize(met.join(up, met["new"] == up["w"], "left").select("v", "label", F.least("new", F.coalesce("up", "new")).alias("new")))
        done = jumped.where(F.col("label") != F.col("new")).isEmpty()
        labels = jumped.select("v", F.col("new").alias("label"))
        if done:
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
