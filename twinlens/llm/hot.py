"""Joins that attach one fact per key to many rows, when a few keys may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE = 1000


def attach(rows: DataFrame, facts: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``facts`` on ``key``, null equal to null; ``facts`` has one row per key and in ``weight`` how
    many rows hold it, of ``total``.

    Keys that hold a thousandth of the rows or more are a thousand at most, so their facts travel to the tasks and no task
    receives all their rows; the others are joined by a shuffle. ``rows`` is read twice.
    """
    facts = facts.withColumnRenamed(key, "_fact_key")
    match = rows[key].eqNullSafe(facts["_fact_key"])
    hot = F.broadcast(facts.where(F.col(weight) * SHARE >= total))  # SHARE rows at most
    cold = rows.join(hot.select("_fact_key"), match, "left_anti").join(facts.where(F.col(weight) * SHARE < total), match)
    return rows.join(hot, match).unionByName(cold).drop("_fact_key", weight)
