"""Test pairs over the given tables, as DataFrames and as the equal SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlens.pair import Pair


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def lineitem_pair(spark: SparkSession, sf_dir: str) -> Pair:
    """All lines against the same lines with larger quantities and prices."""
    li = table(spark, sf_dir, "lineitem")
    orig = li.select("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    aug = li.select((F.col("l_quantity") * 1.1).alias("l_quantity"),
                    (F.col("l_extendedprice") * 1.05 + 100).alias("l_extendedprice"), "l_discount", "l_tax")
    return Pair(orig, aug)


LINEITEM_SQL = """o AS (SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem),
a AS (SELECT l_quantity * 1.1::DOUBLE AS l_quantity, l_extendedprice * 1.05::DOUBLE + 100 AS l_extendedprice,
      l_discount, l_tax FROM lineitem)"""
LINEITEM_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def part_pair(spark: SparkSession, sf_dir: str) -> Pair:
    """All parts against the same parts with scaled size and price."""
    p = table(spark, sf_dir, "part")
    orig = p.select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    aug = p.select("p_partkey", (F.col("p_size") * 1.1).alias("p_size"),
                   (F.col("p_retailprice") * 1.03 + 5).alias("p_retailprice"))
    return Pair(orig, aug, key="p_partkey")


PART_SQL = """o AS (SELECT p_partkey AS id, p_size::DOUBLE AS p_size, p_retailprice FROM part),
a AS (SELECT p_partkey AS id, p_size * 1.1::DOUBLE AS p_size, p_retailprice * 1.03::DOUBLE + 5 AS p_retailprice FROM part)"""
PART_COLS = ["p_size", "p_retailprice"]


def account_pair(spark: SparkSession, sf_dir: str) -> Pair:
    """Customers against suppliers: two real tables with the same measures."""
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("account"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    s = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("account"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return Pair(c, s, key="account")


ACCOUNT_SQL = """o AS (SELECT c_custkey AS id, c_nationkey::DOUBLE AS nation, c_acctbal AS balance FROM customer),
a AS (SELECT s_suppkey AS id, s_nationkey::DOUBLE AS nation, s_acctbal AS balance FROM supplier)"""
ACCOUNT_COLS = ["nation", "balance"]
