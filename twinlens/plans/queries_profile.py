"""Sources, validation and profiling queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.operators import profile as P
from twinlens.operators.summaries import melt
from twinlens.plans.pairs import account_pair, table
from twinlens.plans.registry import register
from twinlens.plans.sqlkit import num

_GAPPY_SQL = """t AS (SELECT c_custkey, c_name, nullif(c_nationkey, 3) AS c_nationkey,
 CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
 nullif(c_mktsegment, 'MACHINERY') AS c_mktsegment FROM customer)"""


def gappy_customers(spark, sf_dir) -> DataFrame:
    """Customers with missing cells: null nation, NaN balance, null segment."""
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", "c_name", F.nullif("c_nationkey", F.lit(3)).alias("c_nationkey"),
                    F.when(F.col("c_acctbal") < 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal")).alias("c_acctbal"),
                    F.nullif("c_mktsegment", F.lit("MACHINERY")).alias("c_mktsegment"))


@register("k3_melt", """SELECT p_partkey, 'p_size' AS feature, p_size::DOUBLE AS value FROM part UNION ALL
SELECT p_partkey, 'p_retailprice', p_retailprice FROM part""")
def k3(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return melt(part, ["p_size", "p_retailprice"], ["p_partkey"])


@register("p1_validate_pair", f"""WITH n AS (SELECT (SELECT count(*) FROM customer) AS o, (SELECT count(*) FROM supplier) AS a),
r AS (SELECT o, a, CASE WHEN o > 0 THEN a / o::DOUBLE ELSE 0 END AS ratio FROM n)
SELECT * FROM (
SELECT 'info' AS kind, 'original_rows' AS item, {num('o')} AS value FROM r UNION ALL
SELECT 'info', 'original_columns', 3.0 FROM r UNION ALL SELECT 'info', 'augmented_rows', {num('a')} FROM r UNION ALL
SELECT 'info', 'augmented_columns', 3.0 FROM r UNION ALL SELECT 'info', 'common_columns', 3.0 FROM r UNION ALL
SELECT 'info', 'common_numeric_columns', 3.0 FROM r UNION ALL SELECT 'info', 'size_ratio', {num('ratio')} FROM r UNION ALL
SELECT 'info', 'valid', 1.0 FROM r UNION ALL
SELECT 'warning', 'original_small', {num('o')} FROM r WHERE o < 10 UNION ALL
SELECT 'warning', 'augmented_small', {num('a')} FROM r WHERE a < 10 UNION ALL
SELECT 'warning', 'augmented_much_smaller', {num('ratio')} FROM r WHERE ratio < 0.5 UNION ALL
SELECT 'warning', 'augmented_much_larger', {num('ratio')} FROM r WHERE ratio > 10)""")
def p1(spark, sf_dir):
    pair = account_pair(spark, sf_dir)
    return P.validate_pair(pair.orig, pair.aug)


@register("p2_table_counts", """SELECT 'orders' AS name, count(*) AS n_rows, 6::INTEGER AS n_columns, 3::INTEGER AS n_numeric,
2::INTEGER AS n_categorical + 0 FROM orders""".replace(" AS n_categorical + 0", """ + 0 AS n_categorical,
'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' AS columns,
'o_orderkey,o_custkey,o_totalprice' AS numeric_columns, 'o_orderstatus,o_orderpriority' AS categorical_columns"""))
def p2(spark, sf_dir):
    return P.table_counts(table(spark, sf_dir, "orders"), "orders")


_MISSING = "\nUNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, count(*) AS n FROM t"
                               for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))


@register("p3_missing_values", f"""WITH {_GAPPY_SQL}, m AS ({_MISSING})
SELECT "column", missing, NULL::DOUBLE AS missing_pct FROM m WHERE FALSE UNION ALL
SELECT "column", missing::BIGINT, {num('100.0 * missing / greatest(n, 1)')} FROM m UNION ALL
SELECT NULL, sum(missing)::BIGINT, NULL FROM m""")
def p3(spark, sf_dir):
    return P.missing_values(gappy_customers(spark, sf_dir))


@register("p5_missing_percentages", f"""WITH {_GAPPY_SQL}, m AS ({_MISSING})
SELECT "column", {num('100.0 * missing / greatest(n, 1)')} AS missing_pct FROM m""")
def p5(spark, sf_dir):
    return P.missing_values(gappy_customers(spark, sf_dir)).where(F.col("column").isNotNull()).select("column", "missing_pct")


def _describe_sql(t: str, cols: list[str], fields: str) -> str:
    one = "\nUNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS \"count\", {num(f'avg({c}::DOUBLE)', 4)} AS mean, "
        f"{num(f'stddev_samp({c}::DOUBLE)', 4)} AS std, {num(f'min({c})', 4)} AS \"min\", "
        f"{num(f'quantile_cont({c}::DOUBLE, 0.25)', 4)} AS q25, {num(f'quantile_cont({c}::DOUBLE, 0.5)', 4)} AS q50, "
        f"{num(f'quantile_cont({c}::DOUBLE, 0.75)', 4)} AS q75, {num(f'max({c})', 4)} AS \"max\" FROM {t}" for c in cols)
    return f"SELECT {fields} FROM ({one})"


_LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_CUST_NUM = ["c_custkey", "c_nationkey", "c_acctbal"]


@register("p4_describe", _describe_sql("lineitem", _LI_NUM, "*"))
def p4(spark, sf_dir):
    return P.describe(table(spark, sf_dir, "lineitem"))


_CELLS = ("SELECT count(l_orderkey) + count(l_partkey) + count(l_suppkey) + count(l_linenumber) + count(l_quantity) + count(l_extendedprice) "
          "+ count(l_discount) + count(l_tax) AS a, count(l_returnflag) + count(l_linestatus) AS b, count(l_shipdate) AS c FROM lineitem")


@register("p6_column_type_shares", f"""WITH n AS ({_CELLS})
SELECT 'numeric' AS kind, 8::BIGINT AS n, {num('800.0/11')} AS pct, a::BIGINT AS cells, {num('100.0 * a / (a + b + c)')} AS cell_pct FROM n UNION ALL
SELECT 'categorical', 2, {num('200.0/11')}, b::BIGINT, {num('100.0 * b / (a + b + c)')} FROM n UNION ALL
SELECT 'other', 1, {num('100.0/11')}, c::BIGINT, {num('100.0 * c / (a + b + c)')} FROM n""")
def p6(spark, sf_dir):
    return P.column_type_shares(table(spark, sf_dir, "lineitem"))


@register("p7_five_numbers", f"WITH {_GAPPY_SQL} " + _describe_sql("t", _CUST_NUM, '"column", "min", q25, q50, q75, "max"'))
def p7(spark, sf_dir):
    return P.five_numbers(gappy_customers(spark, sf_dir))


@register("p8_compare_moments", f"""WITH o AS ({_describe_sql('(SELECT c_custkey AS account, c_nationkey AS nation, c_acctbal AS balance FROM customer)',
 ['account', 'nation', 'balance'], '*')}), a AS ({_describe_sql('(SELECT s_suppkey AS account, s_nationkey AS nation, s_acctbal AS balance FROM supplier)',
 ['account', 'nation', 'balance'], '*')})
SELECT "column", o.mean AS original_mean, o.std AS original_std, a.mean AS augmented_mean, a.std AS augmented_std
FROM o JOIN a USING ("column")""")
def p8(spark, sf_dir):
    pair = account_pair(spark, sf_dir)
    return P.compare_moments(pair.orig, pair.aug)


@register("p9_usable_features", """WITH t AS (SELECT *, 1::INTEGER AS always, o_orderkey AS id FROM orders), n AS (SELECT
count(*) AS n, count(DISTINCT o_orderkey) AS a, count(DISTINCT o_custkey) AS b, count(DISTINCT o_totalprice) AS c FROM t)
SELECT 'o_orderkey' AS "column" FROM n WHERE a > 1 AND a <> n UNION ALL SELECT 'o_custkey' FROM n WHERE b > 1 AND b <> n
UNION ALL SELECT 'o_totalprice' FROM n WHERE c > 1 AND c <> n""")
def p9(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return P.usable_features(o.withColumn("always", F.lit(1)).withColumn("id", F.col("o_orderkey")))
