"""Analysis history and suggestions as append-only Parquet tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ANALYSIS = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("timestamp", T.TimestampType()),
    T.StructField("dataset_name", T.StringType()), T.StructField("original_dataset_rows", T.LongType()),
    T.StructField("augmented_dataset_rows", T.LongType()), T.StructField("fidelity_score", T.DoubleType()),
    T.StructField("diversity_score", T.DoubleType()), T.StructField("privacy_score", T.DoubleType()),
    T.StructField("utility_score", T.DoubleType()), T.StructField("overall_score", T.DoubleType()),
    T.StructField("rating", T.StringType()), T.StructField("metrics_json", T.StringType()),
])
SUGGESTION = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("analysis_id", T.StringType()),
    T.StructField("timestamp", T.TimestampType()), T.StructField("suggestion_type", T.StringType()),
    T.StructField("suggestion_text", T.StringType()), T.StructField("priority", T.StringType()),
])


def _shaped(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows in the table's schema; absent id and time are filled in."""
    filled = rows
    if "id" not in rows.columns:
        filled = filled.withColumn("id", F.expr("uuid()"))
    if "timestamp" not in rows.columns:
        filled = filled.withColumn("timestamp", F.current_timestamp())
    return filled.select(*[
        (F.col(f.name) if f.name in filled.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def _append(rows: DataFrame, schema: T.StructType, path: str) -> None:
    """One folder per month; rows are gathered by month first, and hot months are split."""
    in_utc = F.to_utc_timestamp("timestamp", F.current_timezone())  # months follow each other as timestamps do, wherever they are written
    shaped = _shaped(rows, schema).withColumn("month", F.date_format(in_utc, "yyyy-MM"))
    shaped.hint("rebalance", "month").write.mode("append").partitionBy("month").parquet(path)


def append_analyses(rows: DataFrame, path: str) -> None:
    """Append analysis rows (partitioned by month)."""
    _append(rows, ANALYSIS, path)


def append_suggestions(rows: DataFrame, path: str) -> None:
    _append(rows, SUGGESTION, path)


def read_analyses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(T.StructType([*ANALYSIS.fields, T.StructField("month", T.StringType())])).parquet(path)


def read_suggestions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(T.StructType([*SUGGESTION.fields, T.StructField("month", T.StringType())])).parquet(path)


def recent(rows: DataFrame, limit: int = 10) -> DataFrame:
    """Newest rows first (a top-n per task, then one merge). A table in month folders is read from the newest month back, as
    far as it takes to find ``limit`` rows."""
    return newest_months(rows, limit).orderBy(F.desc("timestamp"), "id").limit(limit)


def newest_months(rows: DataFrame, limit: int) -> DataFrame:
    """Rows of the newest month folders that hold ``limit`` rows together, or all rows; the months come from the file
    listing, and each look goes over twice as many of them as the one before."""
    if "month" not in rows.columns:
        return rows
    months = {m.group(1) for m in (re.search(r"/month=([^/]+)/", f) for f in rows.inputFiles()) if m}
    dated = sorted((m for m in months if re.fullmatch(r"\d{4,}-\d\d", m)), reverse=True)  # rows without a timestamp come last
    found, at, step = 0, 0, 1
    while at < len(dated):
        found += rows.where(F.col("month").isin(dated[at:at + step])).limit(limit - found).count()
        at, step = at + step, 2 * step
        if found >= limit:
            return rows.where(F.col("month").isin(dated[:at]))
    return rows


def by_id(rows: DataFrame, analysis_id) -> DataFrame:
    return rows.where(F.col("id") == F.lit(analysis_id))


def suggestions_for(rows: DataFrame, analysis_id=None, limit: int = 10) -> DataFrame:
    if analysis_id is not None:
        rows = rows.where(F.col("analysis_id") == F.lit(analysis_id))
    return recent(rows, limit)


def with_metrics(rows: DataFrame, schema: str = "map<string,map<string,map<string,string>>>") -> DataFrame:
    """Parse the stored JSON text into a ``metrics`` column."""
    return rows.withColumn("metrics", F.from_json("metrics_json", schema)).drop("metrics_json")


# Markers removed from a suggestion line, in order, in upper and lower case.
MARKERS = ("[PRIORITY:", "[CATEGORY:", "HIGH]", "MEDIUM]", "LOW]", "FIDELITY]", "DIVERSITY]", "PRIVACY]", "UTILITY]")
CATEGORIES = ("FIDELITY", "DIVERSITY", "PRIVACY", "UTILITY")
BLANKS = " \t\n\r\x0b\x0c"
MIN_LENGTH = 10


def parse_suggestions(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line, priority, type, text): one row per suggestion line of every whole text."""
    lines = texts.select(F.col(id_col), F.posexplode(F.split(F.col(text_col), "\n")).alias("line", "raw"))
    blanks = F.lit(BLANKS)
    line = F.btrim(F.col("raw"), blanks)
    up = F.upper("l")
    priority = F.when(F.contains(up, F.lit("[PRIORITY:")), F.when(F.contains(up, F.lit("HIGH")), "high")
                      .when(F.contains(up, F.lit("LOW")), "low").otherwise("medium")).otherwise("medium")
    kind = F.lit("general")
    for c in reversed(CATEGORIES):
        kind = F.when(F.contains(up, F.lit(c)), c.lower()).otherwise(kind)
    kind = F.when(F.contains(up, F.lit("[CATEGORY:")), kind).otherwise("general")
    text = F.col("l")
    for m in MARKERS:
        text = F.replace(F.replace(text, F.lit(m), F.lit("")), F.lit(m.lower()), F.lit(""))
    return (lines.withColumn("l", line).where(F.length("l") >= MIN_LENGTH)
            .select(id_col, "line", priority.alias("priority"), kind.alias("type"), F.btrim(text, blanks).alias("text"))
            .where("text <> ''"))
