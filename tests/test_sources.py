"""Files, database queries, history and suggestion lines."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from twinlens.plans import report
from twinlens.sources import history, tables


def test_readers_go_by_extension(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5, "a")], "x int, y double, z string")
    csv = tables.write_table(df, str(tmp_path / "t.csv"))
    pq = tables.write_table(df, str(tmp_path / "t.pq"), "parquet")
    assert tables.load_table(spark, csv).collect() == df.collect() == tables.load_table(spark, pq).collect()
    assert tables.load_table(spark, csv, "x string, y string, z string").dtypes[0] == ("x", "string")
    with pytest.raises(ValueError):
        tables.load_table(spark, str(tmp_path / "t.xlsx"))


def test_ingest_many_variants(spark, tmp_path):
    o = tables.write_table(spark.range(20).toDF("x"), str(tmp_path / "o.parquet"), "parquet")
    a = tables.write_table(spark.range(5).toDF("x"), str(tmp_path / "a.parquet"), "parquet")
    _, variants, checks, counts = tables.ingest(spark, o, {"a": a, "b": o})
    assert set(variants) == {"a", "b"} and counts.count() == 3
    assert checks.where("variant = 'a' AND item = 'augmented_much_smaller'").count() == 1


def test_database_urls():
    base = {"host": "h", "port": 1, "database": "d"}
    assert tables.jdbc_url({**base, "db_type": "mysql"})[0] == "jdbc:mysql://h:1/d"
    assert tables.jdbc_url({**base, "db_type": "postgresql"})[0] == "jdbc:postgresql://h:1/d"
    with pytest.raises(ValueError):
        tables.jdbc_url({**base, "db_type": "oracle"})


def test_history_round_trip(spark, tmp_path):
    path = str(tmp_path / "h")
    for day in (1, 2, 3):
        rows = spark.createDataFrame(
            [(f"r{day}", dt.datetime(2024, day, 1), f"d{day}", 0.5, json.dumps({"fidelity": {"ks": {"p": "1"}}}))],
            "id string, timestamp timestamp, dataset_name string, overall_score double, metrics_json string")
        history.append_analyses(rows, path)
    got = history.read_analyses(spark, path)
    assert [r.id for r in history.recent(got, 2).collect()] == ["r3", "r2"]
    one = history.with_metrics(history.by_id(got, "r1")).first()
    assert one.metrics["fidelity"]["ks"]["p"] == "1" and one.utility_score is None
    history.append_suggestions(spark.createDataFrame([("r1", "privacy", "more noise")],
                                                     "analysis_id string, suggestion_type string, suggestion_text string"), str(tmp_path / "s"))
    found = history.suggestions_for(history.read_suggestions(spark, str(tmp_path / "s")), "r1").first()
    assert found.id and found.timestamp and found.suggestion_text == "more noise"


def test_suggestion_lines(spark):
    text = ("short\n  [PRIORITY: HIGH] [CATEGORY: Privacy] Add noise\n[priority: low] [category: utility] Train longer\n"
            "A plain line of advice\n[CATEGORY: FIDELITY] [PRIORITY: MEDIUM] Match the means")
    got = history.parse_suggestions(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text").orderBy("line").collect()
    assert [(r.priority, r.type) for r in got] == [("high", "privacy"), ("low", "utility"), ("medium", "general"), ("medium", "fidelity")]
    assert got[2].text == "A plain line of advice" and "Add noise" in got[0].text


def test_workbook_and_json(spark, tmp_path):
    facts = spark.createDataFrame(
        [("v", "fidelity", "mmd_score", None, "mmd_score", 0.25, None), ("v", "fidelity", "kl_divergence", "x", "kl", 0.5, None),
         ("v", "utility", "combined", "lda", "accuracy", 0.75, None)],
        "variant string, dimension string, metric string, feature string, field string, value double, label string")
    out = report.write_workbook(facts, str(tmp_path / "book"))
    assert set(out) == {"Summary", "Models", "Fidelity", "Diversity", "Privacy", "Utility"}
    sheet = spark.read.option("header", True).csv(out["Fidelity"])
    assert sheet.where("caption = 'MMD Score'").first()["value"] == "0.25"
    assert report.model_sheet(facts).first()["value"] == 0.75
    doc = json.loads(report.results_json(facts).first()["json"])
    assert doc["fidelity"]["kl_divergence"] == {"x.kl": "0.5"}
    assert facts.where(F.col("feature").isNull()).count() == 1


def test_recent_rows_read_the_newest_months_only(spark, tmp_path):
    from twinlens.sources import history as H

    path = str(tmp_path / "log")
    rows = spark.range(300).selectExpr("concat('a', id) AS id", "timestamp '2020-01-15 00:00:00' + make_interval(0, id % 30) AS timestamp").withColumn("dataset_name", F.lit("d"))
    rows = rows.unionByName(spark.createDataFrame([("none", None, "d")], "id string, timestamp timestamp, dataset_name string"))
    fields = {f.name: f.dataType for f in H.ANALYSIS.fields}
    whole = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in fields.items()])
    H.append_analyses(whole, path)
    stored = H.read_analyses(spark, path)
    for limit in (4, 10, 25, 299, 400):
        got = [r.id for r in H.recent(stored, limit).collect()]
        want = [r.id for r in stored.drop("month").orderBy(F.desc("timestamp"), "id").limit(limit).collect()]
        assert got == want
    assert {r.month for r in H.newest_months(stored, 10).select("month").distinct().collect()} == {"2022-06"}
    plan = H.recent(stored, 10)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "2022-06" in plan
    assert H.recent(stored.where("id = 'a0'"), 3).count() == 1
