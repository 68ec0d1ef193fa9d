"""Files in and out, the hourly grain, and the whole set of reports."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows_of
from wattline.plans import reports
from wattline.sources import tables


def test_csv_with_padded_headers_and_decimal_commas(spark, tmp_path):
    file = tmp_path / "export.csv"
    file.write_text(
        " meter_id;timestamp ; power_kw \n1;2026-01-01 00:00:00;101,53\n1;2026-01-01 01:00:00;n/a\n",
        encoding="utf-8",
    )
    raw = tables.read_readings_csv(spark, str(file))
    assert [kind for _, kind in raw.dtypes] == ["string"] * 3
    df = tables.load_readings_csv(spark, str(file))
    assert df.dtypes == [("meter_id", "string"), ("ts", "timestamp_ntz"), ("power_kw", "double")]
    assert rows_of(df) == [("1", 101.53, datetime(2026, 1, 1)), ("1", None, datetime(2026, 1, 1, 1))]


def test_written_readings_come_back_and_months_are_pruned(spark, golden, tmp_path):
    path = str(tmp_path / "readings")
    tables.write_readings(golden, path)
    back = tables.read_readings_table(spark, path)
    assert rows_of(back.drop("month")) == rows_of(golden)
    plan = back.filter("month = '2025-12'").select("power_kw")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(month" in plan
    assert "ReadSchema: struct<power_kw:double>" in plan


def test_catalog_table(spark, golden):
    golden.createOrReplaceTempView("stored_readings")
    assert tables.read_readings_table(spark, "stored_readings", ["meter_id"]).columns == ["meter_id"]


@pytest.mark.parametrize("agg, want", [("sum", 0.3), ("avg", 0.15), ("min", 0.1), ("max", 0.2)])
def test_hourly_readings(spark, agg, want):
    events = spark.createDataFrame(
        [("a", datetime(2026, 1, 1, 5, 1), 0.1), ("a", datetime(2026, 1, 1, 5, 59), 0.2)],
        "k string, ts timestamp_ntz, value double",
    )
    assert rows_of(tables.hourly_readings(events, "k", agg=agg)) == [("a", want, datetime(2026, 1, 1, 5))]
    two = tables.hourly_readings(events.withColumn("s", F.lit(1)), ["s", "k"], agg=agg)
    assert two.columns == ["s", "k", "ts", "power_kw"]


def test_negative_sums_round_like_positive_ones(spark):
    events = spark.createDataFrame(
        [("a", datetime(2026, 1, 1), -1.27), ("a", datetime(2026, 1, 1), 0.02)],
        "k string, ts timestamp_ntz, value double",
    )
    assert tables.hourly_readings(events, "k").first()["power_kw"] == -1.25


def test_reports(spark, golden, tmp_path):
    raw = golden.withColumn("n", F.lit(0)).unionByName(golden.limit(30).withColumn("n", F.lit(1)))
    frames = reports.run_reports(raw, ["n"], forest_keys=["1"])
    assert frames["readings"].count() == 1440
    assert frames["quality_report"].first()["duplicate_rows"] == 60
    chosen = ("daily_profile", "dsm_summary", "anomaly_counts", "best_lag", "model_comparison")
    tables.write_report({name: frames[name] for name in chosen}, str(tmp_path / "out"))
    sizes = {name: spark.read.parquet(str(tmp_path / "out" / name)).count() for name in chosen}
    assert sizes == {
        "daily_profile": 60,
        "dsm_summary": 8,
        "anomaly_counts": 4,
        "best_lag": 2,
        "model_comparison": 6,
    }
    for frame in frames.values():
        assert frame.columns  # every report is a valid plan
