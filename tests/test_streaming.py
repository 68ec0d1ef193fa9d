"""A stream over several files ends with the rows of the batch operators."""

import math
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.conftest import golden_rows, rows_of
from wattline.operators import anomalies
from wattline.schema import READINGS
from wattline.streaming import monitor, ring


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("stream") / "in")
    rows = sorted(golden_rows(), key=lambda r: r[1])[: 2 * 240]
    for part in range(4):  # in time order, one file after the other
        spark.createDataFrame(rows[part * 120 : part * 120 + 120], READINGS).coalesce(1).write.mode("append").parquet(folder)
    return folder


def drain(spark, files, tmp_path, build):
    stream = spark.readStream.schema(READINGS).option("maxFilesPerTrigger", 1).parquet(files)
    result = build(stream)
    query = (
        result.writeStream.format("parquet")
        .option("path", str(tmp_path / "rows"))
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(str(tmp_path / "rows"))


def closed(spark, files, column, length):
    rows = spark.read.parquet(files)
    end = rows.agg(F.max("ts")).first()[0] - timedelta(hours=2)
    return rows, F.col(column) + length <= F.lit(str(end)).cast("timestamp_ntz")


def test_hourly(spark, files, tmp_path):
    got = drain(spark, files, tmp_path, monitor.stream_hourly)
    rows, done = closed(spark, files, "ts", timedelta(hours=1))
    assert rows_of(got) == rows_of(rows.filter(done))


def test_rolling_equals_the_batch_windows(spark, files, tmp_path):
    got = drain(spark, files, tmp_path, lambda s: monitor.stream_rolling(s, (3, 6)))
    full = {
        (r["meter_id"], r["window_hours"], r["window_end"]): r["mean_kw"]
        for r in got.filter("n = window_hours").collect()
    }
    assert full
    by_hand = {}
    series = {}
    for r in spark.read.parquet(files).orderBy("ts").collect():
        series.setdefault(r["meter_id"], []).append((r["ts"], r["power_kw"]))
    for meter, line in series.items():
        for w in (3, 6):
            for i in range(w - 1, len(line)):
                mean = sum(v for _, v in line[i - w + 1 : i + 1]) / w
                by_hand[meter, w, line[i][0] + timedelta(hours=1)] = mean
    assert all(by_hand[key] == pytest.approx(mean) for key, mean in full.items())
    assert {(m, w) for m, w, _ in full} == {(m, w) for m in "12" for w in (3, 6)}


def test_dedup(spark, files, tmp_path):
    twice = lambda s: monitor.stream_dedup(s.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2)))).drop("n"))
    assert rows_of(drain(spark, files, tmp_path, twice)) == rows_of(spark.read.parquet(files))


@pytest.mark.parametrize("limit", [10, 0])
def test_zscore_against_a_baseline(spark, files, tmp_path, limit):
    rows = spark.read.parquet(files)
    baseline = anomalies.robust_z(rows, None).groupBy("meter_id").agg(
        F.avg("power_kw").alias("mean"),
        F.stddev_samp("power_kw").alias("stddev"),
        F.max("median").alias("median"),
        F.max("mad").alias("mad"),
    )
    got = drain(spark, files, tmp_path, lambda s: monitor.stream_zscore(s, baseline, 1.2, broadcast_rows=limit))
    want = {(r["meter_id"], r["ts"]) for r in anomalies.zscore(rows, 1.2).collect()}
    want |= {(r["meter_id"], r["ts"]) for r in anomalies.robust_z(rows, 1.2).collect()}
    assert {(r["meter_id"], r["ts"]) for r in got.collect()} == want and want


def test_overload_sessions(spark, files, tmp_path):
    limits = spark.createDataFrame([("1", 349.0), ("2", 1000.0)], "meter_id string, contract_kw double")
    got = drain(spark, files, tmp_path, lambda s: monitor.stream_overload_sessions(s, limits, "90 minutes"))
    sessions = {(r["session_start"].day, r["readings"]) for r in got.collect()}
    # from 9 to 17 h on weekdays of the first ten days (1 January 2026 is a Thursday)
    assert sessions <= {(d, 9) for d in (1, 2, 5, 6, 7, 8, 9)}
    assert {(d, 9) for d in (1, 2, 5, 6, 7, 8)} <= sessions


@pytest.fixture(scope="module")
def holes(spark, tmp_path_factory):
    """Readings with NaN, NULL values and a NULL key, in two files."""
    folder = str(tmp_path_factory.mktemp("holes") / "in")
    start = datetime(2026, 1, 1)
    rows = []
    for h in range(60):
        rows.append(("a", start + timedelta(hours=h), float("nan") if h % 7 == 3 else None if h % 11 == 5 else 10.0 + h % 4))
        rows.append((None, start + timedelta(hours=h, minutes=30), 50.0 if h == 20 else 1.0 + h % 2))
        rows.append((None, start + timedelta(hours=h, minutes=40), 2.0))
    for part in (rows[:90], rows[90:]):
        spark.createDataFrame(part, READINGS).coalesce(1).write.mode("append").parquet(folder)
    return folder


def plain_rolling(rows, windows, last):
    """Lines of every hour up to `last`, from the readings themselves."""
    out = {}
    for key in {r[0] for r in rows}:
        own = [(r[1], None if r[2] is None or math.isnan(r[2]) else r[2]) for r in rows if r[0] == key]
        end = min(t for t, _ in own).replace(minute=0) + timedelta(hours=1)
        while end <= last:
            for w in windows:
                inside = [v for t, v in own if end - timedelta(hours=w) <= t < end]
                known = [v for v in inside if v is not None]
                if inside:
                    mean = statistics.fmean(known) if known else None
                    spread = statistics.stdev(known) if len(known) > 1 else None
                    out[key, w, end] = (len(known), mean, spread)
            end += timedelta(hours=1)
    return out


def test_rolling_with_holes(spark, holes, tmp_path):
    got = drain(spark, holes, tmp_path, lambda s: monitor.stream_rolling(s, (2, 5, 12)))
    rows = [tuple(r) for r in spark.read.schema(READINGS).parquet(holes).collect()]
    last = max(r[1] for r in rows) - timedelta(hours=2)
    want = plain_rolling(rows, (2, 5, 12), last)
    found = {(r["meter_id"], r["window_hours"], r["window_end"]): r for r in got.collect()}
    assert found.keys() == want.keys() and len(found) == got.count()
    for key, (n, mean, spread) in want.items():
        r = found[key]
        assert r["n"] == n and r["mean_kw"] == (mean if mean is None else pytest.approx(mean))
        assert r["stddev_kw"] == (spread if spread is None else pytest.approx(spread, abs=1e-9))
        assert r["cv"] == (None if spread is None or not mean else pytest.approx(spread / mean, abs=1e-9))


def test_merged_moments(spark):
    parts = [[None, None], [1e9, 1e9 + 4], [None], [1e9 + 1.5], [1e9 + 6, None, 1e9 + 6, 1e9]]
    rows = [(k, v) for k, part in enumerate(parts) for v in part]
    each = spark.createDataFrame(rows, "k int, v double").groupBy("k").agg(ring.moments("v").alias("m"))
    total = each.groupBy().agg(F.array_sort(F.collect_list("m")).alias("all"))
    start = F.struct(F.lit(0).cast("bigint").alias("rows"), F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))
    got = total.select(F.aggregate("all", start, ring.merged).alias("m")).first()["m"]
    flat = [v for part in parts for v in part if v is not None]
    assert (got["rows"], got["n"]) == (10, 6) and got["mean"] == pytest.approx(statistics.fmean(flat), rel=1e-15)
    assert got["squares"] / 5 == pytest.approx(statistics.variance(flat), rel=1e-7)  # numbers of 1e9 have seven places


@pytest.mark.parametrize("limit", [10, 0])
def test_zscore_with_holes(spark, holes, tmp_path, limit):
    table = spark.createDataFrame([("a", 11.0, 1.0, 11.0, 1.0), (None, 1.7, 0.5, 2.0, 0.5)], "meter_id string, mean double, stddev double, median double, mad double")
    got = drain(spark, holes, tmp_path, lambda s: monitor.stream_zscore(s, table, 5, broadcast_rows=limit)).collect()
    assert [(r["meter_id"], r["power_kw"]) for r in got] == [(None, 50.0)]  # no NaN is far from anything


def test_sessions_and_hours_with_holes(spark, holes, tmp_path):
    limits = spark.createDataFrame([("a", 100.0), (None, 40.0)], "meter_id string, contract_kw double")
    got = drain(spark, holes, tmp_path / "s", lambda s: monitor.stream_overload_sessions(s, limits)).collect()
    assert [(r["meter_id"], r["readings"], r["max_kw"]) for r in got] == [(None, 1, 50.0)]
    hourly = drain(spark, holes, tmp_path / "h", monitor.stream_hourly).collect()
    sums = {(r["meter_id"], r["ts"].day * 24 + r["ts"].hour - 24): r["power_kw"] for r in hourly}
    assert sums[None, 20] == 52.0 and sums["a", 3] is None and sums["a", 5] is None and sums["a", 4] == 10.0
