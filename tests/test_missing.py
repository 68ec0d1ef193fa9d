"""No data is lost: small events, missing numbers, outliers in time, shifts in both directions."""

import math
import time
from dataclasses import replace
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows_of
from wattline.functions.columns import in_hours, timestamp_from_text
from wattline.operators import anomalies, autocorrelation, covariate, dsm, isolation, profiles, rolling
from wattline.plans.scale import measure
from wattline.plans.series import range_parts, running
from wattline.sources import tables

T0 = datetime(2026, 1, 1)


def test_small_events_add_up(spark):
    df = spark.range(1000).select(F.lit("a").alias("k"), F.lit(T0).cast("timestamp_ntz").alias("ts"), F.lit(0.004).alias("value"))
    assert tables.hourly_readings(df, "k").first()["power_kw"] == 4.0
    wide = df.withColumn("value", F.when(F.col("id") == 0, 1e25).otherwise(F.lit(float("nan")))) if "id" in df.columns else df
    wide = wide.unionByName(wide.withColumn("value", F.lit(1e25))).unionByName(wide.withColumn("value", F.lit(float("nan"))))
    assert tables.hourly_readings(wide, "k").first()["power_kw"] == pytest.approx(1e28)


def _series(make, n=101):
    return make([("1", h, float(10 + h % 7)) for h in range(n)])


@pytest.mark.parametrize(
    "operator",
    [
        lambda d: anomalies.zscore(d, None).drop("ts"),
        lambda d: anomalies.robust_z(d, None).drop("ts"),
        profiles.stability_summary,
        lambda d: autocorrelation.acf(d, 5),
        lambda d: isolation.isolation_scores(d, trees=10),
    ],
)
def test_nan_is_missing(make, operator):
    clean = _series(make)
    spoiled = clean.unionByName(make([("1", 500 + k, float("nan")) for k in range(3)]))
    without = spoiled.withColumn("power_kw", F.nanvl("power_kw", F.lit(None).cast("double")))
    rows = lambda df: sorted((str(r) for r in operator(df).collect()))
    assert rows(spoiled) == rows(without)
    assert not any("nan" in r.lower() for r in rows(spoiled))


@pytest.mark.parametrize("n", range(-3, 4))
def test_shift_is_the_same_on_both_plans(make, n):
    df = _series(make, 200)
    scale = measure(df, ["meter_id"])
    forced = replace(scale, series_rows=50, block_rows=40)
    rows = lambda s: sorted(tuple(r) for r in rolling.shift(df, n=n, scale=s).fillna(-1.0).collect())
    assert rows(scale) == rows(forced)


def test_one_early_timestamp_does_not_fill_a_slice(make):
    df = make([("1", h, 1.0) for h in range(400)] + [("1", -490_000, 1.0)])
    scale = replace(measure(df, ["meter_id"]), series_rows=50)
    sizes = [r["count"] for r in range_parts(df, ["meter_id"], ["ts"], scale).groupBy("_part").count().collect()]
    assert sum(sizes) == 401 and len(sizes) == 4 and max(sizes) <= 150  # the session has 4 shuffle partitions
    long = running(df, {"n": ("sum", F.lit(1))}, ["meter_id"], ["ts"], scale=scale)
    assert sorted(r["n"] for r in long.collect()) == list(range(1, 402))


def test_keys_without_a_name_stay(make):
    df = _series(make, 15).withColumn("meter_id", F.when(F.hour("ts") < 10, F.col("meter_id")))
    scale = measure(df, ["meter_id"])
    for s in (scale, replace(scale, broadcast_rows=0), replace(scale, broadcast_rows=0, hot_parts=2)):
        assert anomalies.zscore(df, None, scale=s).count() == 15


def test_text_that_is_no_timestamp_raises_without_ansi(spark):
    df = spark.createDataFrame([("abc",), (None,), ("2026-01-01 00:00:00",)], "t string")
    before = spark.conf.get("spark.sql.ansi.enabled")
    try:
        for ansi in ("true", "false"):
            spark.conf.set("spark.sql.ansi.enabled", ansi)
            with pytest.raises(Exception, match="no timestamp"):
                df.select(timestamp_from_text("t")).collect()
            loose = [r[0] for r in df.select(timestamp_from_text("t", strict=False)).collect()]
            assert loose == [None, None, datetime(2026, 1, 1)]
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_hours_over_midnight(spark):
    hours = spark.range(24).filter(in_hours("id", (22, 2)))
    assert sorted(r[0] for r in hours.collect()) == [0, 1, 2, 22, 23]
    with pytest.raises(ValueError):
        dsm._check_windows((22, 2), (1, 4))


def test_shifted_energy_is_kept_with_missing_nights(make):
    rows = [("1", h, None if h in (2, 26) else 100.0) for h in range(48)]
    out = dsm.dsm_shift(make(rows))
    a, b = out.agg(F.sum("energy_kwh"), F.sum("energy_shifted")).first()
    assert math.isclose(a, b)


def test_covariate_rows_without_time_match_nothing(spark, make):
    from wattline.operators.covariate import attach_covariate

    df = make([("1", h, 1.0) for h in range(4)])
    cov = spark.createDataFrame([(None, 99.0), (T0 + timedelta(hours=2), 5.0)], "ts timestamp_ntz, outdoor_temp double")
    for per_key in (False, True):
        feed = cov.withColumn("meter_id", F.lit("1")) if per_key else cov
        got = [r["outdoor_temp"] for r in attach_covariate(df, feed, asof=True, per_key=per_key).orderBy("ts").collect()]
        assert got == [None, None, 5.0, 5.0]


def test_one_huge_value_does_not_widen_a_bracket(spark, monkeypatch):
    from wattline.plans import percentiles as P

    monkeypatch.setattr(P, "ACCURACY", 200)
    df = spark.range(3000).select(F.lit("k").alias("k"), (F.col("id") % 1500).cast("double").alias("v"))
    df = df.unionByName(spark.createDataFrame([("k", 1e12), ("s", 2.0), (None, 4.0)], "k string, v double"))
    scale = replace(measure(df, ["k"]), percentile_rows=10)
    q = [0.0, 0.04, 0.5, 0.95, 0.999, 1.0]
    rows = lambda s: sorted((tuple(r) for r in P.percentiles(df, "v", q, ["k"], scale=s).collect()), key=str)
    assert rows(scale) == rows(measure(df, ["k"]))


def test_acf_by_time_off_the_grid_and_sparse(spark, make):
    a = [("a", h, float((h * 7) % 11)) for h in range(60)]
    late = make(a).withColumn("meter_id", F.lit("b")).withColumn("ts", F.col("ts") + F.expr("INTERVAL 30 MINUTES"))
    df = make(a + [("c", h, float(h % 5)) for h in range(0, 4000, 97)]).unionByName(late)
    scale = measure(df, ["meter_id"])
    by_lag = lambda s: {(r["meter_id"], r["lag"]): (round(r["acf"], 12), r["n"]) for r in autocorrelation.acf(df, 97, by="time", scale=s).collect()}
    got = by_lag(scale)
    assert all(got["b", k] == got["a", k] for k in range(1, 60)) and got["c", 97][1] == 42
    assert by_lag(replace(scale, series_rows=10, block_rows=1)) == got
    many = autocorrelation.acf(df.filter("meter_id <> 'c'"), 70).collect()
    wide = autocorrelation.acf(df.filter("meter_id <> 'c'"), 150).collect()
    assert sorted(map(str, many)) == sorted(map(str, wide))


def test_a_large_table_is_not_broadcast(spark, make):
    df = make([("1", h, 1.0) for h in range(5)])
    stats = spark.range(300_000).select(F.col("id").cast("string").alias("meter_id"), F.lit(1.0).alias("mean"))
    plan = profiles.join_stats(df, stats)._jdf.queryExecution().analyzed().toString()
    assert plan.count("strategy=broadcast") <= 3  # hot keys and their rows of the table, never the table
    assert profiles.join_stats(df, stats).count() == 5


def test_staged_tables_can_be_dropped(spark, monkeypatch):
    from wattline import session

    monkeypatch.setattr(session, "_STAGED", [])
    df = session.stage(spark.range(6).withColumn("k", F.col("id") % 2), "gone", ["k"])
    assert df.count() == 6 and df.columns == ["id", "k"]
    assert session.drop_staged(spark) == 1
    with pytest.raises(Exception, match="exist|FILE_NOT|FileNotFound"):
        df.count()


def test_reports_are_built_when_asked_for():
    from wattline.plans.reports import Reports

    made = []
    reports = Reports({"a": lambda: made.append("a") or 1, "b": lambda: made.append("b") or 2})
    assert list(reports) == ["a", "b"] and not made
    assert reports["b"] == 2 and reports["b"] == 2 and made == ["b"]


@pytest.mark.parametrize("before", [0, 1, 30, 99])
@pytest.mark.parametrize("max_lag", [1, 50, 256, 257, 700])
def test_lagged_sums(before, max_lag):
    x = np.random.default_rng(5).normal(size=100)
    want = [sum(x[i] * x[i - k] for i in range(max(before, k), 100)) for k in range(max_lag + 1)]
    assert autocorrelation.lagged_sums(x, before, max_lag) == pytest.approx(want, abs=1e-10)


def test_acf_of_many_lags_is_the_same_on_both_plans(make):
    df = make([("a", h, (h * 13) % 17 + h % 24) for h in range(500)] + [(None, h, h % 5) for h in range(40)])
    scale = measure(df, ["meter_id"])
    rows = lambda s: rows_of(autocorrelation.acf(df, 300, scale=s), digits=9)
    got = rows(scale)
    assert len(got) == 300 + 39 and rows(replace(scale, series_rows=50, block_rows=40)) == got


def test_acf_by_time_of_a_fine_series(spark):
    """Readings ten seconds apart: the work grows with the lags, not with the readings of an hour."""
    second = F.expr("timestamp_ntz'2026-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 10)")
    df = spark.range(40_000).select(F.lit("m").alias("meter_id"), second.alias("ts"), ((F.col("id") * 7919) % 101).cast("double").alias("power_kw"))
    autocorrelation.acf(df.limit(500), 3, by="time").collect()
    begun = time.time()
    got = {r["lag"]: r["acf"] for r in autocorrelation.acf(df, 24, by="time").collect()}
    assert time.time() - begun < 15  # some 3 s; all readings of the last 24 hours for each took 51 s
    x = np.array([(k * 7919) % 101 for k in range(40_000)], float)
    x -= x.mean()
    assert got == pytest.approx({k: (x[360 * k :] @ x[: len(x) - 360 * k]) / (x @ x) for k in range(1, 25)})


def test_fractions_of_a_second_are_moments(make):
    half = make([("a", h, h) for h in range(5)]).withColumn("ts", F.col("ts") + F.expr("INTERVAL 0.5 SECONDS"))
    df = make([("a", h, -h) for h in range(5)]).unionByName(half)
    got = {r["lag"]: r["acf"] for r in autocorrelation.acf(df, 2, by="time").collect()}
    x = np.arange(5.0)
    assert got == pytest.approx({k: 2 * (x[k:] @ x[: 5 - k]) / (2 * x @ x) for k in (1, 2)})


def test_no_cuts_are_broadcast(make):
    """The carry of a prefix scan has a row per key and partition, and no join is forced to broadcast it."""
    df = make([(f"m{k}", h, 1.0) for k in range(30) for h in range(60)])
    scale = replace(measure(df, ["meter_id"]), series_rows=10)
    parts = range_parts(df, ["meter_id"], ["ts"], scale)
    assert parts.select("meter_id", "_part").distinct().count() <= 30 + 4
    sums = running(df, {"s": ("sum", F.col("power_kw"))}, ["meter_id"], ["ts"], scale=scale)
    assert "ResolvedHint" not in sums._jdf.queryExecution().toString() and "strategy=broadcast" not in sums._jdf.queryExecution().toString()
    assert sums.groupBy("meter_id").agg(F.max("s").alias("s")).filter("s <> 60").count() == 0


def test_asof_feed_of_one_day_is_spread(spark):
    """A day of readings by the second: the scan puts no day into one task."""
    second = F.expr("timestamp_ntz'2026-01-01 00:00:00' + make_dt_interval(0, 0, 0, id)")
    df = spark.range(20_000).select((F.col("id") % 3).cast("string").alias("meter_id"), second.alias("ts"), F.lit(1.0).alias("power_kw"))
    feed = spark.range(200).select(F.expr("timestamp_ntz'2026-01-01' + make_dt_interval(0, 0, 0, id * 97 + 5)").alias("ts"), F.col("id").cast("double").alias("temp"))
    parts = range_parts(df.select("ts").distinct(), [], ["ts"], measure(df, [])).groupBy("_part").count().collect()
    assert len(parts) >= 2 and max(r["count"] for r in parts) < 15_000
    got = covariate.attach_covariate(df, feed, asof=True)
    wrong = F.expr("NOT (temp <=> CASE WHEN s >= 5 THEN least(floor((s - 5) / 97), 199) END)")
    seconds = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    assert got.count() == 20_000 and got.withColumn("s", seconds).filter(wrong).count() == 0
