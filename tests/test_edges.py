"""Missing and repeated rows, constant and tiny series, ties, gaps, the turn of the year."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tests.conftest import rows_of
from wattline.functions import columns as c
from wattline.operators import (
    anomalies,
    autocorrelation,
    calendar,
    covariate,
    distribution,
    dsm,
    energy,
    peaks,
    profiles,
    quality,
    rolling,
)
from wattline.sources import tables

DIRTY = [
    (None, 1, 5),
    ("a", None, 5),
    ("a", 1, None),
    ("a", 2, float("nan")),
    ("a", 3, -1),
    ("a", 3, 4),
    ("a", 4, 6),
    ("a", 4, 6),
    ("a", 5, 7),
    ("a", 5, 8),
    ("a", 6, 9),
]


@pytest.fixture(scope="module")
def dirty(spark, make):
    rows = make(DIRTY).collect()
    return spark.createDataFrame(
        [(*r, i) for i, r in enumerate(rows)], "meter_id string, ts timestamp_ntz, power_kw double, n int"
    )


def test_invalid_rows(dirty):
    assert sorted(r["n"] for r in quality.detect_invalid(dirty).collect()) == [0, 1, 2, 3, 4]
    assert sorted(r["n"] for r in quality.drop_invalid(dirty).collect()) == [5, 6, 7, 8, 9, 10]
    assert quality.drop_invalid(dirty, ["ts"], None).count() == 10


def test_a_bad_first_copy_does_not_hide_a_good_one(dirty):
    assert sorted(r["n"] for r in quality.clean(dirty, ["n"]).collect()) == [5, 6, 8, 10]


def test_dedup_none_drops_every_copy(dirty):
    kept = quality.dedup(quality.drop_invalid(dirty), ["n"], "none")
    assert kept.columns == dirty.columns
    assert sorted(r["n"] for r in kept.collect()) == [5, 10]


def test_quality_report_counts(dirty):
    row = quality.quality_report(dirty).first().asDict()
    assert row == {
        "rows_in": 11,
        "missing_cells": 4,
        "duplicate_rows": 6,
        "negative_rows": 1,
        "rows_out": 4,
    }
    assert quality.missing_count(dirty).first()["missing_total"] == 4


def test_duplicate_detectors_differ_on_null_keys(make):
    df = make([(None, 1, 1), (None, 1, 2), ("a", 1, 1), ("a", 1, 1)])
    assert quality.duplicate_keys(df).count() == 1
    assert quality.duplicate_rows_join(df).count() == 2
    assert quality.duplicate_rows(df).count() == 4


def test_empty_input(make):
    df = make([("a", 1, 1)]).filter("power_kw > 5")
    assert quality.duplicate_rows(df).count() == 0
    assert anomalies.zscore(df).count() == 0
    assert rolling.rolling_mean(df).count() == 0
    assert tables.calendar_spine(df).count() == 0
    assert quality.quality_report(df).first()["rows_in"] == 0


def test_constant_series(make):
    df = make([("k", h, 10) for h in range(48)])
    assert anomalies.zscore(df, None).filter("z_score IS NOT NULL").count() == 0
    assert anomalies.robust_z(df).count() == 0
    assert {r["acf"] for r in autocorrelation.acf(df, 5).collect()} == {None}
    heated = covariate.harmonic_feature(df)
    assert covariate.corr_lag0(heated).first()["corr"] is None
    assert covariate.best_lag(covariate.lag_correlation(heated)).count() == 0
    bins = {r["bin"]: (r["n"], r["density"]) for r in distribution.histogram(df).collect()}
    assert bins[0] == (48, None) and sum(n for n, _ in bins.values()) == 48


def test_zero_series_divides_by_nothing(make):
    df = make([("k", h, 0) for h in range(48)])
    assert profiles.stability_summary(df).first()["cv"] is None
    assert energy.daily_energy_change(df).filter("change_pct IS NOT NULL").count() == 0
    assert dsm.dsm_summary(dsm.dsm_profiles(df)).filter("saving_pct IS NOT NULL").count() == 0


def test_single_row(make):
    df = make([("k", 5, 3)])
    assert profiles.stability_summary(df).first()["stddev_kw"] is None
    assert rolling.rolling_mean(df, [3]).first()["mean_3"] is None
    assert energy.daily_change_status(df).first()["status"] == "normal"
    assert autocorrelation.acf(df).count() == 0


def test_ties_widen_the_daily_peaks(make):
    df = make([("k", h, v) for h, v in enumerate([9, 9, 9, 8, 7, 1])])
    assert peaks.daily_peaks(df).first()["peak_mean_kw"] == pytest.approx((27 + 8 + 7) / 5)
    assert peaks.daily_troughs(df, 2).first()["trough_mean_kw"] == pytest.approx(4)


def test_daily_extremes_take_the_earliest(make):
    row = peaks.daily_extremes(make([("k", h, v) for h, v in enumerate([5, 1, 9, 1, 9])])).first()
    assert (row["min_hour"], row["max_hour"]) == (1, 2)


def test_rolling_waits_for_full_windows_of_values(make):
    df = make([("k", 0, 1), ("k", 1, None), ("k", 2, 3), ("k", 3, 4), ("k", 4, 8)])
    got = [r["mean_3"] for r in rolling.rolling_mean(df, [3]).orderBy("ts").collect()]
    assert got == [None, None, None, None, 5]


def test_calendar_spine_shows_gaps(make):
    df = make([("a", h, h) for h in range(50) if h % 7] + [("b", 0, 1)])
    spine = tables.calendar_spine(df)
    assert spine.count() == 98 and spine.distinct().count() == 98
    assert spine.join(df, ["meter_id", "ts"], "left_anti").filter("meter_id = 'a'").count() == 7


def test_calendar_spine_over_several_stretches(make):
    df = make([("a", 0, 1), ("b", 5, 1)])
    start = datetime(2026, 1, 1, 0, 30)
    spine = tables.calendar_spine(df, start, start + timedelta(minutes=7 * 2500), timedelta(minutes=7))
    want = {start + timedelta(minutes=7 * n) for n in range(2501)}
    assert {r["ts"] for r in spine.filter("meter_id = 'a'").collect()} == want
    assert spine.count() == 2 * 2501


def test_lag_by_time_differs_from_lag_by_position(make):
    values = [3, 1, 4, 1, 5, 9, 2, 6]
    df = make([("a", h, v) for h, v in enumerate(values) if h != 3])
    x = {h: v - sum(v for h, v in enumerate(values) if h != 3) / 7 for h, v in enumerate(values) if h != 3}
    total = sum(v * v for v in x.values())
    by_time = {r["lag"]: r["acf"] for r in autocorrelation.acf(df, 3, "time").collect()}
    for k in (1, 2, 3):
        assert by_time[k] == pytest.approx(sum(x[h] * x[h - k] for h in x if h - k in x) / total)
    line = list(x.values())
    by_row = {r["lag"]: r["acf"] for r in autocorrelation.acf(df, 3).collect()}
    assert by_row[2] == pytest.approx(sum(a * b for a, b in zip(line[2:], line)) / total)


def test_iso_weeks_over_the_turn_of_the_year(make):
    df = make([("a", 24 * d, 1) for d in range(-10, 10)])
    weeks = [r[1:4] for r in profiles.weekly_energy(df).orderBy("iso_year", "iso_week").collect()]
    assert [w[:2] for w in weeks] == [(2025, 52), (2026, 1), (2026, 2)]
    change = energy.weekly_energy_change(df).orderBy("iso_year", "iso_week").collect()
    assert change[1]["previous_kwh"] == weeks[0][2]


def test_no_weekend_is_similar(make):
    df = make([("a", 96 + 24 * d, 1) for d in range(5)])  # 5 to 9 January 2026: Monday to Friday
    row = profiles.week_weekend_ratio(df).first()
    assert (row["ratio"], row["status"]) == (None, "similar")


def test_shift_without_off_peak_rows_moves_nothing(make):
    df = make([("a", h, 10) for h in range(6, 24)])
    assert rows_of(dsm.dsm_shift(df).filter("energy_shifted <> energy_kwh")) == []
    with pytest.raises(ValueError):
        dsm.dsm_shift(df, peak=(4, 8), off=(2, 4))


def test_day_type_and_tariff_labels(make):
    df = make([("a", h, 1) for h in range(0, 24)])
    periods = [r["period"] for r in calendar.tariff_period(df).orderBy("ts").collect()]
    assert periods == ["off_peak"] * 6 + ["full"] * 3 + ["critical"] * 3 + ["full"] * 12
    first = calendar.add_calendar(df).orderBy("ts").first()  # a Thursday
    assert (first["weekday"], first["day_type"], first["iso_week"], first["is_weekend"]) == (3, "weekday", 1, False)


def test_rolling_week_block(spark):
    days = [("2026-01-01",), ("2026-01-07",), ("2026-01-08",), ("2025-12-31",)]
    df = spark.createDataFrame(days, "d string").select(F.to_date("d").alias("d"))
    got = [r["b"] for r in df.select(c.rolling_week_block("d", "2026-01-01").alias("b")).collect()]
    assert got == [date(2026, 1, 1), date(2026, 1, 1), date(2026, 1, 8), date(2025, 12, 25)]


def test_parsing(spark):
    df = spark.createDataFrame([("101,53",), ("7.5",), ("x",), ("nan",), (None,)], "t string")
    assert [r[0] for r in df.select(c.decimal_comma("t")).collect()] == [101.53, 7.5, None, None, None]
    times = spark.createDataFrame([("2026-01-01 05:00:00",), ("nonsense",)], "t string")
    loose = [r[0] for r in times.select(c.timestamp_from_text("t", strict=False)).collect()]
    assert loose == [datetime(2026, 1, 1, 5), None]
    with pytest.raises(PySparkException):
        times.select(c.timestamp_from_text("t")).collect()
    french = spark.createDataFrame([("31/12/2025 23:00",)], "t string")
    assert french.select(c.timestamp_from_text("t", "dd/MM/yyyy HH:mm")).first()[0] == datetime(2025, 12, 31, 23)


def test_results_do_not_depend_on_the_session_time_zone(spark, make):
    df = make([("a", 24 * 87 + h, h) for h in range(48)])  # around a change to summer time
    events = df.withColumnRenamed("power_kw", "value")
    operators = [
        lambda: tables.hourly_readings(events, "meter_id"),
        lambda: calendar.add_calendar(df),
        lambda: profiles.daily_profile(df),
        lambda: tables.calendar_spine(df),
    ]
    plain = [rows_of(run()) for run in operators]
    spark.conf.set("spark.sql.session.timeZone", "Europe/Paris")
    try:
        assert [rows_of(run()) for run in operators] == plain
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_asof_covariate(make, spark):
    df = make([("a", 1, 1), ("a", 5, 2), ("b", 4, 3), ("b", 0, 4)])
    cov = make([("a", 1, 10), ("a", 4, 40), ("b", 3, 30)]).withColumnRenamed("power_kw", "w")
    shared = cov.drop("meter_id")
    got = {(r["meter_id"], r["ts"].hour): r["w"] for r in covariate.attach_covariate(df, shared, asof=True).collect()}
    assert got == {("a", 1): 10, ("a", 5): 40, ("b", 4): 40, ("b", 0): None}
    own = covariate.attach_covariate(df, cov, per_key=True, asof=True).collect()
    assert {(r["meter_id"], r["ts"].hour): r["w"] for r in own} == {
        ("a", 1): 10, ("a", 5): 40, ("b", 4): 30, ("b", 0): None,
    }
    same = covariate.attach_covariate(df, cov, per_key=True).collect()
    assert {(r["meter_id"], r["ts"].hour): r["w"] for r in same}[("a", 1)] == 10
    assert len(same) == 4


def test_several_key_columns(make):
    df = make([("a", h, h) for h in range(30)]).withColumn("site", F.lit("s"))
    keys = ["site", "meter_id"]
    assert profiles.daily_profile(df, keys).count() == 2
    assert rolling.rolling_cv(df, keys=keys).count() == 30
    assert anomalies.robust_z(df, None, keys=keys).count() == 30
    assert autocorrelation.acf(df, 5, keys=keys).count() == 5


def test_a_change_of_just_the_threshold_is_normal(make):
    """29.48 after 36.85 and 178.44 after 148.70 are 20 percent in decimals, more than that in doubles; so is 3.6 after 3."""
    pairs = [([36.85], [29.48]), ([148.70], [178.44]), ([3.0], [3.6]), ([1.0, 0.1, 0.2], [1.56]), ([3.0], [3.61]), ([0.0], [5.0]), ([1e30], [1.3e30])]
    rows = [(str(k), hour + 24 * day, x) for k, pair in enumerate(pairs) for day, values in enumerate(pair) for hour, x in enumerate(values)]
    found = {r["meter_id"]: r["status"] for r in energy.daily_change_status(make(rows)).filter("date = '2026-01-02'").collect()}
    assert found == {"0": "normal", "1": "normal", "2": "normal", "3": "normal", "4": "anomaly", "5": "normal", "6": "anomaly"}
    odd = energy.daily_change_status(make(rows), 100 / 3).filter("date = '2026-01-02'")
    assert {r["status"] for r in odd.collect()} == {"normal"}
