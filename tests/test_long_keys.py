"""The plans for long keys and many keys give the rows of the short plans, and of brute force."""

import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows_of
from wattline.operators import (
    anomalies,
    autocorrelation,
    covariate,
    distribution,
    dsm,
    energy,
    isolation,
    models,
    peaks,
    profiles,
    quality,
    rolling,
)
from wattline.plans.attach import attach, join_on
from wattline.plans.percentiles import percentiles
from wattline.plans.scale import measure, row_bytes
from wattline.plans.series import with_position


def cut(df, keys=("meter_id",)):
    """The measured scale with limits so low that every key is long and every table too big."""
    return replace(
        measure(df, keys), broadcast_rows=0, hot_parts=2, series_rows=50, percentile_rows=1, block_rows=40
    )


@pytest.fixture(scope="module")
def uneven(make):
    """One key with most rows, small ones beside it, uneven steps, ties and a key of one row."""
    rng = random.Random(7)
    rows, at = [], 0
    for _ in range(400):
        at += rng.choice([1, 1, 1, 2, 30])
        rows.append(("big", at, round(rng.gauss(100, 30), 1)))
    for m in "abc":
        rows += [(m, h, rng.choice([10, 20, 30])) for h in range(24 * 3) if rng.random() < 0.8]
    rows += [("flat", h, 5) for h in range(30)] + [("one", 3, 7)]
    return make(rows).cache()


OPERATORS = {
    "percentile_by_key": lambda d, s: profiles.percentile_by_key(d, [0, 0.1, 0.5, 0.77, 0.95, 1], scale=s),
    "contract_exceedance": lambda d, s: profiles.contract_exceedance(d, 0.9, scale=s),
    "zscore": lambda d, s: anomalies.zscore(d, 1, scale=s),
    "robust_z": lambda d, s: anomalies.robust_z(d, None, scale=s),
    "instability": lambda d, s: anomalies.instability_index(d, scale=s),
    "distribution": lambda d, s: distribution.distribution_stats(d, scale=s),
    "histogram": lambda d, s: distribution.histogram(d, scale=s),
    "rolling_mean": lambda d, s: rolling.rolling_mean(d, scale=s),
    "rolling_std": lambda d, s: rolling.rolling_std(d, scale=s),
    "rolling_cv": lambda d, s: rolling.rolling_cv(d, scale=s),
    "shift": lambda d, s: rolling.shift(d, n=13, scale=s),
    "acf": lambda d, s: autocorrelation.acf(d, 60, scale=s),
    "load_ramps": lambda d, s: autocorrelation.load_ramps(d, 2, scale=s),
    "cumulative_energy": lambda d, s: energy.cumulative_energy(d, scale=s),
    "daily_peaks": lambda d, s: peaks.daily_peaks(d, scale=s),
    "daily_troughs": lambda d, s: peaks.daily_troughs(d, scale=s),
    "harmonic": lambda d, s: covariate.harmonic_feature(d, scale=s),
    "lag_correlation": lambda d, s: covariate.lag_correlation(covariate.harmonic_feature(d), scale=s),
    "model_comparison": lambda d, s: models.model_comparison(
        covariate.harmonic_feature(d), coef_scale=None, scale=s
    ),
    "dsm_profiles": lambda d, s: dsm.dsm_profiles(d, scale=s),
    "dsm_clip": lambda d, s: dsm.dsm_clip(d, scale=s),
    "dsm_shift": lambda d, s: dsm.dsm_shift(d, scale=s),
    "join_stats": lambda d, s: profiles.join_stats(d, profiles.stability_summary(d), scale=s),
    "isolation_scores": lambda d, s: isolation.isolation_scores(d, trees=10, sample=32, scale=s),
    "isolation_forest": lambda d, s: isolation.isolation_forest(d, 10, 0.1, 32, scale=s),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_long_plan_equals_short_plan(uneven, name):
    operator = OPERATORS[name]
    assert rows_of(operator(uneven, cut(uneven))) == rows_of(operator(uneven, measure(uneven, ["meter_id"])))


def test_forward_fill_on_long_keys(make):
    rng = random.Random(3)
    rows = [("a", h, None if rng.random() < 0.6 else h) for h in range(300)]
    rows += [("b", h, None if h < 20 or h > 40 else h) for h in range(100)]
    df = make(rows)
    for limit in (None, 1, 4):
        want, last = [], {}
        for m, h, v in rows:
            if v is not None:
                last[m] = (h, float(v))
            near = m in last and (limit is None or h - last[m][0] <= limit)
            want.append((m, last[m][1] if near else None))
        for scale in (None, cut(df)):
            got = quality.forward_fill(df, limit, scale=scale).orderBy("meter_id", "ts").collect()
            assert [(r["meter_id"], r["power_kw"]) for r in got] == want


def test_percentiles_of_long_keys_against_numpy(spark):
    rng = np.random.default_rng(5)
    series = {
        "normal": rng.normal(0, 1, 5000),
        "tied": rng.integers(0, 4, 3000).astype(float),
        "outlier": np.append(rng.random(2000), 1e12),
        "constant": np.full(50, -3.5),
        "pair": np.array([1.0, 2.0]),
    }
    df = spark.createDataFrame([(k, float(v)) for k, vs in series.items() for v in vs], "k string, v double")
    q = [0.0, 0.01, 0.25, 0.5, 0.95, 0.999, 1.0]
    scale = replace(measure(df, ["k"]), percentile_rows=1)
    got = {r["k"]: r[1:] for r in percentiles(df, "v", q, ["k"], scale=scale).collect()}
    for key, values in series.items():
        assert got[key] == pytest.approx(tuple(np.quantile(values, q)), rel=1e-12)


def test_weighted_percentiles_count_every_row(spark):
    df = spark.createDataFrame([("a", 1.0, 5), ("a", 2.0, 90), ("a", 9.0, 5)], "k string, v double, n long")
    expanded = np.repeat([1.0, 2.0, 9.0], [5, 90, 5])
    for limit in (1000, 1):
        scale = replace(measure(df, ["k"]), percentile_rows=limit)
        row = percentiles(df, "v", [0.04, 0.5, 0.95, 0.96], ["k"], weight="n", scale=scale).first()
        assert row[1:] == pytest.approx(tuple(np.quantile(expanded, [0.04, 0.5, 0.95, 0.96])))


def test_a_key_without_values_keeps_its_row(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None)], "k string, v double")
    for limit in (1000, 0):
        scale = replace(measure(df, ["k"]), percentile_rows=limit)
        assert rows_of(percentiles(df, "v", [0.5], ["k"], scale=scale)) == [("a", 1.0), ("b", None)]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_attach_splits_off_hot_keys_without_losing_rows(spark, how):
    df = spark.createDataFrame(
        [("hot", i) for i in range(50)] + [("lone", i) for i in range(40)] + [("x", 1), ("y", 2), (None, 3)],
        "k string, v int",
    )
    table = spark.createDataFrame([("hot", 1), ("x", 2), ("y", 3), (None, 4), ("other", 5)], "k string, t int")
    split = attach(df, table, ["k"], replace(measure(df, ["k"]), broadcast_rows=0, hot_parts=3), how)
    assert rows_of(split) == rows_of(join_on(df, table, ["k"], how, null_safe=True))
    assert split.count() == {"inner": 53, "left": 93}[how]


def test_positions_are_consecutive_on_long_keys(uneven):
    placed = with_position(uneven, ["meter_id"], "ts", scale=cut(uneven))
    checks = placed.groupBy("meter_id").agg(
        F.count("*").alias("n"), F.count_distinct("row_index").alias("d"), F.max("row_index").alias("m")
    )
    assert all(r["n"] == r["d"] == r["m"] + 1 for r in checks.collect())


def test_duplicates_on_many_groups(make):
    rows = [("a", 0, v) for v in range(40)] + [("b", h, 1) for h in range(20)] * 2 + [("c", 1, 1), (None, 2, 3), (None, 2, 4)]
    df = make(rows)
    few = replace(measure(df, ["meter_id", "ts"]), broadcast_rows=0, hot_parts=4)
    for operator in (quality.duplicate_rows, quality.duplicate_rows_join):
        assert rows_of(operator(df, scale=few)) == rows_of(operator(df))
    assert quality.duplicate_rows(df, scale=few).count() == 82
    assert quality.duplicate_rows_join(df, scale=few).count() == 80


def test_shared_covariate_wider_than_a_broadcast(make, spark, monkeypatch):
    from wattline.plans import scale as scales

    df = make([("a", h, 1) for h in range(50)] + [("b", 3, 1)])
    cov = df.filter("meter_id = 'a' AND hour(ts) % 2 = 0").select("ts", F.hour("ts").alias("w"))
    want = rows_of(covariate.attach_covariate(df, cov))
    monkeypatch.setattr(
        covariate, "Scale", lambda *sizes: scales.Scale(*sizes, broadcast_rows=0, hot_parts=60)
    )
    monkeypatch.setattr(
        covariate, "measure", lambda *a: replace(measure(*a), broadcast_rows=0, hot_parts=10)
    )
    assert rows_of(covariate.attach_covariate(df, cov)) == want


def test_group_transform_of_long_keys(uneven):
    """Medians and percentiles of a hot key take the percentile plan; all others stay one aggregation."""
    aggs = {"mid": F.median("power_kw"), "top": F.percentile("power_kw", 0.9), "mean": F.avg("power_kw"), "odd": F.median(F.col("power_kw") * 2)}
    a, b = (rows_of(profiles.group_transform(uneven, aggs, scale=s)) for s in (measure(uneven, ["meter_id"]), cut(uneven)))
    assert a == b and len(a) == uneven.count()
    plain = {k: [r["power_kw"] for r in uneven.filter(F.col("meter_id") == k).collect()] for k in ("big", "a", "one")}
    got = {r["meter_id"]: r for r in profiles.group_transform(uneven, aggs, scale=cut(uneven)).collect()}
    for k, values in plain.items():
        assert got[k]["mid"] == pytest.approx(np.median(values)) and got[k]["top"] == pytest.approx(np.quantile(values, 0.9))
        assert got[k]["odd"] == pytest.approx(2 * np.median(values)) and got[k]["mean"] == pytest.approx(np.mean(values))


def test_one_long_key_leaves_the_short_ones_alone(uneven):
    """Keys below the limit are ranked by the built-in aggregate; only the long one is narrowed down."""
    scale = replace(measure(uneven, ["meter_id"]), percentile_rows=100)
    long = replace(scale, percentile_rows=1)
    q = [0, 0.05, 0.5, 0.95, 1]
    assert rows_of(percentiles(uneven, "power_kw", q, ["meter_id"], scale=scale)) == rows_of(percentiles(uneven, "power_kw", q, ["meter_id"], scale=long))
    gap = uneven.withColumn("power_kw", F.when(F.col("meter_id") != "flat", F.col("power_kw")))
    got = {r["meter_id"]: r["p50"] for r in percentiles(gap, "power_kw", [0.5], ["meter_id"], scale=long).collect()}
    assert got["flat"] is None and got["one"] == 7 and len(got) == 6
    extra = [F.count("*").alias("n"), F.max("power_kw").alias("top")]
    for s in (scale, long):
        out = {r["meter_id"]: (r["n"], r["top"]) for r in percentiles(uneven, "power_kw", [0.5], ["meter_id"], extra=extra, scale=s).collect()}
        assert out["flat"] == (30, 5.0) and out["big"][0] == 400


def test_lag_correlation_without_a_row_per_lag(make, uneven):
    """Moments per key and lag, against numpy with missing numbers; no Generate over the readings of short keys."""
    rows = [("a", h, None if h % 13 == 4 else (h * 7) % 19) for h in range(300)] + [("flat", h, 3) for h in range(20)] + [("one", 0, 1)]
    df = make(rows).withColumn("outdoor_temp", F.when(F.hour("ts") != 7, (F.hour("ts") * F.hour("ts") % 17 + F.day("ts")).cast("double")))
    scale = measure(df, ["meter_id"])
    plain = covariate.lag_correlation(df, max_lag=9, scale=scale)
    assert "Generate" not in plain._jdf.queryExecution().toString()
    assert rows_of(plain, digits=9) == rows_of(covariate.lag_correlation(df, max_lag=9, scale=cut(df)), digits=9)
    got = {(r["meter_id"], r["lag"]): r["corr"] for r in plain.collect()}
    assert len(got) == 9 + 9 + 1 and got["one", 0] is None and got["flat", 3] is None
    line = [(r["power_kw"], r["outdoor_temp"]) for r in df.filter("meter_id = 'a'").orderBy("ts").collect()]
    for lag in range(9):
        pairs = [(y, line[i - lag][1]) for i, (y, _) in enumerate(line) if i >= lag and y is not None and line[i - lag][1] is not None]
        assert got["a", lag] == pytest.approx(np.corrcoef(*zip(*pairs))[0, 1])


def test_wide_tables_are_not_broadcast(uneven):
    """The limit counts bytes as well as rows; the result is the same."""
    scale = measure(uneven, ["meter_id"])
    facts = uneven.groupBy("meter_id").agg(F.max("power_kw").alias("top"), F.collect_list("power_kw").alias("all"))
    facts = facts.withColumn("all", F.size("all"))
    wide = replace(scale, broadcast_bytes=100)
    assert scale.may_broadcast(facts) and not wide.may_broadcast(facts)
    assert rows_of(attach(uneven, facts, ["meter_id"], scale)) == rows_of(attach(uneven, facts, ["meter_id"], wide))
    unknown = replace(wide, rows=0, largest=0)
    assert rows_of(attach(uneven, facts, ["meter_id"], unknown)) == rows_of(attach(uneven, facts, ["meter_id"], scale))
    assert row_bytes(facts.schema) == 48 and row_bytes(uneven.select(F.array("power_kw")).schema) == 128
