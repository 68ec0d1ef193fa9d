"""Published-style values on the noise-free month (computed separately with numpy)."""

import pytest
from pyspark.sql import functions as F

from wattline.operators import (
    anomalies,
    autocorrelation,
    covariate,
    distribution,
    dsm,
    energy,
    models,
    peaks,
    profiles,
)


def by_meter(df):
    return {row["meter_id"]: row.asDict() for row in df.collect()}


def test_stability_and_distribution(golden):
    got = by_meter(profiles.stability_summary(golden))
    assert got["1"]["mean_kw"] == pytest.approx(219.777778)
    assert got["1"]["stddev_kw"] == pytest.approx(102.816149)
    assert got["1"]["peak_factor"] == pytest.approx(1.956522, abs=1e-6)
    assert got["2"]["stddev_kw"] == pytest.approx(2.729074, abs=1e-6)
    shape = by_meter(distribution.distribution_stats(golden))
    assert shape["1"]["skewness"] == pytest.approx(0.072696, abs=1e-6)
    assert shape["1"]["kurtosis"] == pytest.approx(-1.388309, abs=1e-6)
    assert shape["2"]["skewness"] == pytest.approx(10.817042, abs=1e-6)
    assert shape["2"]["kurtosis"] == pytest.approx(115.008403, abs=1e-6)
    assert shape["1"]["median_kw"] == 200


def test_percentiles_and_contract(golden):
    got = by_meter(profiles.contract_exceedance(golden))
    assert (got["1"]["p99"], got["1"]["exceedances"]) == (350, 6)
    assert (got["2"]["p99"], got["2"]["exceedances"]) == (300, 6)
    assert by_meter(profiles.contract_power(golden))["1"]["contract_kw"] == pytest.approx(360.5)


def test_zscore_finds_the_planted_spikes(golden):
    found = anomalies.zscore(golden)
    assert found.filter("day(ts) NOT IN (12, 22) OR hour(ts) NOT BETWEEN 9 AND 11").count() == 0
    assert by_meter(found.groupBy("meter_id").agg(F.count("*").alias("n"), F.max("z_score").alias("z"))) == {
        "1": {"meter_id": "1", "n": 6, "z": pytest.approx(2.046063, abs=2e-3)},
        "2": {"meter_id": "2", "n": 6, "z": pytest.approx(10.908712, abs=1e-2)},
    }
    population = anomalies.zscore(golden, ddof=0).groupBy("meter_id").agg(F.max("z_score").alias("z"))
    assert by_meter(population)["1"]["z"] == pytest.approx(2.046063, abs=1e-6)
    assert by_meter(population)["2"]["z"] == pytest.approx(10.908712, abs=1e-6)


def test_robust_z_without_deviation_is_null_unless_floored(golden):
    scored = anomalies.robust_z(golden, threshold=None)
    assert by_meter(scored.groupBy("meter_id").agg(F.count("z_robust").alias("n")))["2"]["n"] == 0
    assert anomalies.robust_z(golden).filter("meter_id = '2'").count() == 0
    assert anomalies.robust_z(golden, mad_floor=1e-6).filter("meter_id = '2'").count() == 6


def test_instability(golden):
    strong = anomalies.instability_points(anomalies.instability_index(golden)).filter("level = 'strong'")
    got = {(r[0], r[1]): r[2] for r in strong.groupBy("meter_id", "window_rows").count().collect()}
    assert got == {("1", 3): 272, ("2", 3): 8, ("2", 6): 16, ("2", 9): 22, ("2", 12): 28}


def test_correlation_and_fit(golden):
    heated = covariate.harmonic_feature(golden)
    assert by_meter(covariate.corr_lag0(heated))["1"]["corr"] == pytest.approx(-0.476014, abs=1e-6)
    best = covariate.best_lag(covariate.lag_correlation(heated))
    got = by_meter(best)
    assert (got["1"]["best_lag"], got["2"]["best_lag"]) == (4, 1)
    assert got["1"]["best_corr"] == pytest.approx(-0.839874, abs=1e-6)
    assert got["2"]["best_corr"] == pytest.approx(-0.126673, abs=1e-6)
    table = {(r["meter_id"], r["lag"]): r for r in models.model_comparison(heated).collect()}
    first, shifted = table["1", 0], table["1", 4]
    assert (first["slope"], first["intercept"]) == (-6.9, 254.4)
    assert (first["mae"], first["rmse"]) == (pytest.approx(76.651815), pytest.approx(90.357764))
    assert (shifted["slope"], shifted["intercept"]) == (-12.2, 280.9)
    assert (shifted["mae"], shifted["rmse"]) == (pytest.approx(44.887909), pytest.approx(55.711105))
    assert table["2", 1]["rmse"] == pytest.approx(2.740453, abs=1e-6)


def test_autocorrelation(golden):
    got = {(r["meter_id"], r["lag"]): r["acf"] for r in autocorrelation.acf(golden).collect()}
    assert len(got) == 192 and all(abs(r) <= 1 for r in got.values())
    for lag, one, two in [
        (1, 0.878325, 0.663854),
        (12, -0.687068, -0.008543),
        (24, 0.849542, -0.008683),
        (96, 0.673341, -0.009524),
    ]:
        assert got["1", lag] == pytest.approx(one, abs=1e-6)
        assert got["2", lag] == pytest.approx(two, abs=1e-6)


def test_weekly_energy(golden):
    weeks = profiles.weekly_energy(golden).orderBy("meter_id", "iso_week").collect()
    assert [round(r["energy_kwh"]) for r in weeks] == [
        *(19140, 36540, 36780, 36780, 29000),
        *(28800, 50400, 50490, 50490, 36000),
    ]


def test_cumulative_energy_ends_at_the_total(golden):
    last = energy.cumulative_energy(golden).groupBy("meter_id").agg(F.max("energy_cum_kwh").alias("total"))
    assert by_meter(last)["1"]["total"] == pytest.approx(158240)
    assert by_meter(last)["2"]["total"] == pytest.approx(216180)


@pytest.mark.parametrize(
    "meter, strategy, total, factor",
    [
        ("1", "original", 158240, 1.956522),
        ("1", "clip", 157760, 1.597363),
        ("1", "shift", 158240, 1.956522),
        ("1", "reduce", 155656, 1.989001),
        ("2", "original", 216180, 1.099084),
        ("2", "clip", 216000, 1.0),
        ("2", "shift", 216180, 1.199001),
        ("2", "reduce", 212580, 1.117697),
    ],
)
def test_dsm_summary(golden, meter, strategy, total, factor):
    row = (
        dsm.dsm_summary(dsm.dsm_profiles(golden))
        .filter((F.col("meter_id") == meter) & (F.col("strategy") == strategy))
        .first()
    )
    assert row["total_kwh"] == pytest.approx(total)
    assert row["peak_factor"] == pytest.approx(factor, abs=1e-6)
    assert row["saving_kwh"] == pytest.approx((158240 if meter == "1" else 216180) - total, abs=1e-6)


def test_peaks_of_the_spike_days_rank_first(golden):
    first = peaks.daily_peaks(golden).filter("day_rank = 1 AND meter_id = '1'").collect()
    assert {r["date"].day for r in first} == {12, 22}
    assert all(r["day_rank"] == 1 for r in first)
