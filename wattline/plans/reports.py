"""All reports of one set of readings, from one stored clean table."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import DataFrame

from wattline.operators import (
    anomalies,
    autocorrelation,
    calendar,
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
from wattline.plans.scale import measure
from wattline.schema import KEYS, TS, VALUE
from wattline.session import stage


class Reports(Mapping[str, DataFrame]):
    """Reports by name; each is built on its first use."""

    def __init__(self, makers: Mapping[str, Callable[[], DataFrame]]):
        self._makers, self._made = dict(makers), {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


def _once(make: Callable[[], DataFrame], name: str) -> Callable[[], DataFrame]:
    return functools.cache(lambda: stage(make(), name))


def clean_readings(
    raw: DataFrame,
    order_by: Sequence[str],
    keys: Sequence[str] = KEYS,
    ts: str = TS,
    value: str = VALUE,
) -> DataFrame:
    """Cleaned readings with calendar and energy columns, stored in the shared folder."""
    kept = quality.clean(raw, order_by, keys, ts, value).select(*keys, ts, value)
    return stage(calendar.add_energy(calendar.add_calendar(kept, ts), value=value), "clean")


def run_reports(
    raw: DataFrame,
    order_by: Sequence[str],
    covariates: DataFrame | None = None,
    forest_keys: Sequence[object] | None = None,
    keys: Sequence[str] = KEYS,
    ts: str = TS,
    value: str = VALUE,
) -> Reports:
    """Every report by name, built when it is asked for; write the ones you need with `write_report`.

    The readings are cleaned and stored once and their keys measured once.  `covariates` has one row
    per timestamp and a column `outdoor_temp`; without it the daily wave stands in.
    """
    names = {"keys": keys, "ts": ts, "value": value}
    rows = clean_readings(raw, order_by, keys, ts, value)
    base = rows.select(*keys, ts, value)
    scale = measure(base, keys)
    of_key = {"keys": keys, "value": value, "scale": scale}
    of_series = {**names, "scale": scale}

    def findings() -> DataFrame:
        methods = {
            "zscore": anomalies.zscore(base, **of_key),
            "robust_z": anomalies.robust_z(base, **of_key),
            "isolation_forest": isolation.isolation_forest(base, **of_series),
        }
        return anomalies.anomaly_table(methods, keys, ts, value)

    def heated() -> DataFrame:
        if covariates is None:
            return covariate.harmonic_feature(base, keys=keys, ts=ts, scale=scale)
        return covariate.attach_covariate(base, covariates, ts, keys=keys)

    # read by several reports: computed and stored when the first of them is asked for
    found = _once(findings, "findings")
    index = _once(lambda: anomalies.instability_index(base, **of_series), "instability")
    warm = _once(heated, "heated")
    correlations = _once(lambda: covariate.lag_correlation(warm(), **of_series), "correlations")
    shifted = _once(lambda: dsm.dsm_profiles(base, **of_series), "strategies")
    lags = _once(lambda: autocorrelation.acf(base, **of_series), "acf")
    return Reports({
        "readings": lambda: rows,
        "quality_report": lambda: quality.quality_report(raw, **names),
        "daily_profile": lambda: profiles.daily_profile(base, **names),
        "hourly_profile": lambda: profiles.hourly_profile(base, **names),
        "daily_energy_change": lambda: energy.daily_energy_change(base, **names),
        "weekly_energy_change": lambda: energy.weekly_energy_change(base, **names),
        "daily_change_status": lambda: energy.daily_change_status(base, **names),
        "cumulative_energy": lambda: energy.cumulative_energy(base, **of_series),
        "daily_peaks": lambda: peaks.daily_peaks(base, **of_series),
        "daily_troughs": lambda: peaks.daily_troughs(base, **of_series),
        "daily_extremes": lambda: peaks.daily_extremes(base, **names),
        "day_hour_matrix": lambda: peaks.day_hour_matrix(base, **names),
        "stability_summary": lambda: profiles.stability_summary(base, keys, value),
        "contract_exceedance": lambda: profiles.contract_exceedance(base, **of_key),
        "contract_power": lambda: profiles.contract_power(base, **of_key),
        "week_weekend_mean": lambda: profiles.week_weekend_mean(base, **names),
        "week_weekend_stability": lambda: profiles.week_weekend_stability(base, **names),
        "week_weekend_energy": lambda: profiles.week_weekend_energy(base, **names),
        "week_weekend_ratio": lambda: profiles.week_weekend_ratio(base, **names),
        "tariff_stability": lambda: profiles.tariff_stability(base, **names),
        "distribution_stats": lambda: distribution.distribution_stats(base, **of_key),
        "normality_jb": lambda: distribution.normality_jb(base, keys, value),
        "histogram": lambda: distribution.histogram(base, **of_key),
        "gaussian_fit": lambda: distribution.gaussian_fit(base, keys=keys, value=value),
        "acf": lambda: autocorrelation.acf_confint(lags(), keys=keys),
        "load_ramps": lambda: autocorrelation.load_ramps(base, **of_series),
        "rolling_mean": lambda: rolling.rolling_mean(base, **of_series),
        "rolling_cv": lambda: rolling.rolling_cv(base, **of_series),
        "anomaly_table": found,
        "anomaly_counts": lambda: anomalies.anomaly_counts(found(), keys),
        "anomaly_votes": lambda: anomalies.anomaly_votes(found(), keys=keys, ts=ts, value=value),
        "instability_points": lambda: anomalies.instability_points(index()),
        "lag_correlation": correlations,
        "best_lag": lambda: covariate.best_lag(correlations(), keys=keys),
        "model_comparison": lambda: models.model_comparison(warm(), forest_keys, **of_series),
        "dsm_profiles": shifted,
        "dsm_summary": lambda: dsm.dsm_summary(shifted(), keys),
    })
