"""Grouped statistics of the load: by day, hour, week, day type and tariff period.

Each is one partial aggregation and one shuffle of group totals; a key with most of the rows adds map
work only.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.functions.columns import (
    TARIFF_BANDS,
    day_type_label,
    exact_sum,
    iso_weekday,
    iso_year,
    ratio,
    status_label,
    tariff_label,
    week_start,
)
from wattline.plans.attach import attach, attach_table, join_on
from wattline.plans.missing import nan_is_missing, without_nan
from wattline.plans.percentiles import percentile_name, percentiles
from wattline.plans.scale import Scale, measure
from wattline.schema import KEYS, TS, VALUE


def _spread(value: str) -> list[Column]:
    return [
        F.avg(value).alias("mean_kw"),
        F.max(value).alias("max_kw"),
        F.stddev_samp(value).alias("stddev_kw"),
        ratio(F.stddev_samp(value), F.avg(value)).alias("cv"),
    ]


def _stability(value: str) -> list[Column]:
    return [*_spread(value), ratio(F.max(value), F.avg(value)).alias("peak_factor")]


@nan_is_missing
def daily_profile(
    df: DataFrame, keys: Sequence[str] = KEYS, ts: str = TS, value: str = VALUE
) -> DataFrame:
    """Mean, extremes, deviation and coefficient of variation per key and day."""
    return df.groupBy(*keys, F.to_date(ts).alias("date")).agg(*_spread(value), F.min(value).alias("min_kw"))


@nan_is_missing
def hourly_profile(
    df: DataFrame, keys: Sequence[str] = KEYS, ts: str = TS, value: str = VALUE
) -> DataFrame:
    """The same per key and hour of the day."""
    return df.groupBy(*keys, F.hour(ts).alias("hour")).agg(*_spread(value), F.min(value).alias("min_kw"))


def _energy(value: str, dt_hours: float) -> Column:
    return (exact_sum(value) * F.lit(float(dt_hours))).alias("energy_kwh")


@nan_is_missing
def daily_energy(
    df: DataFrame, dt_hours: float = 1.0, keys: Sequence[str] = KEYS, ts: str = TS, value: str = VALUE
) -> DataFrame:
    """Energy per key and day."""
    return df.groupBy(*keys, F.to_date(ts).alias("date")).agg(_energy(value, dt_hours))


@nan_is_missing
def weekly_energy(
    df: DataFrame, dt_hours: float = 1.0, keys: Sequence[str] = KEYS, ts: str = TS, value: str = VALUE
) -> DataFrame:
    """Energy per key and ISO week, with the year the week belongs to."""
    weeks = df.groupBy(*keys, week_start(ts).alias("_monday")).agg(_energy(value, dt_hours))
    return weeks.select(
        *keys,
        iso_year("_monday").alias("iso_year"),
        F.weekofyear("_monday").alias("iso_week"),
        "energy_kwh",
    )


@nan_is_missing
def stability_summary(df: DataFrame, keys: Sequence[str] = KEYS, value: str = VALUE) -> DataFrame:
    """Mean, peak, deviation, coefficient of variation and peak factor per key."""
    return df.groupBy(*keys).agg(*_stability(value))


@nan_is_missing
def percentile_by_key(
    df: DataFrame,
    q: Sequence[float] = (0.5, 0.95, 0.99),
    exact: bool = True,
    keys: Sequence[str] = KEYS,
    value: str = VALUE,
    scale: Scale | None = None,
) -> DataFrame:
    """Percentiles per key as columns p50, p95, ...; interpolated unless `exact` is off."""
    return percentiles(df, value, q, keys, exact=exact, scale=scale)


@nan_is_missing
def contract_exceedance(
    df: DataFrame,
    q: float = 0.99,
    include_zero: bool = False,
    keys: Sequence[str] = KEYS,
    value: str = VALUE,
    scale: Scale | None = None,
) -> DataFrame:
    """The `q` percentile per key and how many readings lie strictly above it."""
    scale = scale or measure(df, keys)
    name = percentile_name(q)
    limits = percentiles(df, value, [q], keys, scale=scale)
    counted = (
        attach(df, limits, keys, scale)
        .groupBy(*keys)
        .agg(F.max(name).alias(name), F.count_if(F.col(value) > F.col(name)).alias("exceedances"))
    )
    return counted if include_zero else counted.filter("exceedances > 0")


@nan_is_missing
def contract_power(
    df: DataFrame,
    q: float = 0.99,
    factor: float = 1.03,
    keys: Sequence[str] = KEYS,
    value: str = VALUE,
    scale: Scale | None = None,
) -> DataFrame:
    """Recommended subscription: `factor` times the `q` percentile."""
    name = percentile_name(q)
    limits = percentiles(df, value, [q], keys, scale=scale)
    return limits.select(*keys, name, (F.lit(factor) * F.col(name)).alias("contract_kw"))


def _weekday(ts: str) -> Column:
    return iso_weekday(ts) <= 5


@nan_is_missing
def week_weekend_mean(
    df: DataFrame, keys: Sequence[str] = KEYS, ts: str = TS, value: str = VALUE
) -> DataFrame:
    """Mean power on weekdays and at weekends, side by side."""
    return df.groupBy(*keys).agg(
        F.avg(F.when(_weekday(ts), F.col(value))).alias("weekday_mean_kw"),
        F.avg(F.when(~_weekday(ts), F.col(value))).alias("weekend_mean_kw"),
    )


def _by_day_type(
    df: DataFrame, keys: Sequence[str], ts: str, aggregates: Sequence[Column]
) -> DataFrame:
    return df.groupBy(*keys, day_type_label(ts).alias("day_type")).agg(*aggregates)


@nan_is_missing
def week_weekend_mean_rows(
    df: DataFrame, keys: Sequence[str] = KEYS, ts: str = TS, value: str = VALUE
) -> DataFrame:
    """Mean power per key and day type."""
    return _by_day_type(df, keys, ts, [F.avg(value).alias("mean_kw")])


@nan_is_missing
def week_weekend_stability(
    df: DataFrame, keys: Sequence[str] = KEYS, ts: str = TS, value: str = VALUE
) -> DataFrame:
    """Mean, peak, deviation, variation and peak factor per key and day type."""
    return _by_day_type(df, keys, ts, _stability(value))


@nan_is_missing
def week_weekend_energy_rows(
    df: DataFrame, dt_hours: float = 1.0, keys: Sequence[str] = KEYS, ts: str = TS, value: str = VALUE
) -> DataFrame:
    """Energy per key and day type."""
    return _by_day_type(df, keys, ts, [_energy(value, dt_hours)])


@nan_is_missing
def week_weekend_energy(
    df: DataFrame, dt_hours: float = 1.0, keys: Sequence[str] = KEYS, ts: str = TS, value: str = VALUE
) -> DataFrame:
    """Energy on weekdays and at weekends, side by side."""
    energy = F.col(value) * F.lit(float(dt_hours))
    return df.groupBy(*keys).agg(
        F.sum(F.when(_weekday(ts), energy)).alias("weekday_kwh"),
        F.sum(F.when(~_weekday(ts), energy)).alias("weekend_kwh"),
    )


@nan_is_missing
def week_weekend_ratio(
    df: DataFrame,
    threshold: float = 1.1,
    labels: tuple[str, str] = ("weekday dominant", "similar"),
    dt_hours: float = 1.0,
    keys: Sequence[str] = KEYS,
    ts: str = TS,
    value: str = VALUE,
) -> DataFrame:
    """Mean daily energy of weekdays over that of weekend days, with a label."""
    days = daily_energy(df, dt_hours, keys, ts, value)
    return (
        week_weekend_mean(days, keys, "date", "energy_kwh")
        .withColumnsRenamed(
            {"weekday_mean_kw": "weekday_mean_kwh", "weekend_mean_kw": "weekend_mean_kwh"}
        )
        .withColumn("ratio", ratio("weekday_mean_kwh", "weekend_mean_kwh"))
        .withColumn("status", status_label("ratio", threshold, *labels))
    )


@nan_is_missing
def tariff_stability(
    df: DataFrame,
    bands: Sequence[tuple[str, int, int]] = TARIFF_BANDS,
    other: str = "out",
    keys: Sequence[str] = KEYS,
    ts: str = TS,
    value: str = VALUE,
) -> DataFrame:
    """Mean, peak, deviation, variation and peak factor per key and tariff period."""
    period = tariff_label(F.hour(ts), bands, other).alias("period")
    return df.groupBy(*keys, period).agg(*_stability(value))


def join_stats(
    df: DataFrame, stats: DataFrame, keys: Sequence[str] = KEYS, scale: Scale | None = None
) -> DataFrame:
    """Readings with the per-key columns of `stats`, a table of at most one row per key, of any size."""
    return attach_table(df, stats, keys, scale)


def group_transform(
    df: DataFrame,
    aggs: Mapping[str, Column],
    keys: Sequence[str] = KEYS,
    scale: Scale | None = None,
) -> DataFrame:
    """Readings with aggregates of their key as new columns.

    Most aggregates merge, so a key of any length is one partial aggregation.  A median or percentile of a
    column keeps all values of its key, so these take the percentile plan, which cuts long keys; NaN counts
    as missing there, as in all percentiles.
    """
    scale = scale or measure(df, keys)
    quantiles = {name: found for name, column in aggs.items() if (found := _as_quantile(column, df)) is not None}
    others = [column.alias(name) for name, column in aggs.items() if name not in quantiles]
    stats = df.groupBy(*keys).agg(*others) if others else df.select(*keys).distinct()
    for name, (value, q) in quantiles.items():
        found = percentiles(without_nan(df.select(*keys, value), value), value, [q], keys, scale=scale)
        stats = join_on(stats, found.withColumnRenamed(percentile_name(q), name), keys, "left", null_safe=True)
    return attach(df, stats.select(*keys, *aggs), keys, scale)


_QUANTILE = re.compile(r"(?:median\((?P<median>[^(),]+)\)|percentile\((?P<value>[^(),]+), (?P<q>[0-9.]+), 1\))")


def _as_quantile(column: Column, df: DataFrame) -> tuple[str, float] | None:
    """(column, fraction) of a plain median or percentile of a numeric column of `df`."""
    found = _QUANTILE.fullmatch(str(column).removeprefix("Column<'").removesuffix("'>"))
    name = found and (found["median"] or found["value"])
    kinds = {f.name: f.dataType for f in df.schema}
    if not found or not isinstance(kinds.get(name), T.NumericType):
        return None
    return name, 0.5 if found["median"] else float(found["q"])
