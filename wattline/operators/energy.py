"""Energy over time: running totals and changes from one day or week to the next."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattline.functions.columns import differs_by_percent, ratio
from wattline.operators.profiles import daily_energy, weekly_energy
from wattline.plans.missing import nan_is_missing
from wattline.plans.scale import Scale
from wattline.plans.series import running
from wattline.schema import KEYS, TS, VALUE


def _with_change(energy: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    # one row per key and day or week, so a window per key is short
    window = Window.partitionBy(*keys).orderBy(*order)
    return (
        energy.withColumns(
            {
                "previous_kwh": F.lag("energy_kwh").over(window),
                "cumulative_kwh": F.sum("energy_kwh").over(
                    window.rowsBetween(Window.unboundedPreceding, 0)
                ),
            }
        )
        .withColumn("change_kwh", F.col("energy_kwh") - F.col("previous_kwh"))
        .withColumn("change_pct", 100.0 * ratio("change_kwh", "previous_kwh"))
    )


@nan_is_missing
def daily_energy_change(
    df: DataFrame, dt_hours: float = 1.0, keys: Sequence[str] = KEYS, ts: str = TS, value: str = VALUE
) -> DataFrame:
    """Daily energy with the previous day's, the change in kWh and percent, and the running total."""
    return _with_change(daily_energy(df, dt_hours, keys, ts, value), keys, ["date"])


@nan_is_missing
def weekly_energy_change(
    df: DataFrame, dt_hours: float = 1.0, keys: Sequence[str] = KEYS, ts: str = TS, value: str = VALUE
) -> DataFrame:
    """The same per ISO week, in the order of year and week."""
    return _with_change(weekly_energy(df, dt_hours, keys, ts, value), keys, ["iso_year", "iso_week"])


@nan_is_missing
def daily_change_status(
    df: DataFrame,
    threshold_pct: float = 20,
    labels: tuple[str, str] = ("anomaly", "normal"),
    dt_hours: float = 1.0,
    keys: Sequence[str] = KEYS,
    ts: str = TS,
    value: str = VALUE,
) -> DataFrame:
    """Daily changes labelled by their size; the first day, and a change of just the threshold, count as normal."""
    change = daily_energy_change(df, dt_hours, keys, ts, value)
    large = differs_by_percent("energy_kwh", "previous_kwh", threshold_pct)
    return change.withColumn("status", F.when(large, F.lit(labels[0])).otherwise(F.lit(labels[1])))


@nan_is_missing
def cumulative_energy(
    df: DataFrame,
    dt_hours: float = 1.0,
    keys: Sequence[str] = KEYS,
    ts: str = TS,
    value: str = VALUE,
    scale: Scale | None = None,
) -> DataFrame:
    """Readings with their energy and the energy of the key so far."""
    energy = F.col(value) * F.lit(float(dt_hours))
    return running(
        df.withColumn("energy_kwh", energy),
        {"energy_cum_kwh": ("sum", F.col("energy_kwh"))},
        keys,
        [ts],
        scale=scale,
    )
