"""Demand-side management what-ifs: clip peaks, shift load to the night, reduce the evening."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.functions.columns import in_hours, ratio
from wattline.operators.calendar import add_energy
from wattline.operators.reshape import strategy_long
from wattline.plans.attach import attach
from wattline.plans.missing import nan_is_missing
from wattline.plans.percentiles import percentile_name, percentiles
from wattline.plans.scale import Scale, measure
from wattline.schema import KEYS, TS, VALUE

# Fixed values in the operators below: the default hours and shares of the three strategies.
STRATEGIES = {
    "original": "energy_kwh",
    "clip": "energy_clipped",
    "shift": "energy_shifted",
    "reduce": "energy_reduced",
}


def _hours(ts: str, span: tuple[int, int]) -> Column:
    return in_hours(F.hour(ts), span)


def _members(span: tuple[int, int]) -> set[int]:
    first, last = span
    return set(range(first, last + 1)) if first <= last else {*range(first, 24), *range(last + 1)}


def _check_windows(peak: tuple[int, int], off: tuple[int, int]) -> None:
    if _members(peak) & _members(off):
        raise ValueError("peak and off-peak hours overlap")


def _moved(ts: str, share: float, peak: tuple[int, int]) -> Column:
    return F.sum(F.when(_hours(ts, peak), F.col("energy_kwh") * F.lit(share)))


def _receivers(ts: str, off: tuple[int, int]) -> Column:
    """Off-peak rows with an energy: only these can take some more."""
    return F.count_if(_hours(ts, off) & F.col("energy_kwh").isNotNull())


def _shifted(ts: str, share: float, peak: tuple[int, int], off: tuple[int, int]) -> Column:
    energy, per_row = F.col("energy_kwh"), F.coalesce("_moved", F.lit(0.0)) / F.col("_off_rows")
    shifted = (
        F.when(_hours(ts, peak), energy * (1 - share))
        .when(_hours(ts, off), energy + per_row)
        .otherwise(energy)
    )
    # without off-peak rows there is nowhere to move the energy to
    return F.when(F.col("_off_rows") > 0, shifted).otherwise(energy)


def _reduced(ts: str, share: float, hours: tuple[int, int]) -> Column:
    energy = F.col("energy_kwh")
    return F.when(_hours(ts, hours), energy * (1 - share)).otherwise(energy)


@nan_is_missing
def dsm_clip(
    df: DataFrame,
    q: float = 0.95,
    dt_hours: float = 1.0,
    keys: Sequence[str] = KEYS,
    value: str = VALUE,
    scale: Scale | None = None,
) -> DataFrame:
    """Energy capped at the key's `q` percentile."""
    scale = scale or measure(df, keys)
    energy = add_energy(df, dt_hours, value)
    name = percentile_name(q)
    caps = percentiles(energy, "energy_kwh", [q], keys, scale=scale)
    capped = F.when(F.col("energy_kwh").isNotNull(), F.least("energy_kwh", name))
    return attach(energy, caps, keys, scale).withColumn("energy_clipped", capped).drop(name)


@nan_is_missing
def dsm_shift(
    df: DataFrame,
    share: float = 0.2,
    peak: tuple[int, int] = (18, 20),
    off: tuple[int, int] = (2, 4),
    dt_hours: float = 1.0,
    keys: Sequence[str] = KEYS,
    ts: str = TS,
    value: str = VALUE,
    scale: Scale | None = None,
) -> DataFrame:
    """A share of the peak-hour energy spread evenly over the key's off-peak rows; the sum is kept."""
    _check_windows(peak, off)
    energy = add_energy(df, dt_hours, value)
    moved = energy.groupBy(*keys).agg(
        _moved(ts, share, peak).alias("_moved"), _receivers(ts, off).alias("_off_rows")
    )
    return (
        attach(energy, moved, keys, scale)
        .withColumn("energy_shifted", _shifted(ts, share, peak, off))
        .drop("_moved", "_off_rows")
    )


@nan_is_missing
def dsm_reduce(
    df: DataFrame,
    share: float = 0.1,
    hours: tuple[int, int] = (17, 20),
    dt_hours: float = 1.0,
    ts: str = TS,
    value: str = VALUE,
) -> DataFrame:
    """Energy cut by a share during the given hours."""
    return add_energy(df, dt_hours, value).withColumn("energy_reduced", _reduced(ts, share, hours))


@nan_is_missing
def dsm_profiles(
    df: DataFrame,
    q: float = 0.95,
    shift_share: float = 0.2,
    peak: tuple[int, int] = (18, 20),
    off: tuple[int, int] = (2, 4),
    reduce_share: float = 0.1,
    reduce_hours: tuple[int, int] = (17, 20),
    dt_hours: float = 1.0,
    keys: Sequence[str] = KEYS,
    ts: str = TS,
    value: str = VALUE,
    scale: Scale | None = None,
) -> DataFrame:
    """Readings with the energy under all three strategies, from one table of per-key facts."""
    _check_windows(peak, off)
    scale = scale or measure(df, keys)
    energy = add_energy(df, dt_hours, value)
    name = percentile_name(q)
    facts = percentiles(
        energy,
        "energy_kwh",
        [q],
        keys,
        extra=[
            _moved(ts, shift_share, peak).alias("_moved"),
            _receivers(ts, off).alias("_off_rows"),
        ],
        scale=scale,
    )
    return (
        attach(energy, facts, keys, scale)
        .withColumns(
            {
                "energy_clipped": F.when(F.col("energy_kwh").isNotNull(), F.least("energy_kwh", name)),
                "energy_shifted": _shifted(ts, shift_share, peak, off),
                "energy_reduced": _reduced(ts, reduce_share, reduce_hours),
            }
        )
        .drop(name, "_moved", "_off_rows")
    )


def dsm_summary(profiles: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per key and strategy: total energy, peak factor, and the saving against the original."""
    totals = profiles.groupBy(*keys).agg(
        *[
            F.struct(
                F.sum(column).alias("total_kwh"), ratio(F.max(column), F.avg(column)).alias("peak_factor")
            ).alias(strategy)
            for strategy, column in STRATEGIES.items()
        ],
        F.sum(STRATEGIES["original"]).alias("_before"),
    )
    long = strategy_long(totals, list(STRATEGIES), [*keys, "_before"], value_name="_s")
    saving = F.col("_before") - F.col("_s.total_kwh")
    return long.select(
        *keys,
        "strategy",
        "_s.total_kwh",
        "_s.peak_factor",
        saving.alias("saving_kwh"),
        (100.0 * ratio(saving, "_before")).alias("saving_pct"),
    )
