"""A second series beside the load: alignment, lagged correlation, best lag."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.functions.columns import correlation, nan_to_null
from wattline.plans.attach import attach, attach_table
from wattline.plans.missing import nan_is_missing
from wattline.plans.scale import Scale, measure
from wattline.plans.series import look_back, over_blocks, recent, running, with_position
from wattline.schema import KEYS, TS, VALUE

# Mean, amplitude, period in hours and phase of the daily temperature wave.
WAVE_MEAN = 5.0
WAVE_AMPLITUDE = 10.0
WAVE_PERIOD = 24.0
WAVE_PHASE = -2 * math.pi * 15 / 24

_ENDLESS = 1 << 62


def harmonic_feature(
    df: DataFrame,
    mean: float = WAVE_MEAN,
    amp: float = WAVE_AMPLITUDE,
    period: float = WAVE_PERIOD,
    phase: float = WAVE_PHASE,
    index: str = "row",
    name: str = "outdoor_temp",
    keys: Sequence[str] = KEYS,
    ts: str = TS,
    scale: Scale | None = None,
) -> DataFrame:
    """Sine regressor over the row position in the key (`index='row'`) or over the clock (`'hour'`)."""
    if index == "row":
        timed = with_position(df, keys, ts, "_t", scale)
    elif index == "hour":
        days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date"))
        timed = df.withColumn("_t", days * 24 + F.hour(ts))
    else:
        raise ValueError("index must be 'row' or 'hour'")
    angle = F.lit(2 * math.pi) * F.col("_t") / F.lit(period) + F.lit(phase)
    return timed.withColumn(name, F.lit(mean) + F.lit(amp) * F.sin(angle)).drop("_t")


def attach_covariate(
    df: DataFrame,
    cov: DataFrame,
    on: str = TS,
    per_key: bool = False,
    asof: bool = False,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Readings with the columns of `cov`, which has one row per timestamp (and key, if `per_key`).

    `asof` takes the latest row at or before the reading instead of the row at the same time.
    Readings without a match keep NULL; rows of `cov` without a time match nothing.
    """
    by = [*keys, on] if per_key else [on]
    names = [c for c in cov.columns if c not in by]
    if asof and per_key:
        both = _beside(df, cov, names, on)
        scale = measure(both, keys)
        last = running(both, {"_last": ("last", F.col("_cov"))}, keys, [on, "_side"], scale=scale)
        return last.filter("_side = 1").select(*df.columns, "_last.*")
    if asof:
        moments = df.select(on).distinct()
        # one shared series: a scan over range partitions, which cut a busy day as well as a long year
        both = _beside(moments, cov, names, on)
        line = running(both, {"_last": ("last", F.col("_cov"))}, [], [on, "_side"], Scale(1, _ENDLESS, _ENDLESS))
        cov = line.filter("_side = 1").select(on, "_last.*")
    table_rows = cov.count()
    scale = Scale(table_rows, 0, 0)
    if not scale.broadcastable:
        scale = replace(measure(df, by), keys=table_rows)
    return attach(df, cov, by, scale, how="left")


def _beside(df: DataFrame, cov: DataFrame, names: Sequence[str], on: str) -> DataFrame:
    known = cov.filter(F.col(on).isNotNull()).select(
        *[c for c in cov.columns if c not in names], F.struct(*names).alias("_cov"), F.lit(0).alias("_side")
    )
    return df.withColumn("_side", F.lit(1)).unionByName(known, allowMissingColumns=True)


@nan_is_missing
def corr_lag0(
    df: DataFrame, x: str = "outdoor_temp", keys: Sequence[str] = KEYS, value: str = VALUE
) -> DataFrame:
    """Pearson correlation of the load with `x` per key; NULL where one of them is constant."""
    return df.groupBy(*keys).agg(correlation(value, x).alias("corr"))


@nan_is_missing
def lag_correlation(
    df: DataFrame,
    x: str = "outdoor_temp",
    max_lag: int = 24,
    keys: Sequence[str] = KEYS,
    ts: str = TS,
    value: str = VALUE,
    scale: Scale | None = None,
) -> DataFrame:
    """Correlation of the load with `x` shifted by 0 ... `max_lag` - 1 rows (below the key's length).

    NULL where one of them does not vary.  A key's moments at all lags come from one look at its rows; the
    moments of the blocks of a long key are merged.
    """
    scale = scale or measure(df, keys)
    known = df.select(*keys, ts, F.col(value).cast("double").alias("_y"), F.col(x).cast("double").alias("_x"))
    fields = [T.StructField("lag", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in MOMENTS]]

    def sums(rows: pd.DataFrame, before: int) -> pd.DataFrame:
        found = lagged_moments(rows["_y"].to_numpy(float), rows["_x"].to_numpy(float), before, max_lag)
        return pd.DataFrame(found, columns=["lag", *MOMENTS]).astype({"lag": np.int32})

    table = over_blocks(known, keys, ts, max_lag - 1, fields, sums, scale)
    if not scale.short_series:
        table = _merged_moments(table, [*keys, "lag"])
    varies = (F.col("y_low") < F.col("y_high")) & (F.col("x_low") < F.col("x_high"))
    corr = F.when(varies, F.col("xy") / F.nullif(F.sqrt(F.col("xx") * F.col("yy")), F.lit(0.0)))
    return table.select(*keys, "lag", corr.alias("corr"))


#: Rows with both numbers, their means, squares and products around these, least and largest of each.
MOMENTS = ("n", "x", "y", "xx", "yy", "xy", "x_low", "x_high", "y_low", "y_high")


def lagged_moments(y: np.ndarray, x: np.ndarray, before: int, lags: int) -> list[tuple]:
    """(lag, MOMENTS) of y[i] with x[i - lag] for the rows from place `before` on; lags without a row are left out."""
    out = []
    for lag in range(min(lags, len(y))):
        first = max(before, lag)
        a, b = y[first:], x[first - lag : len(x) - lag]
        if not len(a):
            break
        both = ~(np.isnan(a) | np.isnan(b))
        a, b = a[both], b[both]
        if len(a):
            my, mx = a.mean(), b.mean()
            u, v = a - my, b - mx
            out.append((lag, len(a), mx, my, v @ v, u @ u, u @ v, b.min(), b.max(), a.min(), a.max()))
        else:
            out.append((lag, 0, *[np.nan] * 9))
    return out


def _merged_moments(table: DataFrame, by: Sequence[str]) -> DataFrame:
    """The moments of sets of rows together: products around the common means."""
    known = F.col("n") > 0
    total = Window.partitionBy(*by)
    filled = table.withColumns({c: F.when(known, F.col(c)) for c in MOMENTS[1:]})
    means = {f"_m{c}": F.sum(F.col("n") * F.col(c)).over(total) / F.nullif(F.sum("n").over(total), F.lit(0.0)) for c in ("x", "y")}
    dx, dy = F.col("x") - F.col("_mx"), F.col("y") - F.col("_my")
    added = {"xx": dx * dx, "yy": dy * dy, "xy": dx * dy}
    return filled.withColumns(means).groupBy(*by).agg(
        F.sum("n").alias("n"),
        *[F.sum(F.col(c) + F.col("n") * extra).alias(c) for c, extra in added.items()],
        *[(F.min if c.endswith("low") else F.max)(c).alias(c) for c in MOMENTS[6:]],
    )


def best_lag(corrs: DataFrame, mode: str = "min", keys: Sequence[str] = KEYS) -> DataFrame:
    """Lag of the most negative (`'min'`) or strongest (`'abs'`) correlation; smallest lag of equals."""
    if mode not in ("min", "abs"):
        raise ValueError("mode must be 'min' or 'abs'")
    goal = F.col("corr") if mode == "min" else -F.abs("corr")
    first = F.min(F.struct(goal.alias("goal"), "lag", "corr"))
    return (
        corrs.filter(F.col("corr").isNotNull())
        .groupBy(*keys)
        .agg(first.alias("_b"))
        .select(*keys, F.col("_b.lag").alias("best_lag"), F.col("_b.corr").alias("best_corr"))
    )


@nan_is_missing
def shift_covariate(
    df: DataFrame,
    lags: DataFrame,
    x: str = "outdoor_temp",
    max_lag: int = 24,
    keys: Sequence[str] = KEYS,
    ts: str = TS,
    scale: Scale | None = None,
) -> DataFrame:
    """Adds `<x>_shifted`: `x` as many rows earlier as the key's `best_lag` (below `max_lag`) says."""
    scale = scale or measure(df, keys)
    known = attach_table(df, lags.select(*keys, "best_lag"), keys, scale, how="left")
    # the lag differs between keys: take it from the few candidates of the row
    rows = max_lag - 1
    shifted = look_back(known, lambda w: {"_recent": recent(x, rows, w)}, rows, keys, ts, scale)
    return shifted.withColumn(f"{x}_shifted", nan_to_null(F.get("_recent", "best_lag"))).select(
        *df.columns, f"{x}_shifted"
    )
