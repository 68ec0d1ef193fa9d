"""Autocorrelation of a series, its confidence band, and ramps."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.functions.columns import ratio
from wattline.plans.attach import attach, join_on
from wattline.plans.missing import nan_is_missing
from wattline.plans.scale import Scale, measure
from wattline.plans.series import look_back, over_blocks, running, time_pairs
from wattline.schema import KEYS, TS, VALUE

#: Up to so many lags are summed one by one; more, all at once by a Fourier transform.
DIRECT_LAGS = 256


@nan_is_missing
def acf(
    df: DataFrame,
    max_lag: int = 96,
    by: str = "position",
    keys: Sequence[str] = KEYS,
    ts: str = TS,
    value: str = VALUE,
    scale: Scale | None = None,
) -> DataFrame:
    """Autocorrelation at lags 1 ... `max_lag` (below the length of the series), with that length.

    The denominator runs over all values.  `by='position'` counts rows; `by='time'` counts hours between
    readings, whatever minute they lie on, so a gap contributes no pairs instead of shortening the lag; a
    lag without any pair gives no row.
    """
    if by not in ("position", "time"):
        raise ValueError("by must be 'position' or 'time'")
    known = df.filter(F.col(value).isNotNull()).select(*keys, ts, F.col(value).cast("double").alias(value))
    scale = scale or measure(known, keys)
    means = known.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    centred = attach(known, means, keys, scale).select(*keys, ts, (F.col(value) - F.col("_mean")).alias("_x"))
    if by == "time":
        whole = centred.groupBy(*keys).agg(F.sum(F.col("_x") * F.col("_x")).alias("_total"), F.count("_x").alias("n"))
        pairs = time_pairs(centred, "_x", max_lag, keys, ts, scale)
        sums = pairs.groupBy(*keys, "lag").agg(F.sum(F.col("_x") * F.col("_y")).alias("_s"))
        table = join_on(sums, whole, keys, "inner", null_safe=True)
        return table.select(*keys, "lag", ratio("_s", "_total").alias("acf"), "n")

    def sums(rows: pd.DataFrame, before: int) -> pd.DataFrame:
        x = rows["_x"].to_numpy(float)
        found = lagged_sums(x, before, max_lag) if x[before:].any() else np.zeros(max_lag + 1)
        return pd.DataFrame({"lag": np.arange(max_lag + 1, dtype=np.int32), "_s": found, "n": len(x) - before})

    fields = [T.StructField("lag", T.IntegerType()), T.StructField("_s", T.DoubleType()), T.StructField("n", T.LongType())]
    table = over_blocks(centred, keys, ts, max_lag, fields, sums, scale)
    if not scale.short_series:
        table = table.groupBy(*keys, "lag").agg(F.sum("_s").alias("_s"), F.sum("n").alias("n"))
    # lag 0 holds the sum of squares
    total = F.max(F.when(F.col("lag") == 0, F.col("_s"))).over(Window.partitionBy(*keys))
    lags = table.withColumn("_total", total).filter((F.col("lag") > 0) & (F.col("lag") < F.col("n")))
    return lags.select(*keys, "lag", ratio("_s", "_total").alias("acf"), "n")


def lagged_sums(x: np.ndarray, before: int, max_lag: int) -> np.ndarray:
    """Sums of x[i] * x[i - k] over the values from place `before` on, for k up to `max_lag`."""
    if max_lag <= DIRECT_LAGS:
        return np.array([x[max(before, k) :] @ x[max(before, k) - k : max(len(x) - k, 0)] for k in range(max_lag + 1)])
    own = x[before:]
    padded = np.concatenate((np.zeros(max_lag), x))  # values before the first one count nothing
    size = 1 << int(np.ceil(np.log2(len(padded) + len(own))))
    products = np.fft.irfft(np.fft.rfft(padded, size) * np.conj(np.fft.rfft(own, size)), size)
    return products[before + max_lag - np.arange(max_lag + 1)]  # at shift d: the sum of own[i] * padded[i + d]


def acf_confint(acf_table: DataFrame, alpha: float = 0.05, keys: Sequence[str] = KEYS) -> DataFrame:
    """Half width of the band around zero at each lag (Bartlett's formula), as `bound`."""
    z = NormalDist().inv_cdf(1 - alpha / 2)
    earlier = Window.partitionBy(*keys).orderBy("lag").rowsBetween(Window.unboundedPreceding, -1)
    squares = F.coalesce(F.sum(F.col("acf") * F.col("acf")).over(earlier), F.lit(0.0))
    return acf_table.withColumn("bound", F.lit(z) * F.sqrt((1.0 + 2.0 * squares) / F.col("n")))


@nan_is_missing
def load_ramps(
    df: DataFrame,
    min_run: int = 3,
    keys: Sequence[str] = KEYS,
    ts: str = TS,
    value: str = VALUE,
    scale: Scale | None = None,
) -> DataFrame:
    """Runs of at least `min_run` rises in a row: start, end, number of rises and total rise."""
    scale = scale or measure(df, keys)
    known = df.select(*keys, ts, value)
    stepped = look_back(known, lambda w: {"_prev": F.lag(value).over(w)}, 1, keys, ts, scale)
    # a run starts at the last row that did not rise
    starts = ("max", F.when(~F.coalesce(F.col(value) > F.col("_prev"), F.lit(False)), F.col(ts)))
    return (
        running(stepped, {"start_ts": starts}, keys, [ts], scale=scale)
        .groupBy(*keys, "start_ts")
        .agg(
            F.max(ts).alias("end_ts"),
            (F.count("*") - 1).alias("rises"),
            (F.max(value) - F.min(value)).alias("total_rise_kw"),
        )
        .filter(F.col("rises") >= min_run)
    )
