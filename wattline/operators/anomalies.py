"""Statistical anomalies: z-score, robust z-score, rolling instability, and tables of findings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.functions.columns import ratio
from wattline.operators.profiles import daily_profile
from wattline.operators.rolling import rolling_cv
from wattline.plans.attach import attach
from wattline.plans.missing import nan_is_missing
from wattline.plans.percentiles import percentiles
from wattline.plans.scale import Scale, measure
from wattline.schema import KEYS, TS, VALUE
from wattline.session import stage

# Consistency factor of the MAD for a normal distribution; floor for a MAD of zero.
MAD_FACTOR = 1.4826
MAD_FLOOR = 1e-6


def _beyond(z: str, threshold: float | None, side: str) -> Column:
    if side not in ("two", "upper"):
        raise ValueError("side must be 'two' or 'upper'")
    if threshold is None:
        return F.lit(True)
    return (F.abs(z) if side == "two" else F.col(z)) > threshold


@nan_is_missing
def zscore(
    df: DataFrame,
    threshold: float | None = 2,
    ddof: int = 1,
    side: str = "two",
    keys: Sequence[str] = KEYS,
    value: str = VALUE,
    scale: Scale | None = None,
) -> DataFrame:
    """Rows whose distance from the key's mean exceeds `threshold` deviations, with the key's P95.

    `threshold=None` returns every row with its score.
    """
    scale = scale or measure(df, keys)
    deviation = F.stddev_samp(value) if ddof == 1 else F.stddev_pop(value)
    stats = percentiles(
        df, value, [0.95], keys, extra=[F.avg(value).alias("mean"), deviation.alias("stddev")], scale=scale
    )
    scored = attach(df, stats, keys, scale).withColumn(
        "z_score", ratio(F.col(value) - F.col("mean"), "stddev")
    )
    return scored.filter(_beyond("z_score", threshold, side))


@nan_is_missing
def robust_z(
    df: DataFrame,
    threshold: float | None = 2,
    side: str = "two",
    mad_floor: float | None = None,
    keys: Sequence[str] = KEYS,
    value: str = VALUE,
    scale: Scale | None = None,
) -> DataFrame:
    """Rows far from the key's median in units of 1.4826 times the median absolute deviation.

    A deviation of zero gives no score unless `mad_floor` replaces it.  `threshold=None` returns
    every row with its score.
    """
    scale = scale or measure(df, keys)
    medians = percentiles(df, value, [0.5], keys, scale=scale).withColumnRenamed("p50", "median")
    centred = attach(df, medians, keys, scale)
    distances = centred.select(*keys, F.abs(F.col(value) - F.col("median")).alias("_d"))
    mads = percentiles(distances, "_d", [0.5], keys, scale=scale).withColumnRenamed("p50", "mad")
    unit = F.col("mad") if mad_floor is None else F.when(F.col("mad") == 0, mad_floor).otherwise(F.col("mad"))
    scored = attach(centred, mads, keys, scale).withColumn(
        "z_robust", ratio(F.col(value) - F.col("median"), MAD_FACTOR * unit)
    )
    return scored.filter(_beyond("z_robust", threshold, side))


def _daily_means(df: DataFrame, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    return daily_profile(df, keys, ts, value).select(*keys, "date", "mean_kw")


@nan_is_missing
def zscore_daily(
    df: DataFrame,
    threshold: float | None = 2,
    ddof: int = 1,
    side: str = "two",
    keys: Sequence[str] = KEYS,
    ts: str = TS,
    value: str = VALUE,
) -> DataFrame:
    """`zscore` of the daily means."""
    return zscore(_daily_means(df, keys, ts, value), threshold, ddof, side, keys, "mean_kw")


@nan_is_missing
def robust_z_daily(
    df: DataFrame,
    threshold: float | None = 2,
    side: str = "two",
    mad_floor: float | None = None,
    keys: Sequence[str] = KEYS,
    ts: str = TS,
    value: str = VALUE,
) -> DataFrame:
    """`robust_z` of the daily means."""
    return robust_z(_daily_means(df, keys, ts, value), threshold, side, mad_floor, keys, "mean_kw")


@nan_is_missing
def instability_index(
    df: DataFrame,
    windows: Sequence[int] = (3, 6, 9, 12),
    mad_floor: float = MAD_FLOOR,
    keys: Sequence[str] = KEYS,
    ts: str = TS,
    value: str = VALUE,
    scale: Scale | None = None,
) -> DataFrame:
    """Robust z of the rolling coefficient of variation: one row per reading and window."""
    scale = scale or measure(df, keys)
    # the score below makes three passes: the windows are computed once and stored
    varied = stage(rolling_cv(df.select(*keys, ts, value), windows, keys, ts, value, scale), "rolling")
    per_window = F.explode(
        F.array(*[F.struct(F.lit(w).alias("w"), F.col(f"cv_{w}").alias("cv")) for w in windows])
    )
    long = varied.select(*keys, ts, value, per_window.alias("_e")).select(
        *keys, ts, value, F.col("_e.w").alias("window_rows"), F.col("_e.cv").alias("cv")
    )
    wider = replace(scale, keys=scale.keys * len(windows), rows=scale.rows * len(windows))
    scored = robust_z(long, None, "two", mad_floor, [*keys, "window_rows"], "cv", wider)
    return scored.select(*keys, ts, value, "window_rows", "cv", F.col("z_robust").alias("instability"))


def instability_points(
    index: DataFrame, moderate: float = 2, strong: float = 3
) -> DataFrame:
    """Unstable rows of `instability_index`, labelled moderate or strong."""
    z = F.col("instability")
    level = F.when(z > strong, "strong").when(z > moderate, "moderate")
    return index.withColumn("level", level).filter(F.col("level").isNotNull())


def anomaly_table(
    frames: Mapping[str, DataFrame], keys: Sequence[str] = KEYS, ts: str = TS, value: str = VALUE
) -> DataFrame:
    """Findings of several methods in one long table, tagged with the method."""
    tagged = [
        frame.select(*keys, ts, value, F.lit(method).alias("method")) for method, frame in frames.items()
    ]
    table = tagged[0]
    for frame in tagged[1:]:
        table = table.unionByName(frame)
    return table


def anomaly_counts(anomalies: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Number of findings per key and method."""
    return anomalies.groupBy(*keys, "method").agg(F.count("*").alias("anomalies"))


def anomaly_votes(
    anomalies: DataFrame, min_votes: int = 2, keys: Sequence[str] = KEYS, ts: str = TS, value: str = VALUE
) -> DataFrame:
    """Readings that at least `min_votes` methods agree on."""
    return (
        anomalies.groupBy(*keys, ts, value)
        .agg(F.count_distinct("method").alias("votes"))
        .filter(F.col("votes") >= min_votes)
    )
