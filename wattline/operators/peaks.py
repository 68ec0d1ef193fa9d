"""Highest and lowest hours of a day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from wattline.plans.missing import nan_is_missing

from wattline.plans.scale import Scale, measure
from wattline.schema import KEYS, TS, VALUE


def _ranked_days(
    df: DataFrame, k: int, highest: bool, name: str, keys: Sequence[str], ts: str, value: str, scale: Scale | None
) -> DataFrame:
    def direction(column: str) -> Column:
        return F.desc(column) if highest else F.asc_nulls_last(column)

    scale = scale or measure(df, keys)
    days = df.select(*keys, F.to_date(ts).alias("date"), F.col(value).alias("_v"))
    if scale.short_series:
        levels = days.withColumn("_n", F.lit(1))
    else:
        # equal readings become one level first: a flat day cannot fill a rank with endless ties
        levels = days.groupBy(*keys, "date", "_v").agg(F.count("*").alias("_n"))
    # ranks above k are dropped before the shuffle as well as after it
    place = F.dense_rank().over(Window.partitionBy(*keys, "date").orderBy(direction("_v")))
    means = (
        levels.withColumn("_place", place)
        .filter(F.col("_place") <= k)
        .groupBy(*keys, "date")
        .agg((F.sum(F.col("_v") * F.col("_n")) / F.sum(F.when(F.col("_v").isNotNull(), F.col("_n")))).alias(name))
    )
    month = Window.partitionBy(*keys).orderBy(direction(name))
    return means.withColumn("day_rank", F.rank().over(month))


@nan_is_missing
def daily_peaks(
    df: DataFrame,
    k: int = 3,
    keys: Sequence[str] = KEYS,
    ts: str = TS,
    value: str = VALUE,
    scale: Scale | None = None,
) -> DataFrame:
    """Mean of the readings at the `k` highest power levels of each day, and the rank of the day."""
    return _ranked_days(df, k, True, "peak_mean_kw", keys, ts, value, scale)


@nan_is_missing
def daily_troughs(
    df: DataFrame,
    k: int = 6,
    keys: Sequence[str] = KEYS,
    ts: str = TS,
    value: str = VALUE,
    scale: Scale | None = None,
) -> DataFrame:
    """Mean of the readings at the `k` lowest power levels of each day, and the rank of the day."""
    return _ranked_days(df, k, False, "trough_mean_kw", keys, ts, value, scale)


@nan_is_missing
def daily_extremes(
    df: DataFrame, keys: Sequence[str] = KEYS, ts: str = TS, value: str = VALUE
) -> DataFrame:
    """Hour of the lowest and of the highest reading of each day; the earliest of equals."""
    v, h = F.col(value), F.hour(ts)
    lowest = F.min(F.when(v.isNotNull(), F.struct(v.alias("v"), h.alias("h"))))
    highest = F.max(F.when(v.isNotNull(), F.struct(v.alias("v"), (-h).alias("h"))))
    days = df.groupBy(*keys, F.to_date(ts).alias("date")).agg(lowest.alias("lo"), highest.alias("hi"))
    return days.select(
        *keys,
        "date",
        F.col("lo.h").alias("min_hour"),
        F.col("lo.v").alias("min_kw"),
        (-F.col("hi.h")).alias("max_hour"),
        F.col("hi.v").alias("max_kw"),
    )


@nan_is_missing
def day_hour_matrix(
    df: DataFrame, keys: Sequence[str] = KEYS, ts: str = TS, value: str = VALUE
) -> DataFrame:
    """Mean power, one row per key and day, one column per hour (h00 ... h23)."""
    hours = list(range(24))
    cells = (
        df.select(*keys, F.to_date(ts).alias("date"), F.hour(ts).alias("hour"), value)
        .groupBy(*keys, "date")
        .pivot("hour", hours)
        .agg(F.avg(value))
    )
    return cells.withColumnsRenamed({str(h): f"h{h:02d}" for h in hours})
