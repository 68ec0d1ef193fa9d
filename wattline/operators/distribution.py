"""Shape of the distribution of the values of a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.functions.columns import normal_density, ratio
from wattline.plans.attach import attach
from wattline.plans.missing import nan_is_missing
from wattline.plans.percentiles import percentiles
from wattline.plans.scale import Scale, measure
from wattline.schema import KEYS, VALUE


@nan_is_missing
def distribution_stats(
    df: DataFrame, keys: Sequence[str] = KEYS, value: str = VALUE, scale: Scale | None = None
) -> DataFrame:
    """Mean, median, sample deviation, skewness and excess kurtosis (population forms) per key."""
    moments = [
        F.avg(value).alias("mean_kw"),
        F.stddev_samp(value).alias("stddev_kw"),
        F.skewness(value).alias("skewness"),
        F.kurtosis(value).alias("kurtosis"),
    ]
    return percentiles(df, value, [0.5], keys, extra=moments, scale=scale).withColumnRenamed(
        "p50", "median_kw"
    )


@nan_is_missing
def normality_jb(df: DataFrame, keys: Sequence[str] = KEYS, value: str = VALUE) -> DataFrame:
    """Jarque-Bera test per key: statistic, and its probability (chi-squared, 2 degrees)."""
    moments = df.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.skewness(value).alias("skewness"),
        F.kurtosis(value).alias("kurtosis"),
    )
    s, k = F.col("skewness"), F.col("kurtosis")
    return moments.withColumn("jb", F.col("n") / 6.0 * (s * s + k * k / 4.0)).withColumn(
        "p_value", F.exp(-F.col("jb") / 2.0)
    )


@nan_is_missing
def histogram(
    df: DataFrame,
    edges: int = 40,
    keys: Sequence[str] = KEYS,
    value: str = VALUE,
    scale: Scale | None = None,
) -> DataFrame:
    """`edges` - 1 equal bins between the key's extremes, empty ones included, with density.

    The last bin is closed.  A key with a single value has all its rows in bin 0 and no density.
    """
    scale = scale or measure(df, keys)
    bins = edges - 1
    width = (F.col("_hi") - F.col("_lo")) / bins
    bounds = df.groupBy(*keys).agg(
        F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("_n")
    )
    cell = F.coalesce(F.floor(ratio(F.col(value) - F.col("_lo"), width)), F.lit(0))
    place = F.least(cell, F.lit(bins - 1))
    counts = (
        attach(df.filter(F.col(value).isNotNull()), bounds, keys, scale)
        .groupBy(*keys, place.cast("int").alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    grid = bounds.filter("_n > 0").withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    n = F.coalesce("n", F.lit(0))
    return grid.join(counts, [*keys, "bin"], "left").select(
        *keys,
        "bin",
        (F.col("_lo") + F.col("bin") * width).alias("bin_start"),
        (F.col("_lo") + (F.col("bin") + 1) * width).alias("bin_end"),
        n.alias("n"),
        ratio(n.cast("double"), F.col("_n") * width).alias("density"),
    )


@nan_is_missing
def gaussian_fit(
    df: DataFrame, points: int = 1000, keys: Sequence[str] = KEYS, value: str = VALUE
) -> DataFrame:
    """Normal density with the key's mean and deviation on an even grid between its extremes."""
    stats = df.groupBy(*keys).agg(
        F.min(value).alias("_lo"),
        F.max(value).alias("_hi"),
        F.avg(value).alias("_mean"),
        F.stddev_samp(value).alias("_std"),
    )
    x = F.col("_lo") + F.col("point") * ((F.col("_hi") - F.col("_lo")) / F.lit(points - 1))
    return (
        stats.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .withColumn("x", x)
        .select(*keys, "point", "x", normal_density("x", "_mean", "_std").alias("density"))
    )
