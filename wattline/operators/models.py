"""Load against a covariate: straight line and random forest, with their errors."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.operators.covariate import best_lag, lag_correlation, shift_covariate
from wattline.operators.forest import forest_answers
from wattline.plans.attach import attach, join_on
from wattline.plans.missing import nan_is_missing
from wattline.plans.scale import Scale, measure
from wattline.schema import KEYS, TS, VALUE
from wattline.session import stage


@nan_is_missing
def linear_fit(
    df: DataFrame,
    x: str = "outdoor_temp",
    y: str = VALUE,
    coef_scale: int | None = 1,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Least-squares slope and intercept per key, rounded half-even to `coef_scale` places if given."""
    fit = df.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept")
    )
    if coef_scale is None:
        return fit
    return fit.withColumns({c: F.bround(c, coef_scale) for c in ("slope", "intercept")})


@nan_is_missing
def linear_predict(
    df: DataFrame,
    fit: DataFrame,
    x: str = "outdoor_temp",
    keys: Sequence[str] = KEYS,
    scale: Scale | None = None,
) -> DataFrame:
    """Readings with the prediction `yhat` of their key's line; rows without `x` are left out."""
    known = attach(df.filter(F.col(x).isNotNull()), fit.select(*keys, "slope", "intercept"), keys, scale)
    return known.withColumn("yhat", F.col("slope") * F.col(x) + F.col("intercept")).drop("slope", "intercept")


@nan_is_missing
def regression_metrics(
    df: DataFrame, y: str = VALUE, yhat: str = "yhat", keys: Sequence[str] = KEYS
) -> DataFrame:
    """Mean absolute error and root mean squared error per key."""
    error = F.col(y) - F.col(yhat)
    return df.groupBy(*keys).agg(
        F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse")
    )


@nan_is_missing
def forest_fit(
    df: DataFrame,
    key_values: Sequence[object] | None = None,
    x: str = "outdoor_temp",
    y: str = VALUE,
    trees: int = 100,
    seed: int = 42,
    max_depth: int = 30,
    max_bins: int | None = None,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """In-sample predictions `yhat` of one random forest per key: all keys, or those whose first part is named.

    All forests grow in one pass (`operators.forest`), so neither the number of keys nor the length of one
    adds Spark jobs.  A split may fall between any two values of `x` (in single precision, so that the last
    bits of a computed regressor make no values of their own), or between `max_bins` bins of about equally
    many rows.  Rows without `x` or `y` are left out; a NULL key is a key like any other.
    """
    if key_values is not None and not key_values:
        raise ValueError("name the keys to model")
    known = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    known = known.withColumn("_x", F.col(x).cast("float").cast("double"))
    if key_values is not None:
        named = F.col(keys[0]).isin([k for k in key_values if k is not None])
        known = known.filter(named | F.col(keys[0]).isNull() if None in key_values else named)
    known = stage(known, "forest")
    return forest_answers(known, y, trees, seed, max_depth, max_bins, keys).drop("_x")


@nan_is_missing
def model_comparison(
    df: DataFrame,
    key_values: Sequence[object] | None = None,
    x: str = "outdoor_temp",
    max_lag: int = 24,
    coef_scale: int | None = 1,
    trees: int = 100,
    seed: int = 42,
    max_depth: int = 30,
    keys: Sequence[str] = KEYS,
    ts: str = TS,
    value: str = VALUE,
    scale: Scale | None = None,
) -> DataFrame:
    """Errors of the line at lag 0 and at the best lag for every key, and of a forest for `key_values`.

    Columns: key, model, lag, corr, slope, intercept, mae, rmse.
    """
    scale = scale or measure(df, keys)
    corrs = lag_correlation(df, x, max_lag, keys, ts, value, scale)
    best = best_lag(corrs, "min", keys)
    shifted = shift_covariate(df, best, x, max_lag, keys, ts, scale)
    at_zero = corrs.filter("lag = 0").select(*keys, "lag", "corr")
    at_best = best.select(*keys, F.col("best_lag").alias("lag"), F.col("best_corr").alias("corr"))
    parts = []
    for column, lags in ((x, at_zero), (f"{x}_shifted", at_best)):
        fit = linear_fit(shifted, column, value, coef_scale, keys)
        errors = regression_metrics(linear_predict(shifted, fit, column, keys, scale), value, keys=keys)
        line = join_on(fit, errors, keys, "inner", null_safe=True).withColumn("model", F.lit("linear"))
        parts.append(join_on(lags, line, keys, "inner", null_safe=True))
        if key_values:
            predicted = forest_fit(shifted, key_values, column, value, trees, seed, max_depth, keys=keys)
            forest = regression_metrics(predicted, value, keys=keys).withColumn("model", F.lit("forest"))
            parts.append(join_on(lags, forest, keys, "inner", null_safe=True))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
