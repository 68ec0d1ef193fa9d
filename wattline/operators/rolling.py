"""Trailing-window statistics by row position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from wattline.functions.columns import ratio
from wattline.plans.missing import nan_is_missing
from wattline.plans.scale import Scale
from wattline.plans.series import look_back
from wattline.schema import KEYS, TS, VALUE

WINDOWS = (3, 6, 12)


def _full(window: WindowSpec, w: int, value: str, result) -> Column:
    """`result` over the last `w` rows, NULL unless all of them have a value."""
    frame = window.rowsBetween(1 - w, 0)
    return F.when(F.count(value).over(frame) == w, result(frame))


def _mean(window: WindowSpec, w: int, value: str) -> Column:
    return _full(window, w, value, lambda f: F.avg(value).over(f))


def _std(window: WindowSpec, w: int, value: str) -> Column:
    return _full(window, w, value, lambda f: F.stddev_samp(value).over(f))


def _cv(window: WindowSpec, w: int, value: str) -> Column:
    return _full(window, w, value, lambda f: ratio(F.stddev_samp(value).over(f), F.avg(value).over(f)))


def _rolling(df, prefix, column, windows, keys, ts, value, scale) -> DataFrame:
    return look_back(
        df,
        lambda window: {f"{prefix}_{w}": column(window, w, value) for w in windows},
        max(windows) - 1,
        keys,
        ts,
        scale,
    )


@nan_is_missing
def rolling_mean(
    df: DataFrame,
    windows: Sequence[int] = WINDOWS,
    keys: Sequence[str] = KEYS,
    ts: str = TS,
    value: str = VALUE,
    scale: Scale | None = None,
) -> DataFrame:
    """Mean of the last w rows as `mean_<w>`; NULL until w rows are there."""
    return _rolling(df, "mean", _mean, windows, keys, ts, value, scale)


@nan_is_missing
def rolling_std(
    df: DataFrame,
    windows: Sequence[int] = WINDOWS,
    keys: Sequence[str] = KEYS,
    ts: str = TS,
    value: str = VALUE,
    scale: Scale | None = None,
) -> DataFrame:
    """Sample deviation of the last w rows as `std_<w>`."""
    return _rolling(df, "std", _std, windows, keys, ts, value, scale)


@nan_is_missing
def rolling_cv(
    df: DataFrame,
    windows: Sequence[int] = WINDOWS,
    keys: Sequence[str] = KEYS,
    ts: str = TS,
    value: str = VALUE,
    scale: Scale | None = None,
) -> DataFrame:
    """Deviation over mean of the last w rows as `cv_<w>`."""
    return _rolling(df, "cv", _cv, windows, keys, ts, value, scale)


@nan_is_missing
def shift(
    df: DataFrame,
    col: str = VALUE,
    n: int = 1,
    keys: Sequence[str] = KEYS,
    ts: str = TS,
    scale: Scale | None = None,
) -> DataFrame:
    """Value of `col` n rows earlier (later, if n is negative), as `<col>_lag<n>`."""
    shifted = lambda w: {f"{col}_lag{n}": F.lag(col, n).over(w)}
    return look_back(df, shifted, max(n, 0), keys, ts, scale, ahead=max(-n, 0))
