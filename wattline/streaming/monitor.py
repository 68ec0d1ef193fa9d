"""The same readings as a stream.

Event time needs TIMESTAMP, so timestamps are cast (the session must run in UTC) and results are cast
back.  State is bounded by the watermark.  Nothing here starts a query: callers attach a sink with its
own checkpoint.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.functions.columns import exact_sum, ratio
from wattline.operators.anomalies import MAD_FACTOR
from wattline.plans.attach import join_on
from wattline.plans.missing import nan_is_missing
from wattline.schema import KEYS, TS, VALUE
from wattline.streaming.ring import rolling

BROADCAST_ROWS = 200_000


def _timed(stream: DataFrame, ts: str, watermark: str) -> DataFrame:
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)


def _plain(column: str) -> Column:
    return F.col(column).cast("timestamp_ntz")


def _with_table(stream: DataFrame, table: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """Stream joined with a static table of one row per key, broadcast only after counting it; NULL is a key."""
    small = table.count() <= rows
    return join_on(stream, F.broadcast(table) if small else table, keys, "inner", null_safe=True)


@nan_is_missing
def stream_hourly(
    stream: DataFrame,
    watermark: str = "2 hours",
    keys: Sequence[str] = KEYS,
    ts: str = TS,
    value: str = VALUE,
    places: int | None = None,
) -> DataFrame:
    """Energy per key and hour; rows later than the watermark are dropped.  Sums as in `hourly_readings`."""
    return (
        _timed(stream, ts, watermark)
        .groupBy(*keys, F.window(ts, "1 hour").alias("_w"))
        .agg(exact_sum(value, places).alias(value))
        .select(*keys, _plain("_w.start").alias(ts), value)
    )


@nan_is_missing
def stream_rolling(
    stream: DataFrame,
    windows: Sequence[int] = (3, 6, 12),
    watermark: str = "2 hours",
    keys: Sequence[str] = KEYS,
    ts: str = TS,
    value: str = VALUE,
) -> DataFrame:
    """Mean, deviation and variation over the last w hours, every hour, for each window length.

    An hour's line comes once the watermark has passed its end, if its window has readings.  State holds
    the moments of open hours, and of the closed ones that a window still needs: no copies of events.
    """
    return rolling(_timed(stream, ts, watermark), windows, keys, ts, value)


def stream_dedup(
    stream: DataFrame, watermark: str = "2 hours", keys: Sequence[str] = KEYS, ts: str = TS
) -> DataFrame:
    """First copy of each (key, timestamp) that arrives within the watermark."""
    timed = _timed(stream, ts, watermark)
    return timed.dropDuplicatesWithinWatermark([*keys, ts]).withColumn(ts, _plain(ts))


@nan_is_missing
def stream_zscore(
    stream: DataFrame,
    baseline: DataFrame,
    threshold: float = 2,
    keys: Sequence[str] = KEYS,
    value: str = VALUE,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Readings far from their key's baseline (mean, stddev, median, mad), by either score.

    The baseline is a static table with one row per key; store it, or each micro-batch computes it
    again.
    """
    scored = _with_table(stream, baseline, keys, broadcast_rows).withColumns(
        {
            "z_score": ratio(F.col(value) - F.col("mean"), "stddev"),
            "z_robust": ratio(F.col(value) - F.col("median"), MAD_FACTOR * F.col("mad")),
        }
    )
    return scored.filter((F.abs("z_score") > threshold) | (F.abs("z_robust") > threshold))


@nan_is_missing
def stream_overload_sessions(
    stream: DataFrame,
    limits: DataFrame,
    gap: str = "1 hour",
    watermark: str = "2 hours",
    limit: str = "contract_kw",
    keys: Sequence[str] = KEYS,
    ts: str = TS,
    value: str = VALUE,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Sessions of readings above the key's limit, closed after `gap` without one."""
    timed = _timed(stream, ts, watermark)
    over = _with_table(timed, limits.select(*keys, limit), keys, broadcast_rows).filter(
        F.col(value) > F.col(limit)
    )
    return (
        over.groupBy(*keys, F.session_window(ts, gap).alias("_s"))
        .agg(F.count("*").alias("readings"), F.max(value).alias("max_kw"))
        .select(
            *keys,
            _plain("_s.start").alias("session_start"),
            _plain("_s.end").alias("session_end"),
            "readings",
            "max_kw",
        )
    )
