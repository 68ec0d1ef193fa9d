"""Reading and writing readings, and bringing raw events to the hourly grain."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.functions.columns import at_hour, decimal_comma, exact_sum, timestamp_from_text
from wattline.plans.missing import without_nan
from wattline.schema import KEYS, TS, VALUE

_STRETCH = 1000


def read_readings_csv(
    spark: SparkSession, path: str, sep: str = ";", encoding: str = "UTF-8"
) -> DataFrame:
    """CSV with a header row; every column stays text (no inference pass over the data)."""
    return spark.read.options(header=True, sep=sep, encoding=encoding, inferSchema=False).csv(path)


def normalise_headers(df: DataFrame) -> DataFrame:
    """Column names without surrounding blanks."""
    return df.toDF(*[name.strip() for name in df.columns])


def parse_decimal_comma(df: DataFrame, col: str = VALUE) -> DataFrame:
    """Text column with a decimal comma as double; text that is no number becomes NULL."""
    return df.withColumn(col, decimal_comma(col))


def parse_timestamp(
    df: DataFrame, col: str = TS, fmt: str | None = None, strict: bool = True
) -> DataFrame:
    """Text column as timestamp; bad text raises unless `strict` is off."""
    return df.withColumn(col, timestamp_from_text(col, fmt, strict))


def load_readings_csv(
    spark: SparkSession,
    path: str,
    columns: Mapping[str, str] | None = None,
    sep: str = ";",
    encoding: str = "UTF-8",
    fmt: str | None = None,
    strict: bool = True,
) -> DataFrame:
    """Typed readings from such a CSV; `columns` maps file headers to library names."""
    raw = normalise_headers(read_readings_csv(spark, path, sep, encoding))
    named = raw.withColumnsRenamed(dict(columns or {"timestamp": TS}))
    return parse_timestamp(parse_decimal_comma(named), fmt=fmt, strict=strict)


def read_readings_table(
    spark: SparkSession, name_or_path: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """Catalog table, or Parquet folder if the name is a path."""
    is_path = "/" in name_or_path or name_or_path.endswith(".parquet")
    df = spark.read.parquet(name_or_path) if is_path else spark.table(name_or_path)
    chosen = df.select(*columns) if columns else df
    return without_nan(chosen, VALUE)  # NaN is missing from the start


def write_readings(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = ("month",),
    mode: str = "errorifexists",
    keys: Sequence[str] = KEYS,
    ts: str = TS,
) -> None:
    """Readings as Parquet, partitioned by month so that period filters skip folders.

    A key's month is written together and in time order.  The rebalance lets AQE merge small shuffle
    partitions and split large ones, so file sizes are even and a key with most of the rows does not
    end in one task.
    """
    out = df
    if "month" in partition_by and "month" not in df.columns:
        out = df.withColumn("month", F.date_format(F.to_date(ts), "yyyy-MM"))
    even = out.hint("rebalance", *[F.col(c) for c in (*partition_by, *keys)])
    even.sortWithinPartitions(*partition_by, *keys, ts).write.mode(mode).partitionBy(
        *partition_by
    ).parquet(path)


def write_report(frames: Mapping[str, DataFrame], folder: str, mode: str = "errorifexists") -> None:
    """One Parquet table per result, named after it."""
    for name, frame in frames.items():
        frame.write.mode(mode).parquet(f"{folder}/{name}")


def hourly_readings(
    events: DataFrame,
    key: str | Sequence[str],
    ts: str = "ts",
    value: str = "value",
    agg: str = "sum",
    places: int | None = None,
) -> DataFrame:
    """One reading per key and hour from irregular events; NaN is missing.

    Sums are exact in decimals, so they do not depend on the order of the events; `places` rounds them.
    """
    events = without_nan(events, value)
    names = [key] if isinstance(key, str) else list(key)
    totals = {
        "sum": exact_sum(value, places),
        "avg": F.avg(value),
        "min": F.min(value),
        "max": F.max(value),
    }
    renamed = [F.col(names[0]).alias(KEYS[0])] if len(names) == 1 else [F.col(n) for n in names]
    out = [KEYS[0]] if len(names) == 1 else names
    # grouping by two whole numbers is cheaper per row than building the timestamp first
    return (
        events.groupBy(*renamed, F.to_date(ts).alias("_day"), F.hour(ts).alias("_hour"))
        .agg(totals[agg].cast("double").alias(VALUE))
        .select(*out, at_hour("_day", "_hour").alias(TS), VALUE)
    )


def calendar_spine(
    df: DataFrame,
    start: datetime | None = None,
    end: datetime | None = None,
    step: timedelta = timedelta(hours=1),
    keys: Sequence[str] = KEYS,
    ts: str = TS,
) -> DataFrame:
    """Every key at every step between the bounds (default: first and last timestamp of `df`).

    Join the readings to it from the left to expose gaps.  The calendar is generated by the tasks that
    hold the keys, a bounded stretch of steps at a time.
    """
    if start is None or end is None:
        first, last = df.agg(F.min(ts), F.max(ts)).first()
        start, end = start or first, end or last
    if start is None or end is None or end < start:
        return df.select(*keys, ts).limit(0)
    last_step = (end - start) // step
    stretch = F.col("_from")
    return (
        df.select(*keys)
        .distinct()
        .withColumn("_from", F.explode(F.sequence(F.lit(0), F.lit(last_step), F.lit(_STRETCH))))
        .withColumn(
            "_step", F.explode(F.sequence(stretch, F.least(stretch + _STRETCH - 1, F.lit(last_step))))
        )
        .select(*keys, (F.lit(str(start)).cast("timestamp_ntz") + F.col("_step") * F.lit(step)).alias(ts))
    )
