"""Rolling statistics of a stream from hourly moments.

An event is aggregated once, into the moments of its hour.  When the watermark has closed an hour, its one
row goes to the windows that hold it, so the copies that overlapping windows need are of hours and not of
events.  Moments are merged without squaring large numbers, oldest hour first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.functions.columns import ratio


def moments(value: str) -> Column:
    """Rows, rows with a value, their mean and the squares around it."""
    n = F.count(value)
    squares = F.coalesce(F.var_pop(value) * n, F.lit(0.0))
    return F.struct(F.count("*").alias("rows"), n.alias("n"), F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"), squares.alias("squares"))


def merged(a: Column, b: Column) -> Column:
    """The moments of two sets of rows together."""
    n, step = a["n"] + b["n"], b["mean"] - a["mean"]
    share = F.when(n > 0, b["n"] / n).otherwise(0.0)
    return F.struct(
        (a["rows"] + b["rows"]).alias("rows"),
        n.alias("n"),
        F.when(a["n"] == 0, b["mean"]).otherwise(a["mean"] + step * share).alias("mean"),
        (a["squares"] + b["squares"] + F.when(a["n"] == 0, 0.0).otherwise(step * step * a["n"] * share)).alias("squares"),
    )


def rolling(timed: DataFrame, windows: Sequence[int], keys: Sequence[str], ts: str, value: str) -> DataFrame:
    """(keys, window_hours, window_end, mean_kw, stddev_kw, cv, n) of a stream with a watermark on `ts`."""
    hourly = timed.groupBy(*keys, F.window(ts, "1 hour").alias("_hour")).agg(moments(F.col(value).cast("double")).alias("_m"))
    longest = F.window(F.window_time("_hour"), f"{max(windows)} hours", "1 hour").alias("_w")
    held = F.collect_list(F.struct(F.col("_hour.start").alias("at"), F.col("_m").alias("m")))
    rings = hourly.groupBy(*keys, longest).agg(F.array_sort(held).alias("_held"))
    nothing = F.struct(F.lit(0).cast("bigint").alias("rows"), F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))

    def line(hours: int) -> Column:
        since = F.col("_w.end") - F.make_dt_interval(hours=F.lit(hours))
        inside = F.filter("_held", lambda hour: hour["at"] >= since)
        total = F.aggregate(inside, nothing, lambda done, hour: merged(done, hour["m"]))
        return F.struct(F.lit(hours).alias("window_hours"), total.alias("m"))

    lines = F.explode(F.array(*[line(hours) for hours in windows])).alias("_l")
    out = rings.select(*keys, F.col("_w.end").cast("timestamp_ntz").alias("window_end"), lines).filter("_l.m.rows > 0")
    n, mean = F.col("_l.m.n"), F.when(F.col("_l.m.n") > 0, F.col("_l.m.mean"))
    spread = F.when(n > 1, F.sqrt(F.col("_l.m.squares") / (n - 1)))
    return out.select(
        *keys, "_l.window_hours", "window_end", mean.alias("mean_kw"), spread.alias("stddev_kw"), ratio(spread, mean).alias("cv"), n.alias("n")
    )
