"""Ordered work inside a key: look-back windows, running values and positions.

A key up to `scale.series_rows` rows is one window partition (one shuffle by key, one sort).  A longer
key is cut so that no task ever holds it:

* running values are a prefix scan over range partitions of (key, order): each partition scans its own
  rows, and a table of one row per key and partition carries the totals of the partitions before;
* look-back windows run over blocks of consecutive positions, each block carrying a copy of the last
  rows of the block before it.

Both give the rows the plain window would give.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from wattline.plans.attach import join_on
from wattline.plans.scale import Scale, measure
from wattline.session import stage

Running = tuple[str, Column]  # ('sum' | 'max' | 'last', expression)


def _fold(kind: str, value: Column, window: WindowSpec) -> Column:
    if kind == "sum":
        return F.sum(value).over(window)
    if kind == "max":
        return F.max(value).over(window)
    if kind == "last":
        return F.last(value, ignorenulls=True).over(window)
    raise ValueError(f"unknown running value {kind!r}")


def _combine(kind: str, before: Column, here: Column) -> Column:
    if kind == "sum":
        return F.when(before.isNull(), here).when(here.isNull(), before).otherwise(before + here)
    if kind == "max":
        return F.greatest(before, here)
    return F.coalesce(here, before)


def _micros(ts: str) -> Column:
    """Microseconds of a timestamp without a zone, whatever the session's zone."""
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("bigint")
    clock = F.hour(ts) * 3_600 + F.minute(ts) * 60
    return (days * 86_400 + clock) * 1_000_000 + F.round(F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")


def range_parts(df: DataFrame, keys: Sequence[str], order: Sequence[str], scale: Scale) -> DataFrame:
    """`df` with `_part`, its range partition along (keys, order); NULLs come first, as in a window.

    Partitions hold about equally many rows wherever they lie, of one key or of many; a row number spreads
    rows that are equal in all of these.  The frame is stored, so every later pass sees the same partitions.
    """
    wanted = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(2, min(wanted, 2 * scale.rows // scale.series_rows + 1))
    by = [F.col(c).asc_nulls_first() for c in (*keys, *order)]
    spread = df.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(parts, *by, "_row")
    return stage(spread.withColumn("_part", F.spark_partition_id()).drop("_row"), "ranges")


def running(
    df: DataFrame,
    columns: Mapping[str, Running],
    keys: Sequence[str],
    order: Sequence[str],
    scale: Scale | None = None,
) -> DataFrame:
    """Add running sums, maxima or last known values up to and including each row.

    Without keys the whole frame is one series.  Rows with a NULL order value sort first.  Nothing is
    broadcast by force: the carried totals have one row per key and range partition.
    """
    scale = scale or measure(df, keys)
    if scale.short_series:
        window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({name: _fold(kind, value, window) for name, (kind, value) in columns.items()})

    for name, (_, value) in columns.items():
        df = df.withColumn("_v_" + name, value)
    placed = range_parts(df, keys, order, scale)
    position = F.struct(*order)
    totals = {
        "sum": lambda v: F.sum(v),
        "max": lambda v: F.max(v),
        "last": lambda v: F.max_by(v, F.when(v.isNotNull(), position)),
    }
    by = [*keys, "_part"]
    per_part = placed.groupBy(*by).agg(
        *[totals[kind](F.col("_v_" + name)).alias("_t_" + name) for name, (kind, _) in columns.items()]
    )
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_part.select(
        *by, *[_fold(kind, F.col("_t_" + name), earlier).alias("_b_" + name) for name, (kind, _) in columns.items()]
    )
    joined = join_on(placed, carried, by, "inner", null_safe=True)
    inside = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    done = joined.withColumns(
        {
            name: _combine(kind, F.col("_b_" + name), _fold(kind, F.col("_v_" + name), inside))
            for name, (kind, _) in columns.items()
        }
    )
    return done.select(*[c for c in df.columns if c not in {"_v_" + name for name in columns}], *columns)


def with_position(
    df: DataFrame, keys: Sequence[str], ts: str, name: str = "row_index", scale: Scale | None = None
) -> DataFrame:
    """Add the 0-based position of each row inside its key, ordered by time."""
    numbered = running(df, {name: ("sum", F.lit(1).cast("bigint"))}, keys, [ts], scale=scale)
    return numbered.withColumn(name, F.col(name) - 1)


def time_pairs(
    df: DataFrame, column: str, hours: int, keys: Sequence[str], ts: str, scale: Scale | None = None
) -> DataFrame:
    """(keys, lag, _x, _y): each value with those exactly 1 ... `hours` hours before it.

    No grid is built: the lag is the distance in time, so series may start at any moment and have gaps.
    Readings whole hours apart lie on the same microsecond of their hours, so this is a key: a row meets as
    many others as there are lags, however many readings an hour has.  Long keys are also cut into
    stretches of hours, each with a copy of the last hours before it.
    """
    scale = scale or measure(df, keys)
    hour, by = F.col("_hour"), [*keys, "_moment"]
    timed = df.select(*keys, F.col(column).alias("_x"), _micros(ts).alias("_us")).filter("_us is not null")
    timed = timed.withColumn("_hour", F.expr("_us div 3600000000")).withColumn("_moment", F.col("_us") - hour * 3_600_000_000)
    if not scale.short_series:
        span = max(hours, scale.block_rows)
        home = F.floor(hour / span)
        copies = F.array(home, F.when(F.pmod(hour, F.lit(span)) >= span - hours, home + 1))
        timed = timed.withColumn("_home", home).withColumn("_block", F.explode(F.array_compact(copies)))
        by.append("_block")
    window = Window.partitionBy(*by).orderBy("_hour").rangeBetween(-hours, -1)
    near = timed.withColumn("_near", F.collect_list(F.struct("_hour", "_x")).over(window))
    if not scale.short_series:
        near = near.filter("_block = _home")
    pairs = near.select(*keys, "_x", "_hour", F.explode("_near").alias("_o"))
    apart = hour - F.col("_o")["_hour"]
    return pairs.select(*keys, apart.cast("int").alias("lag"), "_x", F.col("_o")["_x"].alias("_y"))


def recent(column: str, rows: int, window: WindowSpec) -> Column:
    """The value of a row and of up to `rows` rows before it, newest first, as an array of doubles.

    A missing value is kept as NaN, so that an index is a number of rows.  One array is much cheaper
    than as many `lag` columns.
    """
    kept = F.coalesce(F.col(column).cast("double"), F.lit(float("nan")))
    return F.reverse(F.collect_list(kept).over(window.rowsBetween(-rows, 0)))


def position_blocks(
    df: DataFrame, keys: Sequence[str], ts: str, rows: int, scale: Scale, ahead: int = 0
) -> DataFrame:
    """Rows with `_pos`, cut by it into blocks: `_block` also holds copies of the `rows` rows before its own
    (whose `_home` it is) and of the `ahead` rows behind them."""
    size = max(scale.block_rows, rows, ahead)
    home, place = F.floor(F.col("_pos") / size), F.col("_pos") % size
    copies = F.array(home, F.when(place >= size - rows, home + 1), F.when(place < ahead, home - 1))
    placed = with_position(df, keys, ts, "_pos", scale).withColumn("_home", home)
    return placed.withColumn("_block", F.explode(F.array_compact(copies)))


def over_blocks(
    df: DataFrame, keys: Sequence[str], ts: str, rows: int, fields: Sequence[T.StructField],
    build: Callable[[pd.DataFrame, int], pd.DataFrame], scale: Scale,
) -> DataFrame:
    """(keys, fields) that `build` makes of each series, or of each block of long ones, sorted by time.

    `build` gets the rows of a block and how many of them, at the front, are copies of the `rows` rows before
    its own.  One shuffle; what a long key's blocks give must be merged by the caller.
    """
    names, by = list(keys), list(keys)
    schema = T.StructType([*[df.schema[k] for k in names], *fields])
    if scale.short_series:
        blocks, order = df, ts
    else:
        blocks, order = position_blocks(df, keys, ts, rows, scale), "_pos"
        by.append("_block")

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order, kind="stable")
        before = int((group["_home"] != group["_block"]).sum()) if "_home" in group else 0
        out = build(group, before)
        for name, part in reversed(list(zip(names, key))):
            out.insert(0, name, part)
        return out

    return blocks.groupBy(*by).applyInPandas(run, schema)


def look_back(
    df: DataFrame,
    build: Callable[[WindowSpec], Mapping[str, Column]],
    rows: int,
    keys: Sequence[str],
    ts: str,
    scale: Scale | None = None,
    ahead: int = 0,
) -> DataFrame:
    """Add columns that look at most `rows` rows back in time, and at most `ahead` rows forward.

    `build` gets a window (partitioned and ordered, without a frame) and returns the new columns; all
    of them share one shuffle and one sort.
    """
    scale = scale or measure(df, keys)
    if scale.short_series:
        return df.withColumns(dict(build(Window.partitionBy(*keys).orderBy(ts))))

    blocks = position_blocks(df, keys, ts, rows, scale, ahead)
    window = Window.partitionBy(*keys, "_block").orderBy("_pos")
    added = dict(build(window))
    return blocks.withColumns(added).filter(F.col("_block") == F.col("_home")).select(*df.columns, *added)
