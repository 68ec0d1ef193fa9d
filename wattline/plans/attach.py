"""Join a table with one row per key to the rows of that key without a skewed shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.plans.scale import Scale, measure
from wattline.session import cut_lineage

_PREFIX = "_right_"
_SPREAD = 1 << 20


def join_on(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str, null_safe: bool = False
) -> DataFrame:
    """Equi-join on `keys`, keeping the left key columns; `null_safe` lets NULL match NULL."""
    if not null_safe:
        return left.join(right, list(keys), how)
    renamed = right.withColumnsRenamed({key: _PREFIX + key for key in keys})
    matches: Column = reduce(
        lambda a, b: a & b, [F.col(key).eqNullSafe(F.col(_PREFIX + key)) for key in keys]
    )
    return left.join(renamed, matches, how).drop(*[_PREFIX + key for key in keys])


def hot_keys(df: DataFrame, keys: Sequence[str], scale: Scale) -> DataFrame:
    """Keys with more than 1 / `hot_parts` of all rows: fewer than `hot_parts`, however large `df`."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    return cut_lineage(counts.filter(F.col("_n") * scale.hot_parts > scale.rows).select(*keys))


def attach(
    df: DataFrame, table: DataFrame, keys: Sequence[str], scale: Scale | None = None, how: str = "inner"
) -> DataFrame:
    """`df` joined with `table`, which has at most one row per key; `how` is 'inner' or 'left'.

    A NULL key is a key like any other, as it is for a window or a group.

    Up to `scale.broadcast_rows` keys, and as many bytes, the table is broadcast and `df` is not shuffled.  Beyond that
    the part of the table for hot keys is broadcast, and the other rows find theirs in a shuffle join
    in which no key is large.  Hot rows pass through that join spread by a hash of their columns, so
    `df` is read once.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    scale = scale or measure(df, keys)
    if scale.may_broadcast(table):
        return join_on(df, F.broadcast(table), keys, how, null_safe=True)
    if not scale.rows:  # the caller knew the size of the table only
        scale = replace(measure(df, keys), keys=scale.keys)
    names = [c for c in table.columns if c not in keys]
    stored = cut_lineage(table)
    hot = hot_keys(df, keys, scale)
    hits = join_on(stored, F.broadcast(hot), keys, "left_semi", null_safe=True).select(
        *keys, *[F.col(c).alias("_h_" + c) for c in names], F.lit(True).alias("_hit")
    )
    known = F.broadcast(
        join_on(hot.withColumn("_hot", F.lit(True)), F.broadcast(hits), keys, "left", null_safe=True)
    )
    settled = F.col("_hot").isNotNull()
    salt = F.when(settled, 1 + F.pmod(F.xxhash64(*df.columns), F.lit(_SPREAD))).otherwise(F.lit(0))
    tail = stored.select(
        *keys,
        *[F.col(c).alias("_t_" + c) for c in names],
        F.lit(0).cast("bigint").alias("_salt"),
        F.lit(True).alias("_found"),
    )
    salted = join_on(df, known, keys, "left", null_safe=True).withColumn("_salt", salt.cast("bigint"))
    joined = join_on(salted, tail, [*keys, "_salt"], "left", null_safe=True)
    if how == "inner":
        joined = joined.filter(F.col("_hit") | F.col("_found"))
    return joined.select(
        *df.columns, *[F.coalesce(F.col("_h_" + c), F.col("_t_" + c)).alias(c) for c in names]
    )


def attach_table(
    df: DataFrame, table: DataFrame, keys: Sequence[str], scale: Scale | None = None, how: str = "inner"
) -> DataFrame:
    """`attach` for a table from elsewhere: its own rows are counted before it may be broadcast."""
    scale = scale or measure(df, keys)
    return attach(df, table, keys, replace(scale, keys=max(scale.keys, table.count())), how)


def attach_to_copies(
    df: DataFrame, table: DataFrame, keys: Sequence[str], scale: Scale, null_safe: bool = False
) -> DataFrame:
    """Inner `attach` for raw rows, which may be copies of each other in every column.

    Nothing tells such copies apart, so hot rows are not shuffled at all: they are read a second time
    and meet a broadcast.
    """
    if scale.may_broadcast(table):
        return join_on(df, F.broadcast(table), keys, "inner", null_safe)
    stored = cut_lineage(table)
    hot = F.broadcast(hot_keys(df, keys, scale))
    hot_table = F.broadcast(join_on(stored, hot, keys, "left_semi", null_safe))
    order = [*df.columns, *[c for c in table.columns if c not in keys]]
    head = join_on(df, hot_table, keys, "inner", null_safe)
    tail = join_on(
        join_on(df, hot, keys, "left_anti", null_safe), stored, keys, "inner", null_safe
    )
    return head.select(*order).unionByName(tail.select(*order))
