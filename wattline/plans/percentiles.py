"""Exact linearly interpolated percentiles per key, for keys of any length.

`percentile` keeps a value -> count map of a key in memory, which is fine up to
`scale.percentile_rows` rows per key.  Longer keys, and only they, are narrowed down first: a mergeable
sketch brackets each wanted rank, by rank and not by value, so no outlier widens a bracket; rows below it
are counted and only the distinct values inside, a few thousandths of the key, are ranked.  Weighted rows
are narrowed by equal-width bins instead, meant for values in a known range such as scores.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.plans.attach import attach, join_on
from wattline.plans.scale import Scale, measure
from wattline.session import cut_lineage

BINS = 65_536
ACCURACY = 10_000


def percentile_name(q: float) -> str:
    """Column name of a percentile: 0.95 -> p95, 0.995 -> p99_5."""
    return f"p{q * 100:.10g}".replace(".", "_")


def percentiles(
    df: DataFrame,
    value: str,
    q: Sequence[float],
    keys: Sequence[str],
    exact: bool = True,
    weight: str | None = None,
    extra: Sequence[Column] = (),
    scale: Scale | None = None,
) -> DataFrame:
    """One row per key with a column `p..` for each fraction in `q`; NULL values are left out.

    `weight` names a column of positive row counts; `extra` are further aggregates of the key, computed
    in the same pass where there is one.  `exact=False` uses the mergeable sketch behind
    `approx_percentile` instead (no interpolation).
    """
    if not exact:
        if weight is not None:
            raise ValueError("the sketch takes no weights")
        return df.groupBy(*keys).agg(
            *[F.percentile_approx(value, f, ACCURACY).alias(percentile_name(f)) for f in q], *extra
        )
    scale = scale or measure(df, keys)
    if scale.short_percentile:
        freq = F.lit(1) if weight is None else F.col(weight)
        return df.groupBy(*keys).agg(
            *[F.percentile(value, f, freq).alias(percentile_name(f)) for f in q], *extra
        )
    # a class per key: the long ones are few, so the rows of all others see nothing but a small join
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_size"))
    long = cut_lineage(sizes.filter(F.col("_size") > scale.percentile_rows))
    of_long = replace(scale, keys=long.count())
    marked = attach(df, long, keys, of_long, how="left")
    freq = F.lit(1) if weight is None else F.col(weight)
    short = marked.filter("_size is null").groupBy(*keys)
    built_in = short.agg(*[F.percentile(value, f, freq).alias(percentile_name(f)) for f in q], *extra)
    rows = marked.filter("_size is not null").drop("_size")
    per_key = rows.groupBy(*keys).agg(*extra) if extra else long.select(*keys)
    narrow = _bracketed(rows, value, q, keys, of_long) if weight is None else _narrowed(rows, value, q, keys, weight, of_long)
    # a key without any value keeps its row, as the built-in aggregate does
    narrowed = join_on(per_key, narrow, keys, "left", null_safe=True)
    return cut_lineage(built_in.unionByName(narrowed.select(*built_in.columns)))


def _between(q: Sequence[float], keys: Sequence[str], picked: DataFrame) -> DataFrame:
    """Percentiles from the values `_a<i>` at the lower and `_b<i>` at the upper rank of `_n` values."""
    columns = []
    for i, f in enumerate(q):
        place = F.lit(f) * (F.col("_n") - 1)
        below, above = F.floor(place), F.ceil(place)
        mixed = (above - place) * F.col(f"_a{i}") + (place - below) * F.col(f"_b{i}")
        columns.append(F.when(below == above, F.col(f"_a{i}")).otherwise(mixed).alias(percentile_name(f)))
    return picked.select(*keys, *columns)


def _bracketed(df: DataFrame, value: str, q: Sequence[float], keys: Sequence[str], scale: Scale) -> DataFrame:
    v, margin = F.col("_v"), 4.0 / ACCURACY
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    ends = {}
    for i, f in enumerate(q):
        # short keys have no use for a sketch: their bracket is the whole key
        long = F.count("*") > 10 * ACCURACY
        low = F.when(long & F.lit(f > margin), F.percentile_approx(v, max(f - margin, 0.0), ACCURACY)).otherwise(F.min(v))
        high = F.when(long & F.lit(f < 1 - margin), F.percentile_approx(v, min(f + margin, 1.0), ACCURACY)).otherwise(F.max(v))
        ends |= {f"_lo{i}": low, f"_hi{i}": high}
    brackets = rows.groupBy(*keys).agg(F.count("*").alias("_n"), *[c.alias(n) for n, c in ends.items()])
    # one pass counts what lies below each bracket, without a copy of any row; another ranks what lies inside
    bracketed = attach(rows, cut_lineage(brackets), keys, scale)
    below = bracketed.groupBy(*keys).agg(F.max("_n").alias("_n"), *[F.count_if(v < F.col(f"_lo{i}")).alias(f"_below{i}") for i in range(len(q))])
    inside = F.filter(
        F.array(*[F.when((v >= F.col(f"_lo{i}")) & (v <= F.col(f"_hi{i}")), F.lit(i)) for i in range(len(q))]), lambda i: i.isNotNull()
    )
    counted = (
        bracketed.select(*keys, "_v", F.explode(inside).alias("_i")).groupBy(*keys, "_i", "_v").agg(F.count("*").alias("_c"))
    )
    started = join_on(counted, below, keys, "inner", null_safe=True)
    before = F.element_at(F.array(*[F.col(f"_below{i}") for i in range(len(q))]), F.col("_i") + 1)
    ranked = started.withColumn("_upto", before + F.sum("_c").over(Window.partitionBy(*keys, "_i").orderBy("_v")))

    def at(i: int, rank: Column) -> Column:
        hit = (F.col("_i") == i) & (rank >= F.col("_upto") - F.col("_c")) & (rank < F.col("_upto"))
        return F.max(F.when(hit, v))

    n1 = F.col("_n") - 1
    picked = ranked.groupBy(*keys).agg(
        F.max("_n").alias("_n"),
        *[at(i, F.floor(F.lit(f) * n1)).alias(f"_a{i}") for i, f in enumerate(q)],
        *[at(i, F.ceil(F.lit(f) * n1)).alias(f"_b{i}") for i, f in enumerate(q)],
    )
    return _between(q, keys, picked)


def _bin(value: Column) -> Column:
    width = F.col("_hi") - F.col("_lo")
    cell = F.floor((value - F.col("_lo")) / F.nullif(width, F.lit(0.0)) * BINS)
    return F.least(F.coalesce(cell, F.lit(0)), F.lit(BINS - 1))


def _narrowed(
    df: DataFrame, value: str, q: Sequence[float], keys: Sequence[str], weight: str, scale: Scale
) -> DataFrame:
    v, w = F.col("_v"), F.col("_w")
    rows = df.filter(F.col(value).isNotNull()).select(
        *keys,
        F.col(value).cast("double").alias("_v"),
        F.col(weight).cast("bigint").alias("_w"),
    )
    # the tables in between have one row per key: stored, so that no later step repeats them
    bounds = cut_lineage(rows.groupBy(*keys).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi")))
    binned = attach(rows, bounds, keys, scale).withColumn("_bin", _bin(v))
    per_key = Window.partitionBy(*keys)
    counts = (
        binned.groupBy(*keys, "_bin")
        .agg(F.sum(w).alias("_c"))
        .withColumn("_upto", F.sum("_c").over(per_key.orderBy("_bin")))
        .withColumn("_n", F.sum("_c").over(per_key))
    )
    # ranks are 0-based; each fraction needs the value at its lower and at its upper rank
    ranks = F.array(
        *[F.floor(F.lit(f) * (F.col("_n") - 1)).cast("bigint") for f in q],
        *[F.ceil(F.lit(f) * (F.col("_n") - 1)).cast("bigint") for f in q],
    )
    before = F.col("_upto") - F.col("_c")
    wanted = cut_lineage(
        counts.withColumn("_ranks", F.filter(ranks, lambda r: (r >= before) & (r < F.col("_upto"))))
        .filter(F.size("_ranks") > 0)
        .groupBy(*keys)
        .agg(
            F.max("_n").alias("_n"),
            F.map_from_entries(F.collect_list(F.struct("_bin", before.alias("before")))).alias("_bins"),
        )
    )
    # at most 2 * len(q) bins per key survive the filter
    kept = (
        attach(binned, wanted, keys, scale)
        .withColumn("_before", F.try_element_at("_bins", "_bin"))
        .filter(F.col("_before").isNotNull())
        .groupBy(*keys, "_bin", "_v")
        .agg(F.sum(w).alias("_c"), F.first("_before").alias("_before"), F.first("_n").alias("_n"))
    )
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys, "_bin").orderBy("_v"))
    ranked = kept.withColumn("_upto", upto)
    n1 = F.col("_n") - 1

    def at(rank: Column) -> Column:
        hit = (rank >= F.col("_upto") - F.col("_c")) & (rank < F.col("_upto"))
        return F.max(F.when(hit, v))

    picked = ranked.groupBy(*keys).agg(
        F.max("_n").alias("_n"),
        *[at(F.floor(F.lit(f) * n1)).alias(f"_a{i}") for i, f in enumerate(q)],
        *[at(F.ceil(F.lit(f) * n1)).alias(f"_b{i}") for i, f in enumerate(q)],
    )
    return _between(q, keys, picked)
