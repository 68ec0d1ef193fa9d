"""Places of rows in a total order that no single task ever holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattline.llm.common import stored


def ranged(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """`df` sorted by `order` (nulls first) over range partitions and stored, with `part` and `at`.

    `at` grows along the whole order, `part` (the range partition) with it.  Equal rows share a
    partition: end `order` with a column that tells them apart where there may be many.
    """
    keys = [F.col(c).asc_nulls_first() for c in order]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = placed.withColumn("at", F.monotonically_increasing_id())
    return stored(placed.withColumn("part", F.shiftright("at", 33)), name)


def numbered(df: DataFrame, group: str, order: Sequence[str], name: str) -> DataFrame:
    """`df` with idx (from 0, within `group`, by `order`) and n (rows of the group).

    A group may hold any share of the rows: a range partition knows its own places, and a table of one
    row per group and partition adds the rows of the partitions before.  `group` holds no nulls.
    """
    placed = ranged(df, [group, *order], name)
    runs = placed.groupBy(group, "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    whole = Window.partitionBy(group)
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        group, "part", "first", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"), F.sum("rows").over(whole).alias("n")
    )
    found = placed.join(runs, [group, "part"])
    return found.select(*df.columns, (F.col("before") + F.col("at") - F.col("first")).alias("idx"), "n")
