"""How large the keys of a frame are, and which plan follows from it.

Every per-key operator has two exact plans: a short one for the usual case of many keys of moderate
length, and one that splits a key over many tasks.  `measure` finds out which applies with one cheap
aggregation (it reads the key columns only and returns a single row); pass the result on as `scale=`
to measure once for many operators.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Scale:
    """Size of the keys and the limits at which an operator changes its plan (never its result)."""

    keys: int  # number of distinct keys
    largest: int  # rows of the longest key
    rows: int  # rows of all keys
    broadcast_rows: int = 200_000  # a per-key table up to this size is broadcast
    broadcast_bytes: int = 128 << 20  # if its rows, as wide as their types say, are not more than this together
    hot_parts: int = 10_000  # a key with more than rows / hot_parts rows is hot: at most hot_parts of them
    series_rows: int = 2_000_000  # a key up to this length fits one window partition
    percentile_rows: int = 100_000  # a key up to this length fits one in-memory value map
    block_rows: int = 500_000  # rows per block when a long key is cut

    @property
    def broadcastable(self) -> bool:
        return self.keys <= self.broadcast_rows

    @property
    def short_series(self) -> bool:
        return self.largest <= self.series_rows

    @property
    def short_percentile(self) -> bool:
        return self.largest <= self.percentile_rows

    def may_broadcast(self, table: DataFrame) -> bool:
        """Whether a table with at most a row per key is small enough, in rows and in bytes."""
        return self.broadcastable and self.keys * row_bytes(table.schema) <= self.broadcast_bytes


def row_bytes(kind: T.DataType) -> int:
    """About how many bytes a value takes: text as 32, a list as 16 of its elements."""
    if isinstance(kind, T.StructType):
        return sum(row_bytes(field.dataType) for field in kind.fields)
    if isinstance(kind, T.ArrayType):
        return 16 * row_bytes(kind.elementType)
    if isinstance(kind, T.MapType):
        return 16 * (row_bytes(kind.keyType) + row_bytes(kind.valueType))
    return 32 if isinstance(kind, (T.StringType, T.BinaryType)) else 8


def measure(df: DataFrame, keys: Sequence[str]) -> Scale:
    """Count the keys, the rows and the rows of the longest key of `df`."""
    totals = (
        df.groupBy(*keys)
        .agg(F.count("*").alias("n"))
        .agg(F.count("*").alias("keys"), F.max("n").alias("largest"), F.sum("n").alias("rows"))
        .first()
    )
    return Scale(totals["keys"], totals["largest"] or 0, totals["rows"] or 0)


def dealt_out(df: DataFrame, by: Sequence[str], groups: int, a_task: int = 256) -> DataFrame:
    """`df` shuffled `by` columns into at least the session's number of partitions, for groups that cost time, not bytes.

    Left to itself, adaptive execution merges partitions of few bytes, and a few tasks do all the work.  A
    grouping by the same columns needs no further shuffle.  Tasks get about `a_task` of the `groups` at most.
    """
    wanted = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(1, min(groups, max(wanted, -(-groups // a_task)))), *by)
