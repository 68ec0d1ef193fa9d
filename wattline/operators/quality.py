"""Finding and removing invalid and repeated readings.

The frames here are raw: one timestamp may hold any number of copies, so nothing may gather the copies
of a timestamp in one task.  Copies are counted by partial aggregation, ranks are cut before the
shuffle, and facts about a group are joined back with `attach_to_copies`.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.functions.columns import nan_to_null
from wattline.plans.attach import attach_to_copies
from wattline.plans.scale import Scale, measure
from wattline.plans.series import running, with_position
from wattline.schema import KEYS, TS, VALUE


def _missing(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType.typeName()
    return F.col(name).isNull() | F.isnan(name) if kind in ("double", "float") else F.col(name).isNull()


def _any(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def detect_invalid(
    df: DataFrame, keys: Sequence[str] = KEYS, ts: str = TS, value: str = VALUE, min_value: float = 0
) -> DataFrame:
    """Rows with a missing key, timestamp or value, or with a value below `min_value`."""
    missing = _any(_missing(df, c) for c in [*keys, ts, value])
    return df.filter(missing | (F.col(value) < min_value))


def drop_invalid(
    df: DataFrame,
    null_cols: Sequence[str] | None = None,
    min_value: float | None = 0,
    keys: Sequence[str] = KEYS,
    ts: str = TS,
    value: str = VALUE,
) -> DataFrame:
    """Rows with every one of `null_cols` (default: key, timestamp, value) set and a valid value."""
    checked = [*keys, ts, value] if null_cols is None else list(null_cols)
    kept = df.filter(~_any(_missing(df, c) for c in checked)) if checked else df
    return kept if min_value is None else kept.filter(F.col(value) >= min_value)


def missing_count(df: DataFrame) -> DataFrame:
    """One row: missing cells per column (`missing_<column>`) and in total."""
    counts = df.agg(*[F.count_if(_missing(df, c)).alias("missing_" + c) for c in df.columns])
    return counts.withColumn("missing_total", sum(F.col("missing_" + c) for c in df.columns))


def negative_count(df: DataFrame, value: str = VALUE) -> DataFrame:
    """One row: number of values below zero."""
    return df.agg(F.count_if(F.col(value) < 0).alias("negative_count"))


def duplicate_keys(df: DataFrame, keys: Sequence[str] = KEYS, ts: str = TS) -> DataFrame:
    """Repeated (key, timestamp) pairs with their number of rows; a NULL key is not reported."""
    return (
        df.groupBy(*keys, ts)
        .agg(F.count("*").alias("copies"))
        .filter((F.col("copies") > 1) & F.col(keys[0]).isNotNull())
    )


def _repeated(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, Scale]:
    groups = df.groupBy(*by).agg(F.count("*").alias("copies")).filter("copies > 1")
    size = groups.agg(F.count("*"), F.max("copies"), F.sum("copies")).first()
    return groups, Scale(size[0], size[1] or 0, size[2] or 0)


def duplicate_rows_join(
    df: DataFrame, keys: Sequence[str] = KEYS, ts: str = TS, scale: Scale | None = None
) -> DataFrame:
    """Full rows of repeated (key, timestamp) pairs; NULLs never match, as in an equality join."""
    groups, size = _repeated(df, [*keys, ts])
    return attach_to_copies(df, groups.drop("copies"), [*keys, ts], scale or size)


def duplicate_rows(
    df: DataFrame, keys: Sequence[str] = KEYS, ts: str = TS, scale: Scale | None = None
) -> DataFrame:
    """Full rows of repeated (key, timestamp) pairs with the number of copies; NULL equals NULL."""
    groups, size = _repeated(df, [*keys, ts])
    return attach_to_copies(df, groups, [*keys, ts], scale or size, null_safe=True)


def dedup(
    df: DataFrame,
    order_by: Sequence[str],
    keep: str = "first",
    keys: Sequence[str] = KEYS,
    ts: str = TS,
) -> DataFrame:
    """One row per (key, timestamp).

    `keep='first'` keeps the first in `order_by`: the rank limit is applied on each side of the
    shuffle, so many copies of one timestamp shrink to one row per input partition.  `keep='none'`
    keeps only timestamps that have a single row.
    """
    if keep == "first":
        place = F.row_number().over(Window.partitionBy(*keys, ts).orderBy(*order_by))
        return df.withColumn("_place", place).filter("_place = 1").drop("_place")
    if keep != "none":
        raise ValueError("keep must be 'first' or 'none'")
    rest = [c for c in df.columns if c not in (*keys, ts)]
    # a group of one row has that row as its minimum
    single = df.groupBy(*keys, ts).agg(F.count("*").alias("_n"), F.min(F.struct(*rest)).alias("_row"))
    return single.filter("_n = 1").select(*keys, ts, "_row.*").select(*df.columns)


def quality_report(
    df: DataFrame, keys: Sequence[str] = KEYS, ts: str = TS, value: str = VALUE
) -> DataFrame:
    """One row: rows in, missing cells, rows in repeated pairs, negative rows, rows after `clean`."""
    columns = [*keys, ts, value]
    missing = [_missing(df, c) for c in columns]
    valid = ~_any(missing) & (F.col(value) >= 0)
    groups = df.groupBy(*keys, ts).agg(
        F.count("*").alias("n"),
        sum(F.count_if(m) for m in missing).alias("missing"),
        F.count_if(F.col(value) < 0).alias("negative"),
        F.count_if(valid).alias("valid"),
    )
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_in"),
        F.coalesce(F.sum("missing"), F.lit(0)).alias("missing_cells"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_rows"),
        F.coalesce(F.sum("negative"), F.lit(0)).alias("negative_rows"),
        F.count_if(F.col("valid") > 0).alias("rows_out"),
    )


def forward_fill(
    df: DataFrame,
    limit: int | None = None,
    keys: Sequence[str] = KEYS,
    ts: str = TS,
    value: str = VALUE,
    scale: Scale | None = None,
) -> DataFrame:
    """Missing values replaced by the last known one of the key, at most `limit` rows onwards."""
    scale = scale or measure(df, keys)
    known = df.withColumn(value, nan_to_null(value))
    last = ("last", F.col(value))
    if limit is None:
        return running(known, {"_last": last}, keys, [ts], scale=scale).withColumn(value, F.col("_last")).drop("_last")
    placed = with_position(known, keys, ts, "_pos", scale)
    seen = ("max", F.when(F.col(value).isNotNull(), F.col("_pos")))
    filled = running(placed, {"_last": last, "_seen": seen}, keys, [ts], scale=scale)
    near = F.col("_pos") - F.col("_seen") <= limit
    return filled.withColumn(value, F.when(near, F.col("_last"))).drop("_last", "_seen", "_pos")


def clean(
    df: DataFrame,
    order_by: Sequence[str],
    keys: Sequence[str] = KEYS,
    ts: str = TS,
    value: str = VALUE,
) -> DataFrame:
    """Invalid rows out first, then one row per (key, timestamp): a bad copy never hides a good one."""
    return dedup(drop_invalid(df, keys=keys, ts=ts, value=value), order_by, keys=keys, ts=ts)


def filter_values(df: DataFrame, col: str, values: object) -> DataFrame:
    """Rows whose column equals `values`, or one of them if it is a list; `None` keeps all rows."""
    if values is None:
        return df
    wanted = list(values) if isinstance(values, (list, tuple, set)) else [values]
    return df.filter(F.col(col).isin(wanted))


def select_keys(df: DataFrame, key_values: Sequence[object] | None = None, key: str = KEYS[0]) -> DataFrame:
    """Rows of the chosen keys, `None` for all."""
    return filter_values(df, key, None if key_values is None else list(key_values))


def sort_readings(df: DataFrame, keys: Sequence[str] = KEYS, ts: str = TS) -> DataFrame:
    """Global order for a sink; no operator needs it."""
    return df.orderBy(*keys, ts)


def head(df: DataFrame, n: int, keys: Sequence[str] = KEYS, ts: str = TS) -> DataFrame:
    """First `n` rows by key and time."""
    return df.orderBy(*keys, ts).limit(n)


def distinct_keys(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return df.select(*keys).distinct()
