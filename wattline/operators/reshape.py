"""Columns to rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from wattline.schema import KEYS


def strategy_long(
    df: DataFrame,
    cols: Sequence[str],
    ids: Sequence[str] = KEYS,
    name: str = "strategy",
    value_name: str = "value",
) -> DataFrame:
    """One row per id and column of `cols`: the column's name and its value."""
    return df.unpivot(list(ids), list(cols), name, value_name)
