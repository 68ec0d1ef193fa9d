"""NaN counts as missing: one rule for every operator on readings."""

from __future__ import annotations

import functools
import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from wattline.functions.columns import nan_to_null


def without_nan(df: DataFrame, *columns: str) -> DataFrame:
    """`df` with NaN as NULL in those of `columns` that it has as floating-point numbers."""
    kinds = {f.name: f.dataType for f in df.schema}
    spoiled = [c for c in dict.fromkeys(columns) if isinstance(kinds.get(c), (T.DoubleType, T.FloatType))]
    return df.withColumns({c: nan_to_null(c) for c in spoiled}) if spoiled else df


def nan_is_missing(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator that reads NaN in its `value`, `x`, `y` or `col` column as NULL; it costs one projection."""
    signature = inspect.signature(operator)
    first = next(iter(signature.parameters))

    @functools.wraps(operator)
    def run(*args, **kwargs) -> DataFrame:
        bound = signature.bind(*args, **kwargs)
        bound.apply_defaults()
        names = [bound.arguments[p] for p in ("value", "x", "y", "col") if isinstance(bound.arguments.get(p), str)]
        bound.arguments[first] = without_nan(bound.arguments[first], *names)
        return operator(*bound.args, **bound.kwargs)

    return run
