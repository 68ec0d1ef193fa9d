"""Calendar and energy columns of a reading."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.functions.columns import TARIFF_BANDS, day_type_label, iso_weekday, tariff_label
from wattline.schema import TS, VALUE


def add_calendar(df: DataFrame, ts: str = TS) -> DataFrame:
    """Hour, day of month, weekday (0 = Monday), day type, ISO week and weekend flag."""
    return df.withColumns(
        {
            "hour": F.hour(ts),
            "day": F.day(ts),
            "weekday": iso_weekday(ts) - 1,
            "day_type": day_type_label(ts),
            "iso_week": F.weekofyear(ts),
            "is_weekend": iso_weekday(ts) > 5,
        }
    )


def add_energy(df: DataFrame, dt_hours: float = 1.0, value: str = VALUE) -> DataFrame:
    """Energy of a reading that stands for `dt_hours` hours."""
    return df.withColumn("energy_kwh", F.col(value) * F.lit(float(dt_hours)))


def tariff_period(
    df: DataFrame,
    bands: Sequence[tuple[str, int, int]] = TARIFF_BANDS,
    other: str = "out",
    ts: str = TS,
) -> DataFrame:
    """Adds the tariff period of the reading's hour."""
    return df.withColumn("period", tariff_label(F.hour(ts), bands, other))
