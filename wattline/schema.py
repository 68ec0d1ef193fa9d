"""Names and types shared by every operator.

A *readings* frame has one row per key and timestamp.  The key is one or more columns (a meter, a
site and a meter, ...), the timestamp has no time zone, the value is a power in kW.
"""

from __future__ import annotations

from pyspark.sql import types as T

KEYS = ("meter_id",)
TS = "ts"
VALUE = "power_kw"

READINGS = T.StructType(
    [
        T.StructField("meter_id", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("power_kw", T.DoubleType()),
    ]
)
