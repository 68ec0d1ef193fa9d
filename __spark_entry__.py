"""

Meters are the event types of `events` (long, dense series with gaps), its users (`*_by_user`) or the
suppliers of `lineitem` (`*_by_supplier`: many series).  Every query covers whole tables.

Both sides round derived numbers in the same way (`_shaped` here, `_rounded` in SQL): six places after
adding 1e-9, which keeps exact ties from falling differently in the two engines.
"""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wattline.functions.columns import (  # noqa: E402
    day_type_label,
    iso_weekday,
    rolling_week_block,
    status_label,
)
from wattline.operators import (  # noqa: E402
    anomalies,
    autocorrelation,
    calendar,
    covariate,
    distribution,
    dsm,
    energy,
    isolation,
    models,
    peaks,
    profiles,
    quality,
    reshape,
    rolling,
)
from wattline.session import shared_dir, stage  # noqa: E402
from wattline.sources import tables  # noqa: E402
from wattline.streaming import monitor  # noqa: E402

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _shaped(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT, doubles rounded: the form the SQL side returns."""
    columns = []
    for field in df.schema:
        column = F.col(field.name)
        if isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            column = column.cast("bigint")
        elif isinstance(field.dataType, T.DoubleType):
            column = F.round(column + 1e-9, 6) + F.lit(0.0)
        columns.append(column.alias(field.name))
    return df.select(*columns)


def _rounded(body: str, doubles: str, bigints: str = "") -> str:
    parts = [f"round({c} + 1e-9, 6) + 0e0 AS {c}" for c in doubles.split()]
    parts += [f"CAST({c} AS BIGINT) AS {c}" for c in bigints.split()]
    return f"SELECT * REPLACE ({', '.join(parts)}) FROM ({body}) AS result" if parts else body


def _register(name: str, query: Query, sql: str | None = None, doubles: str = "", bigints: str = "") -> None:
    _QUERIES[name] = lambda spark, sf: _shaped(query(spark, sf))
    if sql is not None:
        _SQL[name] = _rounded(sql, doubles, bigints)


# --- inputs ---------------------------------------------------------------------------------------


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "events")


def _readings(spark: SparkSession, sf: str) -> DataFrame:
    return tables.hourly_readings(_events(spark, sf), "event_type")


def _user_readings(spark: SparkSession, sf: str) -> DataFrame:
    return tables.hourly_readings(_events(spark, sf), "user_id")


def _supplier_readings(spark: SparkSession, sf: str) -> DataFrame:
    return tables.hourly_readings(_table(spark, sf, "lineitem"), "l_suppkey", "l_shipdate", "l_quantity")


_STORED: dict[tuple[str, str, str], DataFrame] = {}


def _stored(source: Query) -> Query:
    """The source written once per session as a Parquet table and shared by the queries that make
    several passes over it: the raw table is rolled up to hours once, later scans are pruned."""

    def read(spark: SparkSession, sf: str) -> DataFrame:
        name = (spark.sparkContext.applicationId, sf, source.__name__)
        if name not in _STORED:
            _STORED[name] = stage(source(spark, sf), source.__name__.strip("_"))
        return _STORED[name]

    return read


def _readings_sql(table: str, key: str, ts: str, value: str) -> str:
    return (
        f"SELECT {key} AS meter_id, date_trunc('hour', {ts}) AS ts, "
        f"CAST(SUM(CAST({value} AS DECIMAL(18,2))) AS DOUBLE) AS power_kw FROM {table} GROUP BY 1, 2"
    )


READINGS = "WITH readings AS (" + _readings_sql("events", "event_type", "ts", "value") + ")"
USER_READINGS = "WITH readings AS (" + _readings_sql("events", "user_id", "ts", "value") + ")"
SUPPLIER_READINGS = (
    "WITH readings AS (" + _readings_sql("lineitem", "l_suppkey", "l_shipdate", "l_quantity") + ")"
)


def _dirty(spark: SparkSession, sf: str) -> DataFrame:
    """All events as raw readings, spoiled by rule: some fields missing, some values negative, some
    rows there three times with different values."""
    e = F.col("event_id")
    copies = F.when(e % 53 == 0, F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0)))
    copy = F.col("copy")
    return (
        _events(spark, sf)
        .withColumn("copy", F.explode(copies))
        .select(
            F.when(e % 211 != 0, F.col("event_type")).alias("meter_id"),
            F.when(e % 223 != 0, F.col("ts")).alias("ts"),
            F.when((e + copy) % 97 == 0, F.lit(None))
            .when((e + copy) % 89 == 0, -F.col("value"))
            .otherwise(F.col("value") + copy)
            .alias("power_kw"),
            "event_id",
            "copy",
        )
    )


DIRTY = """WITH dirty AS (
  SELECT CASE WHEN event_id % 211 <> 0 THEN event_type END AS meter_id,
         CASE WHEN event_id % 223 <> 0 THEN ts END AS ts,
         CASE WHEN (event_id + copy) % 97 = 0 THEN NULL WHEN (event_id + copy) % 89 = 0 THEN -value
              ELSE value + copy END AS power_kw,
         event_id, CAST(copy AS BIGINT) AS copy
  FROM events, (VALUES (0), (1), (2)) AS c(copy) WHERE copy = 0 OR event_id % 53 = 0)"""


def _gapped(spark: SparkSession, sf: str) -> DataFrame:
    readings = _stored(_readings)(spark, sf)
    return tables.calendar_spine(readings).join(readings, ["meter_id", "ts"], "left")


GAPPED = (
    READINGS
    + """, hours AS (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM readings),
 gapped AS (SELECT k.meter_id, h.ts, r.power_kw FROM (SELECT DISTINCT meter_id FROM readings) k
   CROSS JOIN hours h LEFT JOIN readings r ON r.meter_id = k.meter_id AND r.ts = h.ts)"""
)


def _fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- sources and sinks ----------------------------------------------------------------------------


def _csv_copy(spark: SparkSession, sf: str) -> str:
    """The readings as the CSV export this library reads: ';', decimal commas, padded headers."""
    path = _fresh_dir(spark, "csv")
    comma = F.replace(F.col("power_kw").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(","))
    _readings(spark, sf).select(
        F.col("meter_id").alias(" meter_id"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp "),
        comma.alias(" power_kw "),
    ).write.options(header=True, sep=";").csv(path)
    return path


def _written(spark: SparkSession, sf: str) -> DataFrame:
    path = _fresh_dir(spark, "readings")
    tables.write_readings(_readings(spark, sf), path)
    return tables.read_readings_table(spark, path, ["meter_id", "ts", "power_kw"])


def _reported(spark: SparkSession, sf: str) -> DataFrame:
    path = _fresh_dir(spark, "report")
    readings = _readings(spark, sf)
    tables.write_report({"daily": profiles.daily_profile(readings)}, path)
    return tables.read_readings_table(spark, f"{path}/daily")


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    bad = F.col("event_id") % 101 == 0
    number = F.replace(F.col("value").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(","))
    return _events(spark, sf).select(
        "event_id",
        F.when(bad, "abc").otherwise(number).alias("power_kw"),
        F.when(bad, "abc").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("ts"),
    )


DAILY = """SELECT meter_id, CAST(ts AS DATE) AS date, avg(power_kw) AS mean_kw, max(power_kw) AS max_kw,
  stddev_samp(power_kw) AS stddev_kw, stddev_samp(power_kw) / nullif(avg(power_kw), 0) AS cv,
  min(power_kw) AS min_kw FROM readings GROUP BY 1, 2"""
SPREAD = "mean_kw max_kw stddev_kw cv min_kw"

_register(
    "read_readings_csv",
    lambda s, d: tables.load_readings_csv(s, _csv_copy(s, d)),
    f"{READINGS} SELECT * FROM readings",
    "power_kw",
)
_register(
    "normalise_headers",
    lambda s, d: tables.normalise_headers(
        _readings(s, d).toDF(" meter_id", "ts ", " power_kw ")
    ),
    f"{READINGS} SELECT * FROM readings",
    "power_kw",
)
_register(
    "parse_decimal_comma",
    lambda s, d: tables.parse_decimal_comma(_texts(s, d)).drop("ts"),
    "SELECT event_id, CASE WHEN event_id % 101 <> 0 THEN value END AS power_kw FROM events",
    "power_kw",
)
_register(
    "parse_timestamp",
    lambda s, d: tables.parse_timestamp(_texts(s, d), strict=False).drop("power_kw"),
    "SELECT event_id, CASE WHEN event_id % 101 <> 0 THEN date_trunc('second', ts) END AS ts FROM events",
)
_register(
    "read_readings_table",
    lambda s, d: tables.read_readings_table(s, f"{d}/events.parquet", ["event_id", "event_type", "ts", "value"]),
    "SELECT event_id, event_type, ts, value FROM events",
    "value",
)
_register("write_readings", _written, f"{READINGS} SELECT * FROM readings", "power_kw")
_register("write_report", _reported, f"{READINGS} {DAILY}", SPREAD)
_register("hourly_readings", _readings, f"{READINGS} SELECT * FROM readings", "power_kw")
for _agg in ("avg", "min", "max"):
    _register(
        f"hourly_readings_{_agg}",
        lambda s, d, agg=_agg: tables.hourly_readings(_events(s, d), "event_type", agg=agg),
        f"""SELECT event_type AS meter_id, date_trunc('hour', ts) AS ts, {_agg}(value) AS power_kw
            FROM events GROUP BY 1, 2""",
        "power_kw",
    )
_register(
    "hourly_readings_net",  # values with more than two places
    lambda s, d: tables.hourly_readings(
        _table(s, d, "lineitem").withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount"))),
        "l_suppkey", "l_shipdate", "net",
    ),
    """SELECT l_suppkey AS meter_id, date_trunc('hour', l_shipdate) AS ts,
         CAST(SUM(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(28,9))) AS DOUBLE) AS power_kw
       FROM lineitem GROUP BY 1, 2""",
    "power_kw",
)
_register(
    "zscore_with_nan",  # NaN is missing: the scores are those of the rows without it
    lambda s, d: anomalies.zscore(
        _readings(s, d).withColumn(
            "power_kw", F.when(F.hour("ts") == 7, F.lit(float("nan"))).otherwise(F.col("power_kw"))
        )
    ),
    f"""{READINGS}, spoiled AS (SELECT meter_id, ts, CASE WHEN hour(ts) <> 7 THEN power_kw END AS power_kw FROM readings),
      stats AS (SELECT meter_id, quantile_cont(power_kw, 0.95) AS p95, avg(power_kw) AS mean,
        stddev_samp(power_kw) AS stddev FROM spoiled GROUP BY 1)
      SELECT meter_id, ts, power_kw, p95, mean, stddev, (power_kw - mean) / nullif(stddev, 0) AS z_score
      FROM spoiled JOIN stats USING (meter_id) WHERE abs((power_kw - mean) / nullif(stddev, 0)) > 2""",
    "power_kw p95 mean stddev z_score",
)
_register("hourly_readings_by_user", _user_readings, f"{USER_READINGS} SELECT * FROM readings", "power_kw")
_register("calendar_spine", _gapped, f"{GAPPED} SELECT * FROM gapped", "power_kw")

# --- data quality ---------------------------------------------------------------------------------

INVALID = "meter_id IS NULL OR ts IS NULL OR power_kw IS NULL OR power_kw < 0"
REPEATED = "SELECT meter_id, ts, count(*) AS copies FROM dirty GROUP BY 1, 2 HAVING count(*) > 1"
CLEANED = f"""SELECT meter_id, ts, power_kw, event_id, copy FROM (
  SELECT *, row_number() OVER (PARTITION BY meter_id, ts ORDER BY copy, event_id) AS place
  FROM dirty WHERE NOT ({INVALID})) WHERE place = 1"""

_register(
    "detect_invalid",
    lambda s, d: quality.detect_invalid(_dirty(s, d)),
    f"{DIRTY} SELECT * FROM dirty WHERE {INVALID}",
    "power_kw",
)
_register(
    "drop_invalid",
    lambda s, d: quality.drop_invalid(_dirty(s, d)),
    f"{DIRTY} SELECT * FROM dirty WHERE NOT ({INVALID})",
    "power_kw",
)
_register(
    "missing_count",
    lambda s, d: quality.missing_count(_dirty(s, d)),
    f"""{DIRTY} SELECT count(*) FILTER (meter_id IS NULL) AS missing_meter_id,
      count(*) FILTER (ts IS NULL) AS missing_ts, count(*) FILTER (power_kw IS NULL) AS missing_power_kw,
      count(*) FILTER (event_id IS NULL) AS missing_event_id, count(*) FILTER (copy IS NULL) AS missing_copy,
      missing_meter_id + missing_ts + missing_power_kw + missing_event_id + missing_copy AS missing_total
      FROM dirty""",
    bigints="missing_total",
)
_register(
    "negative_count",
    lambda s, d: quality.negative_count(_dirty(s, d)),
    f"{DIRTY} SELECT count(*) AS negative_count FROM dirty WHERE power_kw < 0",
)
_register(
    "duplicate_keys",
    lambda s, d: quality.duplicate_keys(_dirty(s, d)),
    f"{DIRTY} SELECT * FROM ({REPEATED}) WHERE meter_id IS NOT NULL",
)
_register(
    "duplicate_rows_join",
    lambda s, d: quality.duplicate_rows_join(_dirty(s, d)),
    f"""{DIRTY} SELECT r.* FROM dirty r
      JOIN ({REPEATED}) g ON r.meter_id = g.meter_id AND r.ts = g.ts""",
    "power_kw",
)
_register(
    "duplicate_rows",
    lambda s, d: quality.duplicate_rows(_dirty(s, d)),
    f"""{DIRTY} SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY meter_id, ts) AS copies FROM dirty)
      WHERE copies > 1""",
    "power_kw",
)
_register(
    "dedup",
    lambda s, d: quality.dedup(_dirty(s, d), ["copy", "event_id"]),
    f"""{DIRTY} SELECT meter_id, ts, power_kw, event_id, copy FROM (SELECT *, row_number() OVER (
      PARTITION BY meter_id, ts ORDER BY copy, event_id) AS place FROM dirty) WHERE place = 1""",
    "power_kw",
)
_register(
    "dedup_none",
    lambda s, d: quality.dedup(_dirty(s, d), ["copy"], keep="none"),
    f"""{DIRTY} SELECT meter_id, ts, power_kw, event_id, copy FROM (SELECT *, count(*) OVER (
      PARTITION BY meter_id, ts) AS n FROM dirty) WHERE n = 1""",
    "power_kw",
)
_register(
    "quality_report",
    lambda s, d: quality.quality_report(_dirty(s, d)),
    f"""{DIRTY} SELECT count(*) AS rows_in,
      count(*) FILTER (meter_id IS NULL) + count(*) FILTER (ts IS NULL) + count(*) FILTER (power_kw IS NULL)
        AS missing_cells,
      (SELECT CAST(sum(copies) AS BIGINT) FROM ({REPEATED})) AS duplicate_rows,
      count(*) FILTER (power_kw < 0) AS negative_rows,
      (SELECT count(*) FROM (SELECT DISTINCT meter_id, ts FROM dirty WHERE NOT ({INVALID}))) AS rows_out
      FROM dirty""",
    bigints="missing_cells",
)
_register(
    "forward_fill",
    lambda s, d: quality.forward_fill(_gapped(s, d)),
    f"""{GAPPED} SELECT meter_id, ts, last_value(power_kw IGNORE NULLS) OVER (
      PARTITION BY meter_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS power_kw FROM gapped""",
    "power_kw",
)
_register(
    "forward_fill_limit",
    lambda s, d: quality.forward_fill(_gapped(s, d), limit=1),
    f"""{GAPPED} SELECT meter_id, ts, last_value(power_kw IGNORE NULLS) OVER (
      PARTITION BY meter_id ORDER BY ts ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS power_kw FROM gapped""",
    "power_kw",
)
_register(
    "clean", lambda s, d: quality.clean(_dirty(s, d), ["copy", "event_id"]), f"{DIRTY} {CLEANED}", "power_kw"
)
_register(
    "filter_values",
    lambda s, d: quality.filter_values(
        _readings(s, d).withColumn("day_type", day_type_label("ts")), "day_type", ["weekend"]
    ),
    f"{READINGS} SELECT *, 'weekend' AS day_type FROM readings WHERE isodow(ts) > 5",
    "power_kw",
)
_register(
    "select_keys",
    lambda s, d: quality.select_keys(_readings(s, d), ["click", "view"]),
    f"{READINGS} SELECT * FROM readings WHERE meter_id IN ('click', 'view')",
    "power_kw",
)
_register(
    "sort_readings",
    lambda s, d: quality.sort_readings(_readings(s, d)),
    f"{READINGS} SELECT * FROM readings ORDER BY meter_id, ts",
    "power_kw",
)
_register(
    "head",
    lambda s, d: quality.head(_readings(s, d), 10),
    f"{READINGS} SELECT * FROM readings ORDER BY meter_id, ts LIMIT 10",
    "power_kw",
)
_register(
    "distinct_keys",
    lambda s, d: quality.distinct_keys(_readings(s, d)),
    f"{READINGS} SELECT DISTINCT meter_id FROM readings",
)

# --- calendar and labels --------------------------------------------------------------------------

DAY_TYPE = "CASE WHEN isodow(ts) <= 5 THEN 'weekday' ELSE 'weekend' END"
PERIOD = """CASE WHEN hour(ts) BETWEEN 0 AND 5 THEN 'off_peak' WHEN hour(ts) BETWEEN 9 AND 11 THEN 'critical'
  WHEN hour(ts) BETWEEN 6 AND 23 THEN 'full' ELSE 'out' END"""

_register(
    "add_calendar",
    lambda s, d: calendar.add_calendar(_readings(s, d)),
    f"""{READINGS} SELECT *, hour(ts) AS hour, day(ts) AS day, isodow(ts) - 1 AS weekday,
      {DAY_TYPE} AS day_type, weekofyear(ts) AS iso_week, isodow(ts) > 5 AS is_weekend FROM readings""",
    "power_kw",
)
_register(
    "add_energy",
    lambda s, d: calendar.add_energy(_readings(s, d), 0.5),
    f"{READINGS} SELECT *, power_kw * 0.5e0 AS energy_kwh FROM readings",
    "power_kw energy_kwh",
)
_register(
    "iso_weekday",
    lambda s, d: _table(s, d, "orders").select("o_orderkey", iso_weekday("o_orderdate").alias("weekday")),
    "SELECT o_orderkey, isodow(o_orderdate) AS weekday FROM orders",
)
_register(
    "rolling_week_block",
    lambda s, d: _table(s, d, "orders").select(
        "o_orderkey", rolling_week_block("o_orderdate", "1997-01-01").alias("block")
    ),
    """SELECT o_orderkey, CAST(DATE '1997-01-01' + CAST(floor(date_diff('day', DATE '1997-01-01',
      CAST(o_orderdate AS DATE)) / 7e0) AS INTEGER) * 7 AS DATE) AS block FROM orders""",
)
_register(
    "tariff_period",
    lambda s, d: calendar.tariff_period(_readings(s, d)),
    f"{READINGS} SELECT *, {PERIOD} AS period FROM readings",
    "power_kw",
)
_register(
    "day_type_label",
    lambda s, d: _table(s, d, "orders").select("o_orderkey", day_type_label("o_orderdate").alias("day_type")),
    """SELECT o_orderkey, CASE WHEN isodow(o_orderdate) <= 5 THEN 'weekday' ELSE 'weekend' END AS day_type
      FROM orders""",
)
_register(
    "status_label",
    lambda s, d: _dirty(s, d).select(
        "event_id", "copy", status_label("power_kw", 150, "high", "normal").alias("status")
    ),
    f"{DIRTY} SELECT event_id, copy, CASE WHEN power_kw > 150 THEN 'high' ELSE 'normal' END AS status FROM dirty",
)

# --- profiles -------------------------------------------------------------------------------------

STABILITY = """avg(power_kw) AS mean_kw, max(power_kw) AS max_kw, stddev_samp(power_kw) AS stddev_kw,
  stddev_samp(power_kw) / nullif(avg(power_kw), 0) AS cv, max(power_kw) / nullif(avg(power_kw), 0) AS peak_factor"""
STABLE = "mean_kw max_kw stddev_kw cv peak_factor"
WEEKLY = """SELECT meter_id, isoyear(ts) AS iso_year, weekofyear(ts) AS iso_week, sum(power_kw) AS energy_kwh
  FROM readings GROUP BY 1, 2, 3"""
DAILY_ENERGY = "SELECT meter_id, CAST(ts AS DATE) AS date, sum(power_kw) AS energy_kwh FROM readings GROUP BY 1, 2"


def _each(prefixes: str) -> list[tuple[str, Callable, str]]:
    known = {
        "": (_readings, READINGS),
        "_by_user": (_user_readings, USER_READINGS),
        "_by_supplier": (_supplier_readings, SUPPLIER_READINGS),
    }
    return [(p, *known[p]) for p in ["", *prefixes.split()]]


def _per_source(
    name: str, operator: Callable, sql: str, doubles: str, more: str = "", once: bool = False
) -> None:
    """The same operator and SQL over the event-type readings and the sources named in `more`.

    Operators that read their input `once` start from the raw table, the others from stored readings.
    """
    for suffix, source, ctes in _each(more):
        source = source if once else _stored(source)
        _register(
            name + suffix,
            lambda s, d, source=source: operator(source(s, d)),
            f"{ctes} {sql}" if not sql.startswith(",") else f"{ctes}{sql}",
            doubles,
        )


_per_source("daily_profile", profiles.daily_profile, DAILY, SPREAD, "_by_user _by_supplier", once=True)
_per_source(
    "hourly_profile",
    profiles.hourly_profile,
    DAILY.replace("CAST(ts AS DATE) AS date", "hour(ts) AS hour"),
    SPREAD,
    "_by_user",
    once=True,
)
_per_source("daily_energy", profiles.daily_energy, DAILY_ENERGY, "energy_kwh", "_by_supplier", once=True)
_per_source("weekly_energy", profiles.weekly_energy, WEEKLY, "energy_kwh", "_by_supplier", once=True)
_per_source(
    "stability_summary",
    profiles.stability_summary,
    f"SELECT meter_id, {STABILITY} FROM readings GROUP BY 1",
    STABLE,
    "_by_user _by_supplier",
    once=True,
)
_per_source(
    "contract_exceedance",
    profiles.contract_exceedance,
    """, limits AS (SELECT meter_id, quantile_cont(power_kw, 0.99) AS p99 FROM readings GROUP BY 1)
      SELECT meter_id, p99, count(*) AS exceedances FROM readings JOIN limits USING (meter_id)
      WHERE power_kw > p99 GROUP BY 1, 2""",
    "p99",
    "_by_user _by_supplier",
)
_per_source(
    "contract_power",
    profiles.contract_power,
    """SELECT meter_id, quantile_cont(power_kw, 0.99) AS p99,
      1.03e0 * quantile_cont(power_kw, 0.99) AS contract_kw FROM readings GROUP BY 1""",
    "p99 contract_kw",
)
_per_source(
    "week_weekend_mean",
    profiles.week_weekend_mean,
    """SELECT meter_id, avg(power_kw) FILTER (isodow(ts) <= 5) AS weekday_mean_kw,
      avg(power_kw) FILTER (isodow(ts) > 5) AS weekend_mean_kw FROM readings GROUP BY 1""",
    "weekday_mean_kw weekend_mean_kw",
    once=True,
)
_per_source(
    "week_weekend_mean_rows",
    profiles.week_weekend_mean_rows,
    f"SELECT meter_id, {DAY_TYPE} AS day_type, avg(power_kw) AS mean_kw FROM readings GROUP BY 1, 2",
    "mean_kw",
    once=True,
)
_per_source(
    "week_weekend_stability",
    profiles.week_weekend_stability,
    f"SELECT meter_id, {DAY_TYPE} AS day_type, {STABILITY} FROM readings GROUP BY 1, 2",
    STABLE,
    "_by_user",
    once=True,
)
_per_source(
    "week_weekend_energy_rows",
    profiles.week_weekend_energy_rows,
    f"SELECT meter_id, {DAY_TYPE} AS day_type, sum(power_kw) AS energy_kwh FROM readings GROUP BY 1, 2",
    "energy_kwh",
    once=True,
)
_per_source(
    "week_weekend_energy",
    profiles.week_weekend_energy,
    """SELECT meter_id, sum(power_kw) FILTER (isodow(ts) <= 5) AS weekday_kwh,
      sum(power_kw) FILTER (isodow(ts) > 5) AS weekend_kwh FROM readings GROUP BY 1""",
    "weekday_kwh weekend_kwh",
    once=True,
)
_per_source(
    "week_weekend_ratio",
    profiles.week_weekend_ratio,
    f""", days AS ({DAILY_ENERGY}), means AS (SELECT meter_id,
      avg(energy_kwh) FILTER (isodow(date) <= 5) AS weekday_mean_kwh,
      avg(energy_kwh) FILTER (isodow(date) > 5) AS weekend_mean_kwh FROM days GROUP BY 1)
      SELECT *, weekday_mean_kwh / nullif(weekend_mean_kwh, 0) AS ratio,
      CASE WHEN weekday_mean_kwh / nullif(weekend_mean_kwh, 0) > 1.1e0 THEN 'weekday dominant'
           ELSE 'similar' END AS status FROM means""",
    "weekday_mean_kwh weekend_mean_kwh ratio",
    "_by_user",
    once=True,
)
_per_source(
    "tariff_stability",
    profiles.tariff_stability,
    f"SELECT meter_id, {PERIOD} AS period, {STABILITY} FROM readings GROUP BY 1, 2",
    STABLE,
    "_by_user",
    once=True,
)
_per_source(
    "percentile_by_key",
    profiles.percentile_by_key,
    """SELECT meter_id, quantile_cont(power_kw, 0.5) AS p50, quantile_cont(power_kw, 0.95) AS p95,
      quantile_cont(power_kw, 0.99) AS p99 FROM readings GROUP BY 1""",
    "p50 p95 p99",
    "_by_user _by_supplier",
)
# the sketch holds its ranks exactly here: no key has more rows than its accuracy
_per_source(
    "percentile_sketch",
    lambda r: profiles.percentile_by_key(r, exact=False),
    """SELECT meter_id, quantile_disc(power_kw, 0.5) AS p50, quantile_disc(power_kw, 0.95) AS p95,
      quantile_disc(power_kw, 0.99) AS p99 FROM readings GROUP BY 1""",
    "p50 p95 p99",
)
_per_source(
    "contract_exceedance_all",
    lambda r: profiles.contract_exceedance(r, 0.9, include_zero=True),
    """, limits AS (SELECT meter_id, quantile_cont(power_kw, 0.9) AS p90 FROM readings GROUP BY 1)
      SELECT meter_id, p90, count(*) FILTER (power_kw > p90) AS exceedances FROM readings JOIN limits USING (meter_id) GROUP BY 1, 2""",
    "p90",
    "_by_supplier",
)
_per_source(
    "join_stats",
    lambda r: profiles.join_stats(r, profiles.stability_summary(r)),
    f"""SELECT r.*, s.* EXCLUDE (meter_id) FROM readings r
      JOIN (SELECT meter_id, {STABILITY} FROM readings GROUP BY 1) s USING (meter_id)""",
    f"power_kw {STABLE}",
    "_by_supplier",
)
_per_source(
    "group_transform",
    lambda r: profiles.group_transform(
        r, {"key_median": F.median("power_kw"), "key_rows": F.count("*"), "key_max": F.max("power_kw")}
    ),
    """SELECT *, median(power_kw) OVER w AS key_median, count(*) OVER w AS key_rows,
      max(power_kw) OVER w AS key_max FROM readings WINDOW w AS (PARTITION BY meter_id)""",
    "power_kw key_median key_max",
)

# --- energy over time -----------------------------------------------------------------------------

CHANGE = """SELECT *, lag(energy_kwh) OVER w AS previous_kwh,
  sum(energy_kwh) OVER (w ROWS UNBOUNDED PRECEDING) AS cumulative_kwh,
  energy_kwh - lag(energy_kwh) OVER w AS change_kwh,
  100e0 * (energy_kwh - lag(energy_kwh) OVER w) / nullif(lag(energy_kwh) OVER w, 0) AS change_pct"""
CHANGED = "energy_kwh previous_kwh cumulative_kwh change_kwh change_pct"
DAILY_CHANGE = f"{CHANGE} FROM ({DAILY_ENERGY}) WINDOW w AS (PARTITION BY meter_id ORDER BY date)"

_per_source("daily_energy_change", energy.daily_energy_change, DAILY_CHANGE, CHANGED, "_by_supplier", once=True)
_per_source(
    "weekly_energy_change",
    energy.weekly_energy_change,
    f"{CHANGE} FROM ({WEEKLY}) WINDOW w AS (PARTITION BY meter_id ORDER BY iso_year, iso_week)",
    CHANGED,
    "_by_supplier",
    once=True,
)
_per_source(
    "daily_change_status",
    energy.daily_change_status,
    f"""SELECT *, CASE WHEN abs(change_pct) > 20 THEN 'anomaly' ELSE 'normal' END AS status
      FROM ({DAILY_CHANGE})""",
    CHANGED,
    "_by_user",
    once=True,
)
_per_source(
    "cumulative_energy",
    energy.cumulative_energy,
    """SELECT *, power_kw AS energy_kwh, sum(power_kw) OVER (
      PARTITION BY meter_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS energy_cum_kwh FROM readings""",
    "power_kw energy_kwh energy_cum_kwh",
    "_by_user _by_supplier",
)

# --- peaks ----------------------------------------------------------------------------------------


def _ranked_sql(k: int, order: str, name: str) -> str:
    return f""", ranked AS (SELECT *, dense_rank() OVER (
      PARTITION BY meter_id, CAST(ts AS DATE) ORDER BY power_kw {order}) AS place FROM readings),
    days AS (SELECT meter_id, CAST(ts AS DATE) AS date, avg(power_kw) AS {name} FROM ranked
      WHERE place <= {k} GROUP BY 1, 2)
    SELECT *, rank() OVER (PARTITION BY meter_id ORDER BY {name} {order}) AS day_rank FROM days"""


HOURS = ", ".join(f"avg(power_kw) FILTER (hour(ts) = {h}) AS h{h:02d}" for h in range(24))

_per_source(
    "daily_peaks", peaks.daily_peaks, _ranked_sql(3, "DESC", "peak_mean_kw"), "peak_mean_kw", "_by_user"
)
_per_source(
    "daily_troughs", peaks.daily_troughs, _ranked_sql(6, "ASC", "trough_mean_kw"), "trough_mean_kw", "_by_user"
)
_per_source(
    "daily_extremes",
    peaks.daily_extremes,
    """SELECT DISTINCT meter_id, CAST(ts AS DATE) AS date,
      first(hour(ts)) OVER (w ORDER BY power_kw, ts) AS min_hour, min(power_kw) OVER w AS min_kw,
      first(hour(ts)) OVER (w ORDER BY power_kw DESC, ts) AS max_hour, max(power_kw) OVER w AS max_kw
      FROM readings WINDOW w AS (PARTITION BY meter_id, CAST(ts AS DATE))""",
    "min_kw max_kw",
    "_by_user",
    once=True,
)
_per_source(
    "day_hour_matrix",
    peaks.day_hour_matrix,
    f"SELECT meter_id, CAST(ts AS DATE) AS date, {HOURS} FROM readings GROUP BY 1, 2",
    " ".join(f"h{h:02d}" for h in range(24)),
    "_by_user",
    once=True,
)

# --- rolling --------------------------------------------------------------------------------------

WS = (3, 6, 12)


def _rolling_sql(prefix: str, expression: str, windows: tuple[int, ...] = WS) -> str:
    columns = ", ".join(
        f"CASE WHEN count(power_kw) OVER w{w} = {w} THEN {expression.format(w=f'w{w}')} END AS {prefix}_{w}"
        for w in windows
    )
    frames = ", ".join(
        f"w{w} AS (PARTITION BY meter_id ORDER BY ts ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
        for w in windows
    )
    return f"SELECT *, {columns} FROM readings WINDOW {frames}"


# two-pass deviation over the frame's values: a sliding update would lose digits
STD = """sqrt(greatest(list_var_samp(list(power_kw) OVER {w}), 0e0))"""
CV = STD + " / nullif(avg(power_kw) OVER {w}, 0)"

_per_source(
    "rolling_mean",
    rolling.rolling_mean,
    _rolling_sql("mean", "avg(power_kw) OVER {w}"),
    "power_kw mean_3 mean_6 mean_12",
    "_by_user _by_supplier",
)
_per_source(
    "rolling_std", rolling.rolling_std, _rolling_sql("std", STD), "power_kw std_3 std_6 std_12", "_by_user"
)
_per_source(
    "rolling_cv",
    rolling.rolling_cv,
    _rolling_sql("cv", CV),
    "power_kw cv_3 cv_6 cv_12",
    "_by_user _by_supplier",
)
_per_source(
    "shift",
    lambda r: rolling.shift(r, "power_kw", 24),
    "SELECT *, lag(power_kw, 24) OVER (PARTITION BY meter_id ORDER BY ts) AS power_kw_lag24 FROM readings",
    "power_kw power_kw_lag24",
    "_by_supplier",
)

# --- distribution and autocorrelation -------------------------------------------------------------

MOMENTS = """moments AS (SELECT r.meter_id, count(*) AS n, avg(power_kw) AS mean_kw,
    median(power_kw) AS median_kw, stddev_samp(power_kw) AS stddev_kw,
    CASE WHEN var_pop(power_kw) > 0 THEN avg(pow(power_kw - m, 3)) / pow(avg(pow(power_kw - m, 2)), 1.5e0) END
      AS skewness,
    CASE WHEN var_pop(power_kw) > 0 THEN avg(pow(power_kw - m, 4)) / pow(avg(pow(power_kw - m, 2)), 2) - 3 END
      AS kurtosis
  FROM readings r JOIN (SELECT meter_id, avg(power_kw) AS m FROM readings GROUP BY 1) USING (meter_id)
  GROUP BY 1)"""
BOUNDS = """bounds AS (SELECT meter_id, min(power_kw) AS lo, max(power_kw) AS hi, count(*) AS rows_of_key,
  avg(power_kw) AS m, stddev_samp(power_kw) AS sd FROM readings GROUP BY 1)"""

_per_source(
    "distribution_stats",
    distribution.distribution_stats,
    f", {MOMENTS} SELECT meter_id, mean_kw, median_kw, stddev_kw, skewness, kurtosis FROM moments",
    "mean_kw median_kw stddev_kw skewness kurtosis",
    "_by_supplier",
)
_per_source(
    "normality_jb",
    distribution.normality_jb,
    f""", {MOMENTS} SELECT meter_id, n, skewness, kurtosis,
      n / 6e0 * (skewness * skewness + kurtosis * kurtosis / 4) AS jb,
      exp(-(n / 6e0 * (skewness * skewness + kurtosis * kurtosis / 4)) / 2) AS p_value FROM moments""",
    "skewness kurtosis jb p_value",
    once=True,
)
_per_source(
    "histogram",
    distribution.histogram,
    f""", {BOUNDS}, placed AS (SELECT meter_id, CAST(least(coalesce(floor((power_kw - lo)
        / nullif((hi - lo) / 39, 0)), 0), 38) AS BIGINT) AS bin, count(*) AS n
      FROM readings JOIN bounds USING (meter_id) GROUP BY 1, 2)
      SELECT b.meter_id, g.bin, lo + g.bin * ((hi - lo) / 39) AS bin_start,
        lo + (g.bin + 1) * ((hi - lo) / 39) AS bin_end, coalesce(n, 0) AS n,
        coalesce(n, 0) / nullif(rows_of_key * ((hi - lo) / 39), 0) AS density
      FROM bounds b CROSS JOIN (SELECT unnest(range(39)) AS bin) g
      LEFT JOIN placed p ON p.meter_id = b.meter_id AND p.bin = g.bin""",
    "bin_start bin_end density",
    "_by_user",
)
_per_source(
    "gaussian_fit",
    distribution.gaussian_fit,
    f""", {BOUNDS}, grid AS (SELECT b.*, point, lo + point * ((hi - lo) / 999) AS x
      FROM bounds b CROSS JOIN (SELECT unnest(range(1000)) AS point))
      SELECT meter_id, point, x, exp(-0.5e0 * pow((x - m) / nullif(sd, 0), 2)) / (nullif(sd, 0) * sqrt(2 * pi()))
        AS density FROM grid""",
    "x density",
    once=True,
)


def _acf_sql(series: str, max_lag: int = 96) -> str:
    return f""", line AS ({series}), centred AS (
      SELECT meter_id, pos, power_kw - avg(power_kw) OVER (PARTITION BY meter_id) AS x FROM line),
    totals AS (SELECT meter_id, sum(x * x) AS total, count(x) AS n FROM centred GROUP BY 1),
    pairs AS (SELECT a.meter_id, l.lag, sum(a.x * b.x) AS s FROM centred a
      CROSS JOIN (SELECT unnest(range(1, {max_lag + 1})) AS lag) l
      JOIN centred b ON b.meter_id = a.meter_id AND b.pos = a.pos - l.lag GROUP BY 1, 2),
    correlations AS (SELECT meter_id, lag, s / total AS acf, n FROM pairs JOIN totals USING (meter_id))"""


BY_POSITION = "SELECT *, row_number() OVER (PARTITION BY meter_id ORDER BY ts) AS pos FROM readings"
BY_TIME = "SELECT *, CAST(epoch(ts) AS BIGINT) // 3600 AS pos FROM readings"

_per_source("acf", autocorrelation.acf, _acf_sql(BY_POSITION) + " SELECT * FROM correlations", "acf")
_per_source(
    "acf_by_time",
    lambda r: autocorrelation.acf(r, by="time"),
    _acf_sql(BY_TIME) + " SELECT * FROM correlations",
    "acf",
)
_per_source("acf_month", lambda r: autocorrelation.acf(r, 719), _acf_sql(BY_POSITION, 719) + " SELECT * FROM correlations", "acf")
_per_source(
    "shift_back",
    lambda r: rolling.shift(r, "power_kw", -3).withColumnRenamed("power_kw_lag-3", "power_kw_lead3"),
    "SELECT *, lead(power_kw, 3) OVER (PARTITION BY meter_id ORDER BY ts) AS power_kw_lead3 FROM readings",
    "power_kw power_kw_lead3",
    "_by_supplier",
)
_per_source(
    "acf_confint",
    lambda r: autocorrelation.acf_confint(autocorrelation.acf(r)),
    _acf_sql(BY_POSITION)
    + """ SELECT *, 1.959963984540054e0 * sqrt((1 + 2 * coalesce(sum(acf * acf) OVER (PARTITION BY meter_id
      ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / n) AS bound FROM correlations""",
    "acf bound",
)
_per_source(
    "load_ramps",
    autocorrelation.load_ramps,
    """, steps AS (SELECT *, coalesce(power_kw > lag(power_kw) OVER (PARTITION BY meter_id ORDER BY ts), false)
        AS up FROM readings),
      runs AS (SELECT *, sum(CASE WHEN up THEN 0 ELSE 1 END) OVER (PARTITION BY meter_id ORDER BY ts
        ROWS UNBOUNDED PRECEDING) AS run FROM steps)
      SELECT meter_id, min(ts) AS start_ts, max(ts) AS end_ts, count(*) - 1 AS rises,
        max(power_kw) - min(power_kw) AS total_rise_kw FROM runs GROUP BY meter_id, run HAVING count(*) > 3""",
    "total_rise_kw",
    "_by_user",
)

# --- anomalies ------------------------------------------------------------------------------------


def _z_sql(rows: str, value: str, keep: str = "abs(z_score) > 2", deviation: str = "stddev_samp") -> str:
    return f"""SELECT * FROM (SELECT r.*, p95, mean, stddev, ({value} - mean) / nullif(stddev, 0) AS z_score
      FROM ({rows}) r JOIN (SELECT meter_id, quantile_cont({value}, 0.95) AS p95, avg({value}) AS mean,
        {deviation}({value}) AS stddev FROM ({rows}) GROUP BY 1) USING (meter_id)) WHERE {keep}"""


def _robust_sql(rows: str, value: str, keep: str = "abs(z_robust) > 2", by: str = "meter_id") -> str:
    return f"""SELECT * FROM (SELECT c.*, mad, ({value} - median) / nullif(1.4826e0 * mad, 0) AS z_robust
      FROM (SELECT *, median({value}) OVER (PARTITION BY {by}) AS median FROM ({rows})) c
      JOIN (SELECT {by}, median(abs({value} - median)) AS mad FROM (
        SELECT *, median({value}) OVER (PARTITION BY {by}) AS median FROM ({rows})) GROUP BY ALL) USING ({by}))
      WHERE {keep}"""


ROWS = "SELECT * FROM readings"
DAY_MEANS = "SELECT meter_id, CAST(ts AS DATE) AS date, avg(power_kw) AS mean_kw FROM readings GROUP BY 1, 2"
Z_COLUMNS = "p95 mean stddev z_score"
R_COLUMNS = "median mad z_robust"

_per_source(
    "zscore", anomalies.zscore, _z_sql(ROWS, "power_kw"), f"power_kw {Z_COLUMNS}", "_by_user _by_supplier"
)
_per_source(
    "zscore_population",
    lambda r: anomalies.zscore(r, ddof=0, side="upper"),
    _z_sql(ROWS, "power_kw", "z_score > 2", "stddev_pop"),
    f"power_kw {Z_COLUMNS}",
)
_per_source("zscore_daily", anomalies.zscore_daily, _z_sql(DAY_MEANS, "mean_kw"), f"mean_kw {Z_COLUMNS}", "_by_user")
_per_source(
    "robust_z",
    anomalies.robust_z,
    _robust_sql(ROWS, "power_kw"),
    f"power_kw {R_COLUMNS}",
    "_by_user _by_supplier",
)
_per_source(
    "robust_z_upper",
    lambda r: anomalies.robust_z(r, side="upper"),
    _robust_sql(ROWS, "power_kw", "z_robust > 2"),
    f"power_kw {R_COLUMNS}",
)
_per_source(
    "robust_z_daily", anomalies.robust_z_daily, _robust_sql(DAY_MEANS, "mean_kw"), f"mean_kw {R_COLUMNS}", "_by_user"
)

EII = (3, 6, 9, 12)
INSTABILITY = f""", rolled AS ({_rolling_sql("cv", CV, EII)}),
  long AS ({" UNION ALL ".join(f"SELECT meter_id, ts, power_kw, {w} AS window_rows, cv_{w} AS cv FROM rolled" for w in EII)}),
  medians AS (SELECT *, median(cv) OVER (PARTITION BY meter_id, window_rows) AS med FROM long),
  mads AS (SELECT meter_id, window_rows, median(abs(cv - med)) AS mad FROM medians GROUP BY 1, 2),
  scored AS (SELECT meter_id, ts, power_kw, CAST(window_rows AS BIGINT) AS window_rows, cv,
    (cv - med) / (1.4826e0 * CASE WHEN mad = 0 THEN 1e-6 ELSE mad END) AS instability
    FROM medians JOIN mads USING (meter_id, window_rows))"""
_per_source(
    "instability_index", anomalies.instability_index, f"{INSTABILITY} SELECT * FROM scored", "power_kw cv instability"
)
_per_source(
    "instability_points",
    lambda r: anomalies.instability_points(anomalies.instability_index(r)),
    f"""{INSTABILITY} SELECT *, CASE WHEN instability > 3 THEN 'strong' ELSE 'moderate' END AS level FROM scored
      WHERE instability > 2""",
    "power_kw cv instability",
)


def _both_scores(readings: DataFrame) -> DataFrame:
    return anomalies.anomaly_table(
        {"zscore": anomalies.zscore(readings), "robust_z": anomalies.robust_z(readings)}
    )


BOTH = f""", found AS (SELECT meter_id, ts, power_kw, 'zscore' AS method FROM ({_z_sql(ROWS, "power_kw")})
  UNION ALL SELECT meter_id, ts, power_kw, 'robust_z' AS method FROM ({_robust_sql(ROWS, "power_kw")}))"""
_per_source("anomaly_table", _both_scores, f"{BOTH} SELECT * FROM found", "power_kw", "_by_user")
_per_source(
    "anomaly_counts",
    lambda r: anomalies.anomaly_counts(_both_scores(r)),
    f"{BOTH} SELECT meter_id, method, count(*) AS anomalies FROM found GROUP BY 1, 2",
    "",
)
_per_source(
    "anomaly_votes",
    lambda r: anomalies.anomaly_votes(_both_scores(r)),
    f"""{BOTH} SELECT meter_id, ts, power_kw, count(DISTINCT method) AS votes FROM found
      GROUP BY 1, 2, 3 HAVING count(DISTINCT method) >= 2""",
    "power_kw",
)


def _sql_absorbed(state: str, part: str) -> str:
    """The hash step of the draws."""
    first = f"(({state}) + {part}) * 48271 % 2147483647"
    second = f"list_transform([{first}], lambda x: xor(x, x >> 15) * 69621 % 2147483647)[1]"
    return f"list_transform([{second}], lambda x: xor(x, x >> 13))[1]"


def _sql_path(n: str) -> str:
    return f"CASE WHEN {n} <= 1 THEN 0e0 WHEN {n} = 2 THEN 1e0 ELSE 2e0 * (ln({n} - 1e0) + 0.5772156649015329e0) - 2e0 * ({n} - 1e0) / {n} END"


#: Every tree by recursion: the readings it sees and all values walk down together; a node lies between the readings in it.
ISOLATION = f""", seen AS (SELECT meter_id, power_kw AS v, row_number() OVER (PARTITION BY meter_id ORDER BY ts, power_kw) - 1 AS r,
    count(*) OVER (PARTITION BY meter_id) AS n, CAST('0x' || substr(md5(CAST(meter_id AS VARCHAR)), 1, 7) AS BIGINT) + 42 AS own
    FROM (SELECT DISTINCT meter_id, ts, power_kw FROM readings)),
  sized AS (SELECT *, least(n, 256) AS size, greatest(1, n // least(n, 256)) AS hands FROM seen),
  dealt AS (SELECT *, row_number() OVER (PARTITION BY meter_id, deal ORDER BY {_sql_absorbed(_sql_absorbed(_sql_absorbed("0", "own"), "deal"), "r")}, r) - 1 AS place
    FROM sized, unnest(range(0, CAST(ceil(100 / hands) AS BIGINT))) AS t(deal)),
  start AS (SELECT meter_id, own, size, deal * hands + place // size AS tree, v, true AS inner_one FROM dealt
    WHERE place < hands * size AND deal * hands + place // size < 100
    UNION ALL SELECT meter_id, own, size, tree, v, false FROM (SELECT DISTINCT meter_id, own, size, v FROM sized), unnest(range(0, 100)) AS t(tree)),
  walk AS (SELECT *, 1 AS node, 0 AS depth, NULL::DOUBLE AS path FROM start
    UNION ALL SELECT meter_id, own, size, tree, v, inner_one,
      2 * node + CASE WHEN v > lo + (hi - lo) * ({_sql_absorbed(_sql_absorbed(_sql_absorbed("1", "own"), "tree"), "node")} / 2147483648e0) THEN 1 ELSE 0 END, depth + 1,
      CASE WHEN lo < hi AND depth < ceil(log2(greatest(size, 2))) THEN NULL ELSE depth + {_sql_path("held")} END
    FROM (SELECT *, min(CASE WHEN inner_one THEN v END) OVER w AS lo, max(CASE WHEN inner_one THEN v END) OVER w AS hi,
      count(CASE WHEN inner_one THEN 1 END) OVER w AS held FROM walk WHERE path IS NULL WINDOW w AS (PARTITION BY meter_id, tree, node))),
  scores AS (SELECT meter_id, v AS power_kw,
    round(power(2e0, -avg(path) / CASE WHEN any_value(size) <= 2 THEN 1e0 ELSE {_sql_path("any_value(size)")} END), 12) AS score
    FROM walk WHERE path IS NOT NULL AND NOT inner_one GROUP BY 1, 2),
  judged AS (SELECT r.*, score, quantile_cont(score, 0.99) OVER (PARTITION BY meter_id) AS lim FROM readings r JOIN scores USING (meter_id, power_kw))
  SELECT * EXCLUDE (lim) FROM judged WHERE score > lim"""
_per_source("isolation_forest", isolation.isolation_forest, ISOLATION, "power_kw score", "_by_user")
for _name in ("isolation_forest", "isolation_forest_by_user"):
    _SQL[_name] = _SQL[_name].replace("WITH readings", "WITH RECURSIVE readings", 1)

# --- covariate and models -------------------------------------------------------------------------

WAVE = """, heated AS (SELECT *, 5e0 + 10e0 * sin(2 * pi() * (row_number() OVER (
    PARTITION BY meter_id ORDER BY ts) - 1) / 24e0 + (-2 * pi() * 15 / 24)) AS outdoor_temp FROM readings)"""
LAGGED = (
    WAVE
    + """, placed AS (SELECT *, row_number() OVER (PARTITION BY meter_id ORDER BY ts) AS pos FROM heated),
  pairs AS (SELECT a.meter_id, a.ts, a.power_kw, a.outdoor_temp, l.lag, b.outdoor_temp AS earlier
    FROM placed a CROSS JOIN (SELECT unnest(range(24)) AS lag) l
    LEFT JOIN placed b ON b.meter_id = a.meter_id AND b.pos = a.pos - l.lag),
  corrs AS (SELECT meter_id, lag, corr(power_kw, earlier) AS corr FROM pairs WHERE earlier IS NOT NULL GROUP BY 1, 2),
  best AS (SELECT meter_id, first(lag ORDER BY corr, lag) AS best_lag, min(corr) AS best_corr FROM corrs GROUP BY 1),
  shifted AS (SELECT p.meter_id, p.ts, p.power_kw, p.outdoor_temp, p.earlier AS outdoor_temp_shifted
    FROM pairs p JOIN best b ON b.meter_id = p.meter_id AND b.best_lag = p.lag)"""
)


def _heated(readings: DataFrame) -> DataFrame:
    return covariate.harmonic_feature(readings)


def _shifted(readings: DataFrame) -> DataFrame:
    heated = _heated(readings)
    best = covariate.best_lag(covariate.lag_correlation(heated))
    return covariate.shift_covariate(heated, best)


def _fit_sql(x: str) -> str:
    return f"""SELECT meter_id, round_even(regr_slope(power_kw, {x}), 1) AS slope,
      round_even(regr_intercept(power_kw, {x}), 1) AS intercept FROM shifted GROUP BY 1"""


def _errors_sql(x: str) -> str:
    return f"""SELECT meter_id, slope, intercept, avg(abs(power_kw - (slope * {x} + intercept))) AS mae,
      sqrt(avg(pow(power_kw - (slope * {x} + intercept), 2))) AS rmse
      FROM shifted JOIN ({_fit_sql(x)}) USING (meter_id) WHERE {x} IS NOT NULL GROUP BY 1, 2, 3"""


_per_source(
    "harmonic_feature", _heated, f"{WAVE} SELECT * FROM heated", "power_kw outdoor_temp", "_by_user"
)
_per_source(
    "harmonic_clock",
    lambda r: covariate.harmonic_feature(r, index="hour"),
    "SELECT *, 5e0 + 10e0 * sin(2 * pi() * (epoch(ts) // 3600) / 24e0 + (-2 * pi() * 15 / 24)) AS outdoor_temp FROM readings",
    "power_kw outdoor_temp",
    "_by_user",
)


def _weather(spark: SparkSession, sf: str) -> DataFrame:
    """A feed on its own clock: mean order price per day."""
    return (
        _table(spark, sf, "orders")
        .groupBy(F.col("o_orderdate").cast("timestamp_ntz").alias("ts"))
        .agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("feed"))
    )


FEED = """, feed AS (SELECT o_orderdate AS ts, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS feed
  FROM orders GROUP BY 1)"""
_register(
    "attach_covariate",
    lambda s, d: covariate.attach_covariate(_stored(_supplier_readings)(s, d), _weather(s, d)),
    f"{SUPPLIER_READINGS}{FEED} SELECT r.*, f.feed FROM readings r LEFT JOIN feed f ON f.ts = r.ts",
    "power_kw feed",
)
_register(
    "attach_covariate_asof",
    lambda s, d: covariate.attach_covariate(_stored(_readings)(s, d), _weather(s, d), asof=True),
    f"{READINGS}{FEED} SELECT r.*, f.feed FROM readings r ASOF LEFT JOIN feed f ON r.ts >= f.ts",
    "power_kw feed",
)


def _own_feed(spark: SparkSession, sf: str) -> DataFrame:
    """A feed of each meter: every sixth hour's reading."""
    return _stored(_readings)(spark, sf).filter(F.hour("ts") % 6 == 0).select("meter_id", "ts", F.col("power_kw").alias("feed"))


OWN_FEED = ", feed AS (SELECT meter_id, ts, power_kw AS feed FROM readings WHERE hour(ts) % 6 = 0)"
_register(
    "attach_covariate_per_key",
    lambda s, d: covariate.attach_covariate(_stored(_readings)(s, d), _own_feed(s, d), per_key=True),
    f"{READINGS}{OWN_FEED} SELECT r.*, f.feed FROM readings r LEFT JOIN feed f USING (meter_id, ts)",
    "power_kw feed",
)
_register(
    "attach_covariate_per_key_asof",
    lambda s, d: covariate.attach_covariate(_stored(_readings)(s, d), _own_feed(s, d), per_key=True, asof=True),
    f"{READINGS}{OWN_FEED} SELECT r.*, f.feed FROM readings r ASOF LEFT JOIN feed f ON r.meter_id = f.meter_id AND r.ts >= f.ts",
    "power_kw feed",
)
_per_source(
    "corr_lag0",
    lambda r: covariate.corr_lag0(_heated(r)),
    f"{WAVE} SELECT meter_id, corr(power_kw, outdoor_temp) AS corr FROM heated GROUP BY 1",
    "corr",
)
_per_source(
    "lag_correlation",
    lambda r: covariate.lag_correlation(_heated(r)),
    f"{LAGGED} SELECT * FROM corrs",
    "corr",
)
_per_source(
    "best_lag",
    lambda r: covariate.best_lag(covariate.lag_correlation(_heated(r))),
    f"{LAGGED} SELECT * FROM best",
    "best_corr",
)
_per_source(
    "best_lag_abs",
    lambda r: covariate.best_lag(covariate.lag_correlation(_heated(r)), "abs"),
    f"{LAGGED} SELECT meter_id, first(lag ORDER BY abs(corr) DESC, lag) AS best_lag, first(corr ORDER BY abs(corr) DESC, lag) AS best_corr FROM corrs GROUP BY 1",
    "best_corr",
)
_per_source(
    "shift_covariate",
    _shifted,
    f"{LAGGED} SELECT * FROM shifted",
    "power_kw outdoor_temp outdoor_temp_shifted",
)
_per_source(
    "linear_fit",
    lambda r: models.linear_fit(_shifted(r), "outdoor_temp_shifted"),
    f"{LAGGED} {_fit_sql('outdoor_temp_shifted')}",
    "slope intercept",
)
_per_source(
    "regression_metrics",
    lambda r: models.regression_metrics(
        models.linear_predict(_heated(r), models.linear_fit(_heated(r)))
    ),
    f"{WAVE.replace('heated', 'shifted')} SELECT meter_id, mae, rmse FROM ({_errors_sql('outdoor_temp')})",
    "mae rmse",
)
_per_source(
    "linear_comparison",
    lambda r: models.model_comparison(_heated(r)),
    f"""{LAGGED} SELECT meter_id, lag, corr, slope, intercept, mae, rmse, 'linear' AS model
        FROM corrs JOIN ({_errors_sql("outdoor_temp")}) USING (meter_id) WHERE lag = 0
      UNION ALL SELECT meter_id, best_lag AS lag, best_corr AS corr, slope, intercept, mae, rmse,
        'linear' AS model FROM best JOIN ({_errors_sql("outdoor_temp_shifted")}) USING (meter_id)""",
    "corr slope intercept mae rmse",
)


def _nameless(spark: SparkSession, sf: str) -> DataFrame:
    """Readings in which one meter has no name and every sixth hour no number (NaN)."""
    name = F.when(F.col("meter_id") != "click", F.col("meter_id"))
    value = F.when(F.hour("ts") % 6 == 5, float("nan")).otherwise(F.col("power_kw"))
    return _stored(_readings)(spark, sf).select(name.alias("meter_id"), "ts", value.alias("power_kw"))


#: The same for SQL, which groups the nameless meter under '~' until the end.
NAMELESS = READINGS.replace("WITH readings", "WITH named") + """, readings AS (SELECT CASE WHEN meter_id = 'click' THEN '~' ELSE meter_id END AS meter_id, ts,
  CASE WHEN hour(ts) % 6 = 5 THEN NULL ELSE power_kw END AS power_kw FROM named)"""


def _unnamed(sql: str) -> str:
    return f"SELECT * REPLACE (nullif(meter_id, '~') AS meter_id) FROM ({sql})"


_register(
    "linear_comparison_nameless",
    lambda s, d: models.model_comparison(_heated(_nameless(s, d))),
    _unnamed(
        f"""{NAMELESS}{LAGGED} SELECT meter_id, lag, corr, slope, intercept, mae, rmse, 'linear' AS model
        FROM corrs JOIN ({_errors_sql("outdoor_temp")}) USING (meter_id) WHERE lag = 0
      UNION ALL SELECT meter_id, best_lag AS lag, best_corr AS corr, slope, intercept, mae, rmse,
        'linear' AS model FROM best JOIN ({_errors_sql("outdoor_temp_shifted")}) USING (meter_id)"""
    ),
    "corr slope intercept mae rmse",
)
_register("forest_fit_nameless", lambda s, d: models.forest_fit(_heated(_nameless(s, d))))


def _types(spark: SparkSession, sf: str) -> list[str]:
    return sorted(r["meter_id"] for r in quality.distinct_keys(_stored(_readings)(spark, sf)).collect())


# forests have no SQL twin; tests/test_models.py checks them against recursion and another library
_register("forest_fit", lambda s, d: models.forest_fit(_heated(_stored(_readings)(s, d))))
_register("model_comparison", lambda s, d: models.model_comparison(_heated(_stored(_readings)(s, d)), _types(s, d)))

# --- demand-side management -----------------------------------------------------------------------

DSM = """, caps AS (SELECT meter_id, quantile_cont(power_kw, 0.95) AS p95,
    coalesce(sum(power_kw * 0.2e0) FILTER (hour(ts) BETWEEN 18 AND 20), 0) AS moved,
    count(*) FILTER (hour(ts) BETWEEN 2 AND 4) AS nights FROM readings GROUP BY 1),
  dsm AS (SELECT r.*, power_kw AS energy_kwh, least(power_kw, p95) AS energy_clipped,
    CASE WHEN nights = 0 THEN power_kw WHEN hour(ts) BETWEEN 18 AND 20 THEN power_kw * 0.8e0
         WHEN hour(ts) BETWEEN 2 AND 4 THEN power_kw + moved / nights ELSE power_kw END AS energy_shifted,
    CASE WHEN hour(ts) BETWEEN 17 AND 20 THEN power_kw * 0.9e0 ELSE power_kw END AS energy_reduced
    FROM readings r JOIN caps USING (meter_id))"""
BASE = "meter_id, ts, power_kw, energy_kwh"
TOTALS = ", ".join(
    f"sum({c}) AS t_{n}, max({c}) / nullif(avg({c}), 0) AS f_{n}" for n, c in dsm.STRATEGIES.items()
)
SUMMARY = " UNION ALL ".join(
    f"""SELECT meter_id, '{n}' AS strategy, t_{n} AS total_kwh, f_{n} AS peak_factor,
      t_original - t_{n} AS saving_kwh, 100e0 * (t_original - t_{n}) / nullif(t_original, 0) AS saving_pct FROM totals"""
    for n in dsm.STRATEGIES
)
PROFILE_COLUMNS = "power_kw energy_kwh energy_clipped energy_shifted energy_reduced"

_per_source(
    "dsm_clip", dsm.dsm_clip, f"{DSM} SELECT {BASE}, energy_clipped FROM dsm", "power_kw energy_kwh energy_clipped"
)
_per_source(
    "dsm_shift", dsm.dsm_shift, f"{DSM} SELECT {BASE}, energy_shifted FROM dsm", "power_kw energy_kwh energy_shifted"
)
_per_source(
    "dsm_reduce", dsm.dsm_reduce, f"{DSM} SELECT {BASE}, energy_reduced FROM dsm", "power_kw energy_kwh energy_reduced", once=True)
_per_source("dsm_profiles", dsm.dsm_profiles, f"{DSM} SELECT * FROM dsm", PROFILE_COLUMNS, "_by_user")
_per_source(
    "dsm_summary",
    lambda r: dsm.dsm_summary(dsm.dsm_profiles(r)),
    f"{DSM}, totals AS (SELECT meter_id, {TOTALS} FROM dsm GROUP BY 1) {SUMMARY}",
    "total_kwh peak_factor saving_kwh saving_pct",
    "_by_user",
)
_per_source(
    "strategy_long",
    lambda r: reshape.strategy_long(
        dsm.dsm_profiles(r), ["energy_clipped", "energy_shifted", "energy_reduced"], ["meter_id", "ts"]
    ),
    f"""{DSM} SELECT meter_id, ts, strategy, value FROM (UNPIVOT dsm
      ON energy_clipped, energy_shifted, energy_reduced INTO NAME strategy VALUE value)""",
    "value",
)

# --- streaming ------------------------------------------------------------------------------------
# The event table is read as a file stream until it is used up.  In append mode a window is written
# when the watermark has passed its end; the SQL keeps the windows closed by then.


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    source = (
        spark.readStream.schema(_events(spark, sf).schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf)
    )
    return source.select(F.col("event_type").alias("meter_id"), "ts", F.col("value").alias("power_kw"), "event_id")


def _drained(result: DataFrame) -> DataFrame:
    spark = result.sparkSession
    path = _fresh_dir(spark, "stream")
    query = (
        result.writeStream.format("parquet")
        .option("path", f"{path}/rows")
        .option("checkpointLocation", f"{path}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{path}/rows")


def _stream_copies(spark: SparkSession, sf: str) -> DataFrame:
    copies = F.when(F.col("event_id") % 53 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return _stream(spark, sf).withColumn("copy", F.explode(copies)).drop("copy", "event_id")


def _baseline(spark: SparkSession, sf: str) -> DataFrame:
    return _baseline_of(_stream_rows(spark, sf))


def _baseline_of(rows: DataFrame) -> DataFrame:
    scored = anomalies.robust_z(rows, threshold=None)
    return scored.groupBy("meter_id").agg(
        F.avg("power_kw").alias("mean"),
        F.stddev_samp("power_kw").alias("stddev"),
        F.max("median").alias("median"),
        F.max("mad").alias("mad"),
    )


def _stream_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).select(F.col("event_type").alias("meter_id"), "ts", F.col("value").alias("power_kw"))


def _limits(spark: SparkSession, sf: str) -> DataFrame:
    return profiles.contract_power(_stream_rows(spark, sf), 0.9, 1.0)


def _holed(events: DataFrame) -> DataFrame:
    """One meter without a name, every seventh event without a number (NaN)."""
    name = F.when(F.col("meter_id") != "click", F.col("meter_id"))
    value = F.when(F.col("event_id") % 7 == 0, float("nan")).otherwise(F.col("power_kw"))
    return events.withColumn("meter_id", name).withColumn("power_kw", value)


def _holed_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _holed(_events(spark, sf).select(F.col("event_type").alias("meter_id"), "ts", F.col("value").alias("power_kw"), "event_id"))


RAW = "WITH readings AS (SELECT event_type AS meter_id, ts, value AS power_kw, event_id FROM events)"
HOLED = """WITH readings AS (SELECT CASE WHEN event_type = 'click' THEN '~' ELSE event_type END AS meter_id, ts,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS power_kw, event_id FROM events)"""
CLOSED = "<= (SELECT max(ts) FROM readings) - INTERVAL 2 HOUR"

_register(
    "stream_hourly",
    lambda s, d: _drained(monitor.stream_hourly(_stream(s, d))),
    f"""{RAW} SELECT meter_id, date_trunc('hour', ts) AS ts,
      CAST(sum(CAST(power_kw AS DECIMAL(18,2))) AS DOUBLE) AS power_kw FROM readings GROUP BY 1, 2
      HAVING date_trunc('hour', readings.ts) + INTERVAL 1 HOUR {CLOSED}""",
    "power_kw",
)
_register(
    "stream_rolling",
    lambda s, d: _drained(monitor.stream_rolling(_stream(s, d))),
    f"""{RAW}, spread AS (SELECT meter_id, w AS window_hours, power_kw,
        date_trunc('hour', ts) + INTERVAL 1 HOUR + i * INTERVAL 1 HOUR AS window_end
      FROM readings, (VALUES (3), (6), (12)) v(w), (SELECT unnest(range(12)) AS i) WHERE i < w)
      SELECT meter_id, CAST(window_hours AS BIGINT) AS window_hours, window_end, avg(power_kw) AS mean_kw,
        stddev_samp(power_kw) AS stddev_kw, stddev_samp(power_kw) / nullif(avg(power_kw), 0) AS cv, count(*) AS n
      FROM spread WHERE window_end {CLOSED} GROUP BY 1, 2, 3""",
    "mean_kw stddev_kw cv",
)
_register(
    "stream_dedup",
    lambda s, d: _drained(monitor.stream_dedup(_stream_copies(s, d))),
    f"{RAW} SELECT DISTINCT meter_id, ts, power_kw FROM readings",
    "power_kw",
)
_register(
    "stream_zscore",
    lambda s, d: _drained(monitor.stream_zscore(_stream(s, d), _baseline(s, d))),
    f"""{RAW}, centred AS (SELECT *, median(power_kw) OVER (PARTITION BY meter_id) AS median FROM readings),
      base AS (SELECT meter_id, avg(power_kw) AS mean, stddev_samp(power_kw) AS stddev,
        median(abs(power_kw - median)) AS mad FROM centred GROUP BY 1),
      scored AS (SELECT meter_id, ts, power_kw, event_id, mean, stddev, median, mad,
        (power_kw - mean) / nullif(stddev, 0) AS z_score,
        (power_kw - median) / nullif(1.4826e0 * mad, 0) AS z_robust FROM centred JOIN base USING (meter_id))
      SELECT * FROM scored WHERE abs(z_score) > 2 OR abs(z_robust) > 2""",
    "power_kw mean stddev median mad z_score z_robust",
)
_register(
    "stream_overload_sessions",
    lambda s, d: _drained(monitor.stream_overload_sessions(_stream(s, d), _limits(s, d))),
    f"""{RAW}, limits AS (SELECT meter_id, quantile_cont(power_kw, 0.9) AS cap FROM readings GROUP BY 1),
      over AS (SELECT r.* FROM readings r JOIN limits USING (meter_id) WHERE power_kw > cap),
      marked AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY meter_id ORDER BY ts) + INTERVAL 1 HOUR
        THEN 0 ELSE 1 END AS fresh FROM over),
      grouped AS (SELECT *, sum(fresh) OVER (PARTITION BY meter_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
        AS session FROM marked)
      SELECT meter_id, min(ts) AS session_start, max(ts) + INTERVAL 1 HOUR AS session_end, count(*) AS readings,
        max(power_kw) AS max_kw FROM grouped GROUP BY meter_id, session
      HAVING max(grouped.ts) + INTERVAL 1 HOUR {CLOSED}""",
    "max_kw",
)


# streams with a nameless meter and missing numbers
_register(
    "stream_hourly_holes",
    lambda s, d: _drained(monitor.stream_hourly(_holed(_stream(s, d)))),
    _unnamed(_SQL["stream_hourly"].replace(RAW, HOLED)),
)
_register(
    "stream_rolling_holes",
    lambda s, d: _drained(monitor.stream_rolling(_holed(_stream(s, d)))),
    _unnamed(_SQL["stream_rolling"].replace("count(*) AS n", "count(power_kw) AS n").replace(RAW, HOLED)),
)
_register(
    "stream_zscore_holes",
    lambda s, d: _drained(monitor.stream_zscore(_holed(_stream(s, d)), _baseline_of(_holed_rows(s, d)))),
    _unnamed(_SQL["stream_zscore"].replace(RAW, HOLED)),
)
_register(
    "stream_overload_sessions_holes",
    lambda s, d: _drained(monitor.stream_overload_sessions(_holed(_stream(s, d)), profiles.contract_power(_holed_rows(s, d), 0.9, 1.0))),
    _unnamed(_SQL["stream_overload_sessions"].replace(RAW, HOLED)),
)


# The text operators stand apart: without their package the library and its other queries still work.
try:
    import corpus_pipeline
    from wattline.llm import queries as llm_queries
except ImportError:
    pass
else:
    _QUERIES.update(llm_queries.QUERIES)
    _SQL.update(llm_queries.SQL)
    _QUERIES["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL is not None:
        _SQL["pipeline"] = corpus_pipeline.ORACLE_SQL


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the daily load profile of every meter."""
    return queries()["daily_profile"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    """One entry per operator; each takes (spark, sf_dir)."""
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """The same results in DuckDB's SQL, where SQL can express them."""
    return dict(_SQL)
