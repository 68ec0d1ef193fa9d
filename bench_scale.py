"""How the operators scale: the event readings copied to many meters, and one meter with a third of all rows.

    python bench_scale.py [copies] [operator ...]

Each copy of the five series gets its own meter and factor; the hot meter holds the readings of half as
many copies, a second apart.  Prints rows and seconds per operator for both tables.
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.operators import (
    anomalies,
    autocorrelation,
    covariate,
    dsm,
    energy,
    isolation,
    peaks,
    profiles,
    rolling,
)
from wattline.plans.scale import measure
from wattline.session import build_session, stage
from wattline.sources.tables import hourly_readings

OPERATORS = {
    "daily_profile": lambda d, s: profiles.daily_profile(d),
    "percentile_by_key": lambda d, s: profiles.percentile_by_key(d, scale=s),
    "zscore": lambda d, s: anomalies.zscore(d, scale=s),
    "robust_z": lambda d, s: anomalies.robust_z(d, scale=s),
    "cumulative_energy": lambda d, s: energy.cumulative_energy(d, scale=s),
    "rolling_cv": lambda d, s: rolling.rolling_cv(d, scale=s),
    "daily_peaks": lambda d, s: peaks.daily_peaks(d, scale=s),
    "lag_correlation": lambda d, s: covariate.lag_correlation(covariate.harmonic_feature(d, scale=s), scale=s),
    "acf_24": lambda d, s: autocorrelation.acf(d, 24, scale=s),
    "load_ramps": lambda d, s: autocorrelation.load_ramps(d, scale=s),
    "dsm_summary": lambda d, s: dsm.dsm_summary(dsm.dsm_profiles(d, scale=s)),
    "isolation_forest": lambda d, s: isolation.isolation_forest(d, scale=s),
}


def many_meters(spark: SparkSession, sf: str, copies: int) -> DataFrame:
    base = hourly_readings(spark.read.parquet(f"{sf}/events.parquet"), "event_type")
    copy = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
    return base.withColumn("copy", copy).select(
        F.concat_ws("-", "meter_id", "copy").alias("meter_id"),
        "ts",
        (F.col("power_kw") * (1 + F.col("copy") / 1000)).alias("power_kw"),
        "copy",
    )


def with_hot_meter(rows: DataFrame, copies: int) -> DataFrame:
    series = F.abs(F.hash(F.split_part("meter_id", F.lit("-"), F.lit(1)))) % 1000
    second = F.make_dt_interval(secs=(F.col("copy") + series * copies) % 3600 + F.lit(0.0))
    hot = rows.filter(F.col("copy") < copies // 2).withColumns(
        {"meter_id": F.lit("hot"), "ts": F.col("ts") + second}
    )
    return rows.unionByName(hot)


def main() -> None:
    copies = int(sys.argv[1]) if len(sys.argv) > 1 else 1000
    chosen = sys.argv[2:] or list(OPERATORS)
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session(
        f"local[{os.environ.get('BENCH_CPUS', '8')}]",
        "scale",
        spark__sql__shuffle__partitions="32",
        spark__driver__memory="16g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    plain = many_meters(spark, sf, copies).repartition(32)
    for label, rows in (("many", plain), ("hot", with_hot_meter(plain, copies))):
        stored = stage(rows.drop("copy"), label)
        start = time.perf_counter()
        scale = measure(stored, ["meter_id"])
        print(f"{label}: {scale.rows} rows, {scale.keys} keys, longest {scale.largest}, measured in "
              f"{time.perf_counter() - start:.1f} s", flush=True)
        for name in chosen:
            start = time.perf_counter()
            OPERATORS[name](stored, scale).write.format("noop").mode("overwrite").save()
            seconds = time.perf_counter() - start
            print(f"{label} {name} {seconds:.1f} s {scale.rows / seconds / 1e6:.2f} M rows/s", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
