"""What the physical plans must look like, and independence of the data layout."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.conftest import rows_of
from wattline.operators import anomalies, autocorrelation, energy, peaks, profiles, quality, rolling
from wattline.sources import tables


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def count(plan, node):
    return len(re.findall(rf"\b{node}\b", plan))


@pytest.fixture(scope="module")
def stored(spark, golden, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "readings")
    tables.write_readings(golden, path)
    return tables.read_readings_table(spark, path)


def test_profiles_read_three_columns_and_shuffle_once(stored):
    for operator in (profiles.daily_profile, profiles.hourly_profile, profiles.tariff_stability):
        plan = plan_of(operator(stored))
        assert count(plan, "Exchange") == 1 and "partial_avg" in plan
    plan = plan_of(profiles.stability_summary(stored))
    assert "ReadSchema: struct<meter_id:string,power_kw:double>" in plan


def test_key_filter_reaches_the_scan_below_a_window(stored):
    plan = plan_of(rolling.rolling_mean(stored.drop("month")).filter("meter_id = '1'"))
    assert "EqualTo(meter_id,1)" in plan


def test_many_windows_share_one_shuffle_and_sort(stored):
    plan = plan_of(rolling.rolling_cv(stored, (3, 6, 9, 12)))
    assert count(plan, "Exchange") == 1 and count(plan, "Sort") == 1


def test_ranks_are_limited_before_the_shuffle(stored):
    plan = plan_of(peaks.daily_peaks(stored))
    assert re.search(r"Exchange hashpartitioning\(meter_id.*date.*\n.*WindowGroupLimit", plan)
    plan = plan_of(quality.dedup(stored, ["power_kw"]))
    assert count(plan, "WindowGroupLimit") == 2


def test_small_key_tables_are_broadcast_and_readings_not_shuffled(stored):
    plan = plan_of(anomalies.zscore(stored))
    assert count(plan, "BroadcastHashJoin") == 1 and "SortMergeJoin" not in plan


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if not n.startswith("stream_")))
def test_no_query_multiplies_its_rows(spark, sf, name):
    if name in ("forest_fit", "model_comparison", "isolation_forest"):
        pytest.skip("fits models while planning")
    plan = plan_of(entry.queries()[name](spark, sf))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("partitions", [1, 16])
def test_results_do_not_depend_on_the_layout(spark, golden, partitions):
    def results(df):
        return [
            rows_of(profiles.daily_profile(df)),
            rows_of(energy.cumulative_energy(df)),
            rows_of(anomalies.robust_z(df, 1)),
            rows_of(autocorrelation.acf(df, 12)),
        ]

    want = results(golden)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        assert results(golden.repartition(partitions, F.xxhash64("ts"))) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
