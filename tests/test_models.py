"""Random forest against the line, and the comparison table."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from tests.conftest import rows_of
from wattline.operators import covariate, forest, models


@pytest.fixture(scope="module")
def heated(golden):
    return covariate.harmonic_feature(golden).cache()


def test_forest_beats_the_line_in_sample(heated):
    table = models.model_comparison(heated, ["1"], trees=20).collect()
    rows = {(r["meter_id"], r["model"], r["lag"]): r for r in table}
    assert len(rows) == 6  # two lines per meter, two forests for the named one
    for lag in (0, 4):
        forest, line = rows["1", "forest", lag], rows["1", "linear", lag]
        assert forest["rmse"] <= line["rmse"] and forest["corr"] == line["corr"]
        assert forest["slope"] is None
    assert rows["1", "forest", 4]["rmse"] < rows["1", "forest", 0]["rmse"]


def test_forest_predictions_are_means_of_the_target(heated):
    fitted = models.forest_fit(heated, ["1"], trees=5, max_depth=4)
    assert fitted.count() == 720
    low, high = fitted.selectExpr("min(yhat)", "max(yhat)").first()
    assert 65 <= low <= high <= 430
    with pytest.raises(ValueError):
        models.forest_fit(heated, [])


def plain_tree(bins, weight, total, depth):
    """A tree by recursion: answers per bin; the first of equally good cuts."""
    w, s = weight.sum(), total.sum()
    if w == 0:
        return [float("nan")] * len(bins)
    best = None
    for cut in range(1, len(bins)):
        wl, wr = weight[:cut].sum(), weight[cut:].sum()
        if wl > 0 and wr > 0:
            gain = total[:cut].sum() ** 2 / wl + total[cut:].sum() ** 2 / wr - s * s / w
            if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                best = (gain, cut)
    if best is None or depth == 0:
        return [s / w] * len(bins)
    cut = best[1]
    return plain_tree(bins[:cut], weight[:cut], total[:cut], depth - 1) + plain_tree(bins[cut:], weight[cut:], total[cut:], depth - 1)


@pytest.mark.parametrize("depth", [0, 1, 3, 30])
def test_levels_equal_recursion(depth):
    rng = np.random.default_rng(depth)
    weight = rng.poisson(1.0, (20, 40)).astype(float)
    weight[3] = 0
    total = weight * rng.normal(size=40).round(2)[None, :] * 10
    said = forest.grow(weight, total, depth)
    for k in range(20):
        assert said[k] == pytest.approx(plain_tree(np.arange(40), weight[k], total[k], depth), nan_ok=True)


def test_draws_are_the_same_in_numpy_and_spark(spark):
    rows = np.array([0, 1, -1, 123456789012345, -(2**63), 2**63 - 1], np.int64)
    df = spark.createDataFrame([(int(h), t) for h in rows for t in range(50)], "h long, t int")
    got = {(r[0], r[1]): (r[2], r[3]) for r in df.select("h", "t", forest._drawn(F.col("h"), F.col("t")), F.xxhash64("h", "t")).collect()}
    hashes, drawn = forest.row_tree_hash(rows, np.arange(50)).view(np.int64), forest.bootstrap(rows, np.arange(50))
    for k, h in enumerate(rows):
        for t in range(50):
            assert got[int(h), t] == (drawn[t, k], hashes[t, k])
    many = forest.bootstrap(np.arange(20_000), np.arange(3))
    assert many.mean() == pytest.approx(1, abs=0.02) and many.var() == pytest.approx(1, abs=0.05)


def test_long_keys_answer_alike(heated):
    rows = heated.withColumn("_x", F.col("outdoor_temp").cast("float").cast("double"))
    a = forest.forest_answers(rows, "power_kw", 12, 1, 30, None, ["meter_id"])
    b = forest.forest_answers(rows, "power_kw", 12, 1, 30, None, ["meter_id"], group_rows=10)
    assert rows_of(a) == rows_of(b)
    assert rows_of(a) == rows_of(forest.forest_answers(rows.repartition(7, "ts"), "power_kw", 12, 1, 30, None, ["meter_id"]))
    few = forest.forest_answers(rows, "power_kw", 12, 1, 30, 4, ["meter_id"])
    assert few.groupBy("meter_id").agg(F.count_distinct("yhat").alias("n")).filter("n > 4").count() == 0


def errors_of_ml(rows, trees):
    """RMSE of Spark ML's forest over the rows of one key."""
    single = rows.withColumn("x", F.col("outdoor_temp").cast("float").cast("double"))  # as forest_fit reads it
    assembled = VectorAssembler(inputCols=["x"], outputCol="f").transform(single)
    model = RandomForestRegressor(featuresCol="f", labelCol="power_kw", predictionCol="yhat", numTrees=trees, seed=42, maxDepth=30, maxBins=1000)
    return models.regression_metrics(model.fit(assembled).transform(assembled)).first()["rmse"]


def test_errors_are_those_of_spark_ml(heated):
    own = {r["meter_id"]: r["rmse"] for r in models.regression_metrics(models.forest_fit(heated)).collect()}
    for meter in ("1", "2"):
        assert own[meter] == pytest.approx(errors_of_ml(heated.filter(F.col("meter_id") == meter), 100), rel=0.02)


def test_odd_keys(make, spark):
    rows = [("a", h, h % 7) for h in range(50)] + [(None, h, 50 + h % 5) for h in range(50)] + [("b", 1, 4), ("", 2, 3), ("n", 1, float("nan"))]
    df = make(rows).withColumn("outdoor_temp", F.when(F.hour("ts") == 5, float("nan")).otherwise(F.hour("ts") * 1.0))
    out = models.forest_fit(df, trees=10)
    assert out.columns == [*df.columns, "yhat"] and out.filter("yhat is null or isnan(yhat)").count() == 0
    counts = {r[0]: r[1] for r in out.groupBy("meter_id").count().collect()}
    assert counts == {"a": 48, None: 48, "b": 1, "": 1}  # hours 5 and 29 have no temperature
    named = models.forest_fit(df, [None, "b"], trees=10)
    assert {r[0] for r in named.select("meter_id").distinct().collect()} == {None, "b"}
    assert rows_of(named) == rows_of(out.filter("meter_id is null or meter_id = 'b'"))
    assert models.forest_fit(df.limit(0)).count() == 0
    table = models.model_comparison(df.filter("meter_id is null or meter_id = 'a'"), [None], max_lag=3, trees=5)
    assert {(r["meter_id"], r["model"]) for r in table.collect()} == {(None, "linear"), (None, "forest"), ("a", "linear")}


def test_jobs_do_not_grow_with_keys(spark, make):
    def jobs(keys):
        df = make([(f"m{k}", h, (h * k) % 11) for k in range(keys) for h in range(24)]).withColumn("outdoor_temp", F.hour("ts") * 1.0)
        spark.sparkContext.setJobGroup(f"forest-{keys}", "")
        models.forest_fit(df, trees=3).collect()
        found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"forest-{keys}"))
        spark.sparkContext.setJobGroup("other", "")
        return found

    few, many = jobs(2), jobs(60)
    assert 0 < many <= few + 2
