import numpy as np

from wattline.llm import quality as Q
from wattline.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    out = QUERIES["op1_quality_classifier"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = out.join(labels, "doc_id").filter("held_out").select("quality", "predicted", "score").collect()
    q = np.array([r["quality"] for r in rows])
    p = np.array([r["predicted"] for r in rows])
    assert (q == p).mean() > 0.95, (q == p).mean()
    assert ((p == 0) & (q == 0)).sum() / (q == 0).sum() > 0.8
    assert all((r["score"] >= 0.3) == (r["predicted"] == 1) for r in rows)


def test_ranking_orders_pairs():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 4))
    good = x[:, 1] - x[:, 2] + 0.3 * rng.normal(size=2000) > -0.8
    model = Q.Ranking.fit(x, good)
    assert ((model.score(x) >= 0.3) == good).mean() > 0.9
    kept = (Q.Ranking.fit(x, good, quantile=0.5).score(x) >= 0.3).mean()
    assert abs(kept - 0.5) < 0.01


def test_odd_rows(spark):
    rows = [(1, None, 9.0, "a"), (2, "", 9.0, "b"), (3, "x" * 50_000, 9.0, "c"), (None, "word word", 9.0, "d"), (3, "x" * 50_000, 9.0, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double, features string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 1), (3, None)], "doc_id long, quality int")
    out = Q.score_quality(df, labels).collect()
    assert len(out) == 5 and all(0 <= r["score"] <= 1 for r in out)
    assert sorted(r["features"] for r in out) == ["a", "b", "c", "c", "d"]
    assert {r["score"] for r in Q.score_quality(df, labels.limit(0)).collect()} == {0.5}
    assert Q.score_quality(df.limit(0), labels).count() == 0


def plain_fit(x, good):
    """Weights by Newton steps over every pair of a good and a bad row."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = Q._expanded(np.clip((x - mean) / scale, -8, 8))
    pairs = (z[good][:, None] - z[~good]).reshape(-1, z.shape[1])
    w = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(np.clip(pairs @ w, -30, 30)))
        bent = (pairs * (p * (1 - p))[:, None]).T @ pairs / len(pairs) + np.eye(len(w)) / 200_000
        w += np.linalg.solve(bent, pairs.T @ p / len(pairs) - w / 200_000)
    return w


def test_all_pairs_count():
    rng = np.random.default_rng(1)
    for rows, columns, noise in ((300, 4, 0.3), (200, 3, 0.0), (300, 5, 5.0)):
        x = rng.normal(size=(rows, columns))
        good = x[:, 1] - x[:, 2] + noise * rng.normal(size=rows) > -0.8
        want = plain_fit(x, good)
        assert np.abs(Q.Ranking.fit(x, good).weights - want).max() < 1e-5 * max(1, np.abs(want).max())


def test_all_labelled_rows_count(spark):
    n = 45_000  # more than were once fitted
    rng = np.random.default_rng(2)
    words = ["word", "Word", "wörd", "42", "!!", "a", "reading,", "of", "x_y"]
    texts = [" ".join(rng.choice(words, 3 + k % 9)) for k in range(n)]
    good = [len(t) + int(rng.integers(0, 40)) > 50 for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, int(g)) for k, g in enumerate(good)], "doc_id long, quality int").repartition(5)
    x = np.array([r["features"] for r in Q.features(df).orderBy("doc_id").collect()])
    want = Q.Ranking.fit(x, np.array(good))
    for keep in (True, False):
        got = Q.score_quality(df, labels, keep_text=keep).orderBy("doc_id").collect()
        assert np.abs(np.array([r["score"] for r in got]) - want.score(x)).max() < 1e-9
        assert abs(sum(r["predicted"] for r in got) - sum(good)) <= 1 + (np.abs(want.score(x) - Q.CUT) < 1e-9).sum()
