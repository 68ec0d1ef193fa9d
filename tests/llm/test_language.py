import numpy as np

from wattline.llm import ftrl, language
from wattline.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op9_language_id"](spark, SF).join(docs, "doc_id").filter("held_out and lang is not null").collect()
    right = np.array([r["lang"] == r["lang_pred"] for r in rows])
    assert right.mean() > 0.97, right.mean()
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_rows(spark):
    rows = [(1, "hello there", "en"), (2, None, "en"), (3, "", None), (4, "123 !!", "de"), (5, "der die das", "de"), (6, "the " * 30_000, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    out = {r["doc_id"]: r for r in language.identify(df).collect()}
    assert out[6]["lang_pred"] == "en" and {out[k]["lang_pred"] for k in (2, 3, 4)} == {"und"}
    assert {r["lang_pred"] for r in language.identify(df.withColumn("lang", df.lang.substr(9, 1)).replace("", None)).collect()} == {"und"}
    assert language.identify(df.limit(0)).count() == 0


def test_fit_is_sparse_and_calibrated():
    rng = np.random.default_rng(0)
    kinds = rng.integers(0, 3, 600)
    rows = [(np.unique(np.r_[k, rng.integers(3, 200, 5)]), None) for k in kinds]
    rows = [(a, np.ones(len(a))) for a, _ in rows]
    w = ftrl.fit(rows, kinds, 200, 3, l1=2.0)
    assert (w == 0).mean() > 0.5
    assert np.mean([np.argmax(v @ w[a]) == k for (a, v), k in zip(rows, kinds)]) > 0.95
    logits = rng.normal(size=(4000, 3))
    truth = np.array([rng.choice(3, p=p) for p in ftrl.softmax(logits)])
    assert abs(ftrl.temperature(4 * logits, truth) - 4) < 0.5
