import corpus_pipeline as P
from plain_versions import near_groups, passage_hits, repeats

from wattline.llm import quality


def test_each_stage_against_a_plain_one(spark, sf):
    read = lambda df: {r["doc_id"]: r for r in df.collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    start = read(docs)
    good = P.STAGES[0][1](spark, docs, sf).cache()
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    judged = {r["doc_id"]: r["predicted"] for r in quality.score_quality(docs, labels).collect()}
    kept = read(good)
    assert set(kept) == {k for k in start if judged[k]} and 0 < len(kept) < len(start)
    assert good.columns == docs.columns and all(kept[k] == start[k] for k in kept)

    single = P.STAGES[1][1](spark, good, sf).cache()
    least = near_groups([(k, r["text"]) for k, r in kept.items()], 5, 80)
    left = read(single)
    assert set(left) == {k for k in kept if least[k] == k} and all(left[k] == kept[k] for k in left)

    cut = P.STAGES[2][1](spark, single, sf).cache()
    want = repeats([(k, r["text"]) for k, r in left.items()])
    found = read(cut)
    assert cut.columns == docs.columns
    assert set(found) == {k for k in left if want[k] or not left[k]["text"]}
    assert all(r["text"] == want[k].decode(errors="replace") and r["n_chars"] == len(r["text"]) for k, r in found.items())

    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = P.STAGES[3][1](spark, cut, sf).cache()
    out = read(clean)
    hits = passage_hits([(k, r["text"]) for k, r in found.items()], bench)
    assert set(out) == set(found) and clean.columns == docs.columns
    for k, r in out.items():
        assert (r["text"] == found[k]["text"]) == (hits[k] == 0)

    last = P.STAGES[4][1](spark, clean, sf).collect()
    assert len(last) == len(out) and all(r["round_trip"] and r["n_pieces"] == len(r["ids"]) for r in last)
    assert {r["doc_id"]: r["text"] for r in P.run(spark, sf).collect()} == {k: r["text"] for k, r in out.items()}
