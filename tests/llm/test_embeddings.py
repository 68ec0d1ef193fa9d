import math

import numpy as np

from wattline.llm import embeddings as E
from wattline.llm.queries import QUERIES


def brute(rows, cosine=0.9):
    fit = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    n = len(rows)
    link = np.zeros((n, n), bool)
    for d in {len(v) for (_, v), f in zip(rows, fit) if f}:
        at = [i for i in range(n) if fit[i] and len(rows[i][1]) == d]
        x = np.array([rows[i][1] for i in at], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        link[np.ix_(at, at)] = x @ x.T >= cosine
    np.fill_diagonal(link, False)
    label = np.arange(n)
    while True:
        new = np.array([min([label[i], *label[link[i]]]) for i in range(n)])
        if (new == label).all():
            break
        label = new
    ids = [(1 << 63) if k is None else k for k, _ in rows]
    least = {c: min(ids[i] for i in range(n) if label[i] == c) for c in set(label)}
    return sorted(((k, int(link[i].sum()), None if least[label[i]] == 1 << 63 else least[label[i]]) for i, (k, _) in enumerate(rows)), key=str)


def result(df):
    return sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in df.collect()), key=str)


def test_brute_force(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 6)
    rng = np.random.default_rng(6)
    rows = []
    for c in range(30):
        centre = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 30))):
            rows.append((len(rows), [float(x) for x in centre + rng.choice([0.0, 0.15, 0.3]) * rng.normal(size=16)]))
    rows += [(900 + k, rows[k][1]) for k in range(0, 60, 2)]
    rows += [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (1004, [float("inf")] * 16), (1005, [None] * 16), (1006, [1.0, 2.0])]
    rows += [(1007, [2.0, 4.0]), (None, [1.0, 2.0]), (3, rows[3][1])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, kept int, signs string").repartition(3)
    assert result(E.near_vectors(df, miss=1e-6)) == brute(rows)
    assert E.near_vectors(df.limit(0)).count() == 0


def test_recall_on_the_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert result(QUERIES["op6_embedding_near_dedup"](spark, sf)) == brute(rows)


def test_plan_grows_slowly():
    assert E.plan(10_000, 0.9, 0.005)[0] < E.plan(10**6, 0.9, 0.005)[0]
    bits, tables = E.plan(50_000, 0.9, 0.005)
    assert 1 - (1 - (1 - math.acos(0.9) / math.pi) ** bits) ** tables > 0.994


def test_keys_join_nothing(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(3, 16))
    near = lambda c: [float(x) for x in c + 0.05 * rng.normal(size=16)]
    rows = [(1, near(centres[0])), (2, near(centres[1]))] + [(k, near(c)) for k in (None, 7) for c in centres]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert result(E.near_vectors(df, miss=1e-6)) == brute(rows)


def test_work_of_a_full_bucket_is_dealt_out(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(E, "BLOCK", 8)
    monkeypatch.setattr(E, "WORK", 64)
    compare, folder = E._compare, str(tmp_path)

    def watched(cosine):
        run = compare(cosine)

        def counted(table):
            with open(f"{folder}/{table.column('share')[0].as_py()}", "w") as out:
                out.write(str(len(table)))
            return run(table)

        return counted

    monkeypatch.setattr(E, "_compare", watched)
    rng = np.random.default_rng(2)
    centre = rng.normal(size=16)
    rows = [(k, [float(x) for x in centre + 0.05 * rng.normal(size=16)]) for k in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert result(E.near_vectors(df, miss=1e-6)) == brute(rows)
    sizes = [int(f.read_text()) for f in tmp_path.iterdir()]
    assert np.mean(sizes) < 100 and max(sizes) < 64 * 5


def test_numbers_of_any_size(spark):
    rows = [(1, [1e200, 0.0]), (2, [2e200, 0.0]), (3, [1e200, 1e200]), (4, [5e-324, 0.0]), (5, [1e-200, 1e-201]), (6, [1e308, 1e308]), (7, [-1e308, 1e308])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = result(E.near_vectors(df, miss=1e-6))
    assert got == [(1, 3, 1), (2, 3, 1), (3, 1, 3), (4, 3, 1), (5, 3, 1), (6, 1, 3), (7, 0, 7)]


def test_sketches_pass_near_pairs():
    """Pairs at the threshold all pass the screen, unrelated ones nearly never."""
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(2, 3000, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    near = 0.9 * a + math.sqrt(1 - 0.81) * b
    apart = lambda x, y: np.unpackbits(E.sketches(x) ^ E.sketches(y), axis=1).sum(1)
    assert apart(a, near).max() <= E.unlike(0.9) and (apart(a, b) <= E.unlike(0.9)).sum() == 0
