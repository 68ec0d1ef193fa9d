import math
import random

import numpy as np

from wattline.llm import near_dedup as N
from wattline.llm.components import components
from wattline.llm.queries import QUERIES


def shingles(text, words):
    w = bytes(x + 32 if 65 <= x <= 90 else x for x in (text or "").encode()).split()
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set())


def brute(rows, words, percent):
    sets = [shingles(t, words) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            same = rows[i][0] is not None and rows[i][0] == rows[j][0]
            if (both and 100 * both >= percent * len(sets[i] | sets[j])) or same:
                root[find(i)] = find(j)
    group = {}
    big = 1 << 63
    for i, (k, _) in enumerate(rows):
        group.setdefault(find(i), []).append(big if k is None else k)
    least = [min(group[find(i)]) for i in range(len(rows))]
    return sorted(((k, len(s), None if m == big else m) for (k, _), s, m in zip(rows, sets, least)), key=str)


def test_brute_force(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 8)
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnopqrst") + rng.choice("uvwx")
    rows, k = [], 0
    for family in range(12):
        base = [word() for _ in range(rng.randrange(2, 90))]
        for _ in range(rng.randrange(1, 25)):
            copy = list(base)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((k, rng.choice([" ", "\n", "\t "]).join(copy)))
            k += 1
    rows += [(500, None), (501, ""), (502, " \n"), (503, "one"), (504, "ONE"), (505, "one two"), (506, "É é"), (507, "é é")]
    rows += [(None, "one"), (508, "big words here " * 20_000), (509, "big words here " * 20_001), (503, "one")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, kept int, node string")
    for words, percent in ((3, 85), (5, 80)):
        out = N.near_duplicates(df, words=words, percent=percent).collect()
        got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out), key=str)
        assert got == brute(rows, words, percent)
        assert all(r["kept"] == ((r["doc_id"] if r["doc_id"] is not None else None) == r["component_id"]) for r in out)
    left = N.keep_one(df, words=3, percent=85)
    assert left.columns == df.columns
    ids = {m for *_, m in brute(rows, 3, 85)}
    assert {r["doc_id"] for r in left.collect()} - {None} == ids - {None}
    assert N.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(200)] + [(5000 + i, 5000 + i + rng.choice([1, 2])) for i in range(0, 90, 3)] + [(7, 7)]
    rng.shuffle(edges)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[1000 + i] == 1000 for i in range(200))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shape_meets_the_miss():
    for percent, count in ((80, 10), (85, 10**6), (95, 10**10)):
        (i, a), (j, b) = N.shape(percent, 0.003, count)
        s = percent / 100
        assert (1 - (1 - s**i) ** a) * (1 - (1 - s**j) ** b) > 0.997
        assert i + j == max(5, round(math.log10(count)))


def test_query_on_documents(spark, sf):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in QUERIES["op8_minhash_near_dedup"](spark, sf).collect()), key=str)
    assert got == brute(rows, 3, 85)
    assert np.mean([m != k for k, _, m in got]) > 0


def test_keys_join_nothing(spark):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(4)]
    near = lambda b: " ".join([*b[:-1], f"w{rng.randrange(10**6)}"])
    whole = [" ".join(b) for b in base]
    rows = [(1, whole[0]), (2, whole[1]), (None, near(base[0])), (None, near(base[1])), (None, whole[0]), (None, whole[2]), (None, whole[2]), (None, near(base[2]))]
    rows += [(7, near(base[0])), (7, near(base[1])), (7, whole[3]), (7, whole[3]), (8, near(base[3])), (None, None), (None, ""), (9, " ")]
    df = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "doc_id long, text string, n int").repartition(3)
    got = {r["n"]: r["component_id"] for r in N.near_duplicates(df).collect()}
    assert [got[n] for n in range(len(rows))] == [1, 2, 1, 2, 1, None, None, None, 1, 2, 7, 7, 7, None, None, 9]
    left = {r["n"] for r in N.keep_one(df).collect()}
    assert {0, 1, 13, 14, 15} <= left and len(left & {5, 6, 7}) == 1 and len(left & {10, 11}) == 1 and len(left) == 7


def test_many_copies_without_a_key(spark, monkeypatch):
    monkeypatch.setattr(N, "_often", lambda count: 5, raising=False)
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    rows = [(None, " ".join(words))] * 300 + [(None, " ".join([*words[:-1], "other"]))] * 300 + [(None, f"one{n} two three four five") for n in range(50)]
    df = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "doc_id long, text string, n int").repartition(3)
    left = {r["n"] for r in N.keep_one(df).collect()}
    assert len(left) == 51 and set(range(600, 650)) <= left
