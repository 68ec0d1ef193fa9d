import random

import numpy as np
import pytest

from wattline.llm import decontamination as D


def brute(docs, items, size=10):
    windows = {}
    for name, text in items:
        w = D.plain_words(text)
        for s in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[s : s + size]), set()).add(name)
    out = {}
    for key, text in docs:
        w = D.plain_words(text)
        hit, names = set(), set()
        for k in {len(x) for x in windows}:
            for s in range(len(w) - k + 1):
                if found := windows.get(tuple(w[s : s + k])):
                    hit.update(range(s, s + k))
                    names |= found
        out[key] = (len(w), len(hit), sorted(str(n) for n in names if n is not None))
    return out


@pytest.fixture
def case():
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "B", "c1", "é", "dd", "of"])
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 3, 9, 10, 14, 30])))) for k in range(40)]
    items = [x for x in items if len(x[1].split()) > 2] + [(90, ""), (91, None), (92, "?!"), (None, "zz yy xx"), (0, "zz yy")]
    docs = [(k, " ".join(word() for _ in range(rng.randrange(0, 120)))) for k in range(60)]
    docs += [(100, None), (101, ""), (102, "... !"), (103, "ZZ, yy; XX"), (104, ("q " + items[0][1] + "! ") * 4000)]
    return docs + [(103, "ZZ, yy; XX")], items


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_brute_force(spark, case, block):
    docs, items = case
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in docs], "doc_id long, text string, spans int, _text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    rows = D.find_passages(df, bench, block_bytes=block).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r["n_words"], r["n_hit"], r["items"]) == want[r["doc_id"]], r["doc_id"]
    assert D.find_passages(df, bench.limit(0)).filter("n_hit > 0").count() == 0
    assert D.find_passages(df.limit(0), bench).count() == 0


def test_removal(spark):
    df = spark.createDataFrame([(1, "Keep é this. ZZ, yy; XX! and that", 7), (2, None, 7)], "doc_id long, text string, spans int")
    bench = spark.createDataFrame([(1, "zz yy xx")], "item_id long, text string")
    out = {r["doc_id"]: r for r in D.remove_passages(df, bench).collect()}
    assert out[1]["text"] == "Keep é this. ! and that" and out[1]["spans"] == 7 and out[2]["text"] is None


def test_index_counts_and_places():
    rng = np.random.default_rng(3)
    tokens = np.append(rng.integers(0, 5, 400), 0)
    index = D.FmIndex(tokens, 4)
    for k in (1, 2, 4):
        grid = rng.integers(1, 5, (50, k))
        low, high = index.search(grid, np.full(50, k))
        for p, a, b in zip(grid, low, high):
            real = [s for s in range(401 - k) if (tokens[s : s + k] == p).all()]
            assert sorted(index.locate(np.arange(a, b))) == real
