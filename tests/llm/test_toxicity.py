import itertools
import time

import numpy as np

from wattline.llm import toxicity as T
from wattline.llm.common import drawn
from wattline.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def test_held_out_and_disguised(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = QUERIES["op3_toxicity"](spark, SF).join(labels, "doc_id").filter("held_out").collect()
    toxic = np.array([r["toxic"] for r in rows])
    said = np.array([r["predicted"] for r in rows])
    assert (said[toxic == 1] == 1).mean() > 0.8, (said[toxic == 1] == 1).mean()
    assert (said[toxic == 0] == 0).mean() > 0.99
    spoken = [
        (-1, "what an 1d10t he is of them and the"), (-2, "of the i d i o t in the"), (-3, "the idiooooot of them"), (-4, "you m.o.r.o.n and"),
        (-5, "a pile of the and of them"), (-6, "the tr4sh in it"), (-7, "buy 3 for $5 on the 14 of it"),
    ]
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(spoken, "doc_id long, text string"))
    out = {r["doc_id"]: r for r in T.score_toxicity(more, labels).filter("doc_id < 0").collect()}
    assert [k for k in sorted(out) if out[k]["predicted"]] == [-6, -4, -3, -2, -1], {k: r["restored"] for k, r in out.items()}


def test_viterbi_is_the_cheapest_path():
    rng = np.random.default_rng(2)
    costs = T.letter_costs(rng.integers(0, 9, (T.SYMBOLS,) * 3).astype(float))
    channel = T.Channel(costs)

    def price(parts):
        total, a, b = 0.0, T.EDGE, T.EDGE
        for letters, cost in [*parts, (" ", 0.0)]:
            total += cost
            for x in letters:
                z = T.EDGE if x == " " else T._symbol(x)
                total += costs[a][b][z]
                a, b = b, z
        return total

    for span in ("1d10t", "a b c", "heeello", "l0$3r", "x-y-1"):
        best = min(itertools.product(*T.lattice(span)), key=price)
        found = channel.restore(span)
        assert found == "".join(x for x, _ in best).strip()


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "z" * 30_000), (3, "z" * 30_000), (None, "a b " * 9000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, restored int")
    labels = spark.createDataFrame([(1, 0), (2, 1), (9, None)], "doc_id long, toxic int")
    out = T.score_toxicity(df, labels).collect()
    assert len(out) == 5 and all(0 <= r["score"] <= 1 for r in out)
    assert {r["score"] for r in T.score_toxicity(df, labels.limit(0)).collect()} == {0.0}
    assert T.score_toxicity(df.limit(0), labels).count() == 0


def test_disguises_at_the_edges_of_words(spark):
    docs = spark.createDataFrame([(k, "the bad shit and the ass of it was good, all in all a fuck") for k in range(300)], "doc_id long, text string")
    channel = T.Channel(T.letter_costs(T.letter_counts(docs)))
    written = ["a$$", "a55", "shi7", "shi+", "5 h i t", "@ s s", "s  h\ti\n t", "fuuck", "good", "all"]
    assert [channel.clear(f"the {w} of").split() for w in written] == [
        ["the", w, "of"] for w in ("ass", "ass", "shit", "shit", "shit", "ass", "shit", "fuck", "good", "all")
    ]


def test_groups_of_two_letters(spark):
    docs = spark.createDataFrame([(k, "the bad shit and the ass of it was good, all in all a fuck, an idiot") for k in range(300)], "doc_id long, text string")
    channel = T.Channel(T.letter_costs(T.letter_counts(docs)))
    for written, word in (("id i ot", "idiot"), ("sh i t", "shit"), ("f-uc.k", "fuck"), ("i d i o t", "idiot")):
        assert word in channel.clear(f"the {written} of").split()
        assert T.numbers({word}) <= channel.features(f"the {written} of")


def test_long_signs_are_read_in_linear_time():
    channel = T.Channel(T.letter_costs(np.ones((T.SYMBOLS,) * 3)))
    for text in ("0 1 " * 250_000, "!" * 1_000_000, "a$$$" * 250_000, "a" + "$" * 1_000_000, "a b " * 250_000, ". " * 500_000, "ab c " * 200_000):
        begun = time.process_time()
        channel.features(text)
        channel.clear(text)
        assert time.process_time() - begun < 4  # some 0.5 s each; the search was quadratic


def test_terms_of_tokens_are_those_of_the_text():
    rng = np.random.default_rng(8)
    channel = T.Channel(T.letter_costs(rng.integers(1, 9, (T.SYMBOLS,) * 3).astype(float)))
    words = ["hello", "a$$", "b4d", "th!s", "soooo", "x", "y", "2nd", "end.", "é0ß", "ab", "!!", "(ok)", "_", "1"]
    for _ in range(200):
        text = " ".join(rng.choice(words, 12))
        told = {w for t in (text.lower(), channel.clear(text)) for w in T._WORD.findall(t)}
        assert [w for w in told if not T.numbers(T.terms({w})) <= channel.features(text)] == [], text
        asked = set(list(channel.features(text))[::2])
        assert T.Channel(np.array(channel.costs), asked).features(text) == asked


def test_repeated_keys_are_drawn_by_their_texts(spark):
    """A key of many rows is neither drawn whole nor lost whole, and equal rows count once."""
    df = spark.createDataFrame([(1, f"text {k}") for k in range(4000)] + [(2, "same")] * 4000, "key long, text string")
    taken = df.filter(drawn(400, 8000, "key", "text")).dropDuplicates(["key", "text"]).groupBy("key").count().collect()
    counts = {r["key"]: r["count"] for r in taken}
    assert 100 < counts[1] < 320 and counts.get(2, 0) <= 1
    assert df.filter(drawn(400, 10**18, "key", "text")).count() == 0 and df.filter(drawn(9000, 8000, "key")).count() == 8000
    assert 0 < spark.range(100_000).filter(drawn(12_000, 10**12, "id")).count() + 1  # a share below 1e-6 is still a share
