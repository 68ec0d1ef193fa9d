import random
import time

from wattline.llm import segmentation as S
from wattline.llm.queries import QUERIES, piece_model
from wattline.llm.token_counts import pre_tokens


def every(pieces, word):
    """All segmentations of a word with their scores."""
    out = [[] for _ in range(len(word) + 1)]
    out[0] = [(0.0, [])]
    for end in range(1, len(word) + 1):
        for start, piece, score in pieces.edges(word, end):
            out[end] += [(s + score, [*p, (start, piece)]) for s, p in out[start]]
    return sorted(((s, pieces.spelled(word, p)) for s, p in out[-1]), key=lambda x: -x[0])


def test_words_against_all_paths():
    pieces = S.Pieces(piece_model())
    words = ["▁the", "▁thndouha", "▁étre", "▁☃x\U0001f600", "▁", "▁▁▁a", "▁stupid,", "\n", "▁in\nof"]
    first, second, ids = pieces.best(words)
    for w, a, b, own in zip(words, first, second, ids):
        paths = every(pieces, w)
        assert a == paths[0][0] and (b == paths[1][0] if len(paths) > 1 else b < -1e17)
        assert [s for s, _ in pieces.n_best(w, 6)] == [s for s, _ in paths[:6]]
        assert (a, own.tolist()) in paths
    long = "▁" + "ab" * 200
    assert pieces.best([long])[0][0] == pieces.n_best(long, 1)[0][0]


def test_text_against_all_paths(spark):
    pieces = S.Pieces(piece_model())
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["an", "the", "of", "ths", "é", "x"]) for _ in range(rng.randrange(1, 4))) for _ in range(20)]
    texts += [None, "", " ", "a  b", "tail ", "line\n\nbreak", "☃ ☃", "word " * 20_000, "y" * 3000, "\U0001f600" * 30]
    df = spark.createDataFrame([(k, t, "c", 1) for k, t in enumerate(texts)], "doc_id long, text string, ids string, _text int")
    rows = {r["doc_id"]: r for r in S.decode(S.encode(df, piece_model(), n=5), piece_model()).collect()}
    for k, t in enumerate(texts):
        r = rows[k]
        assert r["decoded"] == (t or "")
        best = r["nbest"]
        if not t:
            assert r["ids"] == [] and [b["score"] for b in best] == [0.0]
            continue
        if len(t) < 15:
            whole = every(pieces, "▁" + t.replace(" ", "▁"))
            assert [b["score"] for b in best] == [s for s, _ in whole[:5]], t
        for b in best:  # the edits make paths of the scores they claim
            ids = list(r["ids"])
            for e in reversed(b["edits"]):
                ids[e["at"] : e["at"] + e["cut"]] = e["ids"]
            raw = b"".join(pieces.text[i] for i in ids)
            assert raw.decode() == " " + t
            if not any(i in set(pieces.byte) for i in ids):
                assert sum(pieces.scores[i] for i in ids) == b["score"]
    assert S.encode(df.limit(0), piece_model()).count() == 0


def test_no_piece_spans_words():
    assert pre_tokens("a  b ") == ["a", " b", ""]


def test_query(spark, sf):
    rows = QUERIES["op2_sentencepiece"](spark, sf).collect()
    assert rows and all(r["round_trip"] and r["scores"] == sorted(r["scores"], reverse=True) for r in rows)


def test_ties_do_not_fan_out():
    """Long words without blanks, random or of one letter: seconds, not hours; the best is what many words at once give."""
    pieces = S.Pieces(piece_model())
    rng = random.Random(4)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    for word in ("".join(rng.choice(letters) for _ in range(300_000)), "a" * 100_000, "ab" * 50_000):
        begun = time.process_time()
        found = pieces.n_best("▁" + word, 4)
        assert time.process_time() - begun < 30 and len(found) == 4
        assert [s for s, _ in found] == sorted((s for s, _ in found), reverse=True)
        for _, ids in found:
            assert b"".join(pieces.text[i] for i in ids).decode() == " " + word


def test_n_best_starts_with_the_path_of_best():
    pieces = S.Pieces(piece_model())
    rng = random.Random(6)
    words = ["▁" + "".join(rng.choice("abthe☃é/0") for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    first, second, ids = pieces.best(words)
    for word, one, two, own in zip(words, first, second, ids):
        found = pieces.n_best(word, 2)
        assert (found[0][0], found[0][1]) == (one, own.tolist()) and (len(found) == 1 or found[1][0] == two)
        assert len({tuple(p) for _, p in pieces.n_best(word, 6)}) == len(pieces.n_best(word, 6))


def test_memory_forgets_and_goes_on():
    memory = S._Memory(S.Pieces(piece_model()))
    rng = random.Random(1)
    texts = [[" ".join("".join(rng.choice("abcde") for _ in range(5)) for _ in range(200))] for _ in range(20)]
    old = S.REMEMBERED
    try:
        S.REMEMBERED = 1000
        for (text,) in texts:
            words = pre_tokens(text)
            memory.learn([words])
            ids, best = memory.encode(words, 3)
            assert memory.pieces.join(ids) == text and best[0][0] >= best[-1][0]
            fresh = S._Memory(memory.pieces)
            fresh.learn([words])
            assert fresh.encode(words, 3)[0].tolist() == ids.tolist()
    finally:
        S.REMEMBERED = old
