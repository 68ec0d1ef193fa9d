import sentencepiece

from wattline.llm.queries import QUERIES, piece_model
from wattline.llm.token_counts import count_tokens

TEXTS = [
    None, "", " ", "   ", "a", "hello world", " lead", "trail ", "two  blanks   three", "line\nbreaks\n\n here ",
    "▁ literal ▁▁x", "<s> tags </s> <unk>", "emoji \U0001f600 and \u0000 zero", "word " * 3000,
    "x" * 20000, "Straße été niño", "\t tabs\t", "a" + " " * 40 + "b",
]


def test_counts_are_the_librarys(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    rows = [(i, t, "clash", 5) for i, t in enumerate(TEXTS)] + [(1, "", "clash", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, _text int")
    out = count_tokens(df, piece_model())
    got = sorted((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in out.collect())
    want = []
    for i, t, *_ in rows:
        n = len(library.encode(t or ""))
        want.append((i, len((t or "").encode()), n, n > 4096))
    assert got == sorted(want)
    assert count_tokens(df.limit(0), piece_model()).count() == 0


def test_query_over_the_table(spark, sf):
    library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    for row in QUERIES["op7_token_counts"](spark, sf).collect():
        assert row["n_tokens"] == len(library.encode(texts[row["doc_id"]] or ""))
