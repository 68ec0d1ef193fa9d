"""Token counts by the whole-token shortcut.

Every piece of the vocabulary has its blanks in front, so no merge ever joins the end of one word to the
blank of the next: a text falls into pre-tokens (blanks and what follows them) whose counts add up.
Which vocabulary strings encode alone as one token is proved once, offline, by encoding each of them.
Pre-tokens among these count one; only the rest are merged, once for each worker's bounded cache.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm.common import filled, with_python

#: Pre-tokens that one worker remembers; longer ones than LONGEST are merged anew each time.
REMEMBERED, LONGEST = 400_000, 48
_PRE_TOKEN = re.compile(r" ( *[^ ]+| *$)")


@functools.cache
def _proved(model: str) -> tuple[object, dict[str, int]]:
    """The encoder, and the pre-tokens (without the one blank in front) that are one token."""
    import sentencepiece

    encoder = sentencepiece.SentencePieceProcessor(model_file=model)
    pieces = [encoder.id_to_piece(i) for i in range(encoder.get_piece_size())]
    odd = [p for p in pieces if "▁" in p.lstrip("▁")]
    if odd:
        raise ValueError(f"pieces with a blank after other characters cannot be split at blanks: {odd[:5]}")
    blank = encoder.piece_to_id("▁")
    names = [p[1:].replace("▁", " ") for p in pieces if p.startswith("▁") and len(p) > 1]
    ids = encoder.encode(names, num_threads=1)
    whole = {name: 1 for name, tokens in zip(names, ids) if len(tokens) == 1}
    if blank != encoder.unk_id():
        whole[""] = 1  # a single blank at the end of a text
    return encoder, whole


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text that is not empty, each without its first blank."""
    text = text.replace("▁", " ")
    if "  " in text or text[0] == " " or text[-1] == " ":
        return _PRE_TOKEN.findall(" " + text)
    return text.split(" ")


class _Counter:
    def __init__(self, model: str):
        self.encoder, self.whole = _proved(model)
        self.known = dict(self.whole)

    def merged(self, words: list[str]) -> list[int]:
        return [len(tokens) for tokens in self.encoder.encode(words, num_threads=1)]

    def count(self, text: str) -> int:
        if not text:
            return 0
        words = pre_tokens(text)
        known = self.known
        rest = set(words).difference(known)
        if rest:
            if len(known) > REMEMBERED:
                self.known = known = dict(self.whole)
                rest = set(words).difference(known)
            rest = list(rest)
            known.update(zip(rest, self.merged(rest)))
        total = sum(map(known.__getitem__, words))
        for word in rest:
            if len(word) > LONGEST:
                del known[word]
        return total


@functools.cache
def _counter(model: str) -> _Counter:
    return _Counter(model)


def count_tokens(df: DataFrame, model: str, text: str = "text", limit: int = 4096) -> DataFrame:
    """`df` with n_bytes (UTF-8), n_tokens and over_limit (more than `limit` tokens).

    `model` is a SentencePiece BPE model file at the same path on every machine.  Counts are those of the
    library without begin or end tokens.  Null and empty texts have no bytes and no tokens; very long
    ones are counted whole; rows are never merged, so repeated rows stay; an empty table stays empty.
    Columns of `df` with the names of the new ones are replaced.  No shuffle.
    """

    def step(batch: pa.RecordBatch) -> list[pa.Array]:
        counter = _counter(model)
        counts = [counter.count(value.as_py()) for value in batch.column("_text")]
        return [pa.array(counts, pa.int64())]

    sized = with_python(df.drop("n_bytes", "over_limit"), {"_text": filled(text)}, "n_tokens bigint", step)
    return sized.withColumn("n_bytes", F.octet_length(filled(text)).cast("bigint")).withColumn(
        "over_limit", F.col("n_tokens") > limit
    )
