"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Document frequencies cover every row that may be learned from; the weights are fitted on a bounded
sample of them by follow-the-regularised-leader with elastic-net penalties; a temperature set on rows
left out of the fit makes the scores honest.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.llm import ftrl
from wattline.llm.common import drawn, filled, with_python

#: Hashed n-grams, their sizes, rows that the weights are fitted on at most; more languages are an error.
BINS, SIZES, SAMPLE, LANGUAGES = 1 << 15, (1, 2, 3), 4000, 1000
UNKNOWN = "und"
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngrams(text: str) -> np.ndarray:
    """Bins of all n-grams of the lower-cased text, whatever is not a letter read as a blank; none
    without a letter."""
    codes = np.frombuffer(f"  {text.lower()}  ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return np.zeros(0, np.int64)
    codes = np.where(letter, codes, 32).astype(np.uint64)
    bins = []
    for size in SIZES:
        h = np.full(len(codes) - size + 1, size, np.uint64)
        for k in range(size):
            h += codes[k : len(codes) - size + 1 + k] * _FACTORS[k]
        h ^= h >> np.uint64(29)
        h *= _FACTORS[3]
        bins.append((h >> np.uint64(64 - int(math.log2(BINS)))).astype(np.int64))
    return np.concatenate(bins)


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Bins that occur, and how often."""
    found = np.bincount(ngrams(text), minlength=BINS)
    at = np.flatnonzero(found)
    return at, found[at]


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n = counts(text)
    value = (1 + np.log(n)) * idf[at]
    return at, value / max(float(np.sqrt((value**2).sum())), 1e-12)


def document_frequencies(df: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of the texts each bin occurs, and the number of texts with a letter."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(BINS, np.int64), 0
        for batch in batches:
            for text in batch.column("text"):
                at, _ = counts(text.as_py())
                total[at] += 1
                rows += bool(len(at))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1)), pa.array(np.append(total[at], rows))], names=["bin", "n"]
        )

    sums = df.mapInArrow(count, "bin bigint, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    found, rows = np.zeros(BINS), 0
    for r in sums:
        if r["bin"] < 0:
            rows = r["n"]
        else:
            found[r["bin"]] = r["n"]
    return found, rows


def identify(
    df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", learn: Column | None = None, sample: int = SAMPLE
) -> DataFrame:
    """`df` with lang_pred and score (the calibrated probability of that language).

    Learns from the rows where `learn` holds (all, if not given) and `lang` is not null: n-gram document
    frequencies from all of them, weights from about `sample` rows at most, an equal share of each
    language chosen by a hash of key and text, equal rows once; a fifth of these only sets the temperature.  Texts that
    are null, empty or without a letter get `und` and score 0, as all do when nothing can be learned; one
    language alone is predicted with score 1.  Long texts are read whole, repeated rows stay; columns
    lang_pred and score are replaced.
    """
    known = df.filter((learn if learn is not None else F.lit(True)) & F.col(lang).isNotNull()).select(
        filled(text).alias("text"), F.col(lang).alias("lang"), F.col(key).alias("key")
    )
    share = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGUAGES + 1).collect()}
    if len(share) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    names = sorted(share)
    weights, idf, heat = np.zeros((BINS, max(len(names), 1))), np.ones(BINS), 1.0
    if names:
        found, rows = document_frequencies(known.select("text"))
        idf = np.log((1 + rows) / (1 + found)) + 1
        chosen = F.lit(False)
        for name in names:
            chosen = F.when(F.col("lang") == name, drawn(max(1, sample // len(names)), share[name], "key", "text")).otherwise(chosen)

        def build(batch: pa.RecordBatch) -> list[pa.Array]:
            vectors = [vector(t.as_py(), idf) for t in batch.column("_text")]
            return [
                pa.array([a for a, _ in vectors], pa.list_(pa.int32())), pa.array([v for _, v in vectors], pa.list_(pa.float32())),
            ]

        rows_taken = known.filter(chosen).dropDuplicates(["key", "text", "lang"]).withColumn("draw", F.xxhash64("text", "key"))
        told = with_python(rows_taken, {"_text": F.col("text")}, "bins array<int>, vals array<float>", build)
        taken = told.select("lang", "draw", "bins", "vals").toArrow().sort_by([("draw", "ascending"), ("lang", "ascending")])
        number = {name: k for k, name in enumerate(names)}
        kinds = np.array([number[x.as_py()] for x in taken["lang"]], np.int64)
        pairs = [(a.values.to_numpy(), v.values.to_numpy().astype(float)) for a, v in zip(taken["bins"], taken["vals"])]
        aside = np.arange(len(pairs)) % 5 == 4
        fitted = [p for p, out in zip(pairs, aside) if not out and len(p[0])]
        fitted_kinds = kinds[[k for k, p in enumerate(pairs) if not aside[k] and len(p[0])]]
        weights = ftrl.fit(fitted, fitted_kinds, BINS, len(names))
        logits = np.array([v @ weights[a] for (a, v), out in zip(pairs, aside) if out]).reshape(-1, len(names))
        heat = ftrl.temperature(logits, kinds[aside])
    weights = weights.astype(np.float32)

    def predict(batch: pa.RecordBatch) -> list[pa.Array]:
        best, scores = [], []
        for t in batch.column("_text"):
            at, value = vector(t.as_py(), idf)
            if not len(at) or not names:
                best.append(UNKNOWN)
                scores.append(0.0)
                continue
            p = ftrl.softmax(value @ weights[at] / heat)
            best.append(names[int(p.argmax())])
            scores.append(float(p.max()))
        return [pa.array(best, pa.string()), pa.array(scores, pa.float64())]

    return with_python(df, {"_text": filled(text)}, "lang_pred string, score double", predict)
