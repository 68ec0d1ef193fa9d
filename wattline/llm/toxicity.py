"""Toxicity of text behind leetspeak, spacing and repetition.

A noisy-channel model restores disguised words first.  Every character that may stand for others opens
a small lattice (a leet sign as the letters it looks like, a blank between single letters as nothing, a
letter written twice or more as one or two); the Viterbi path with the least cost under a letter trigram
model, counted over all documents, is the restored text.  Words of the restored text, and their first
letters, then go into a sparse logistic regression; a text is also at least as toxic as its most telling
word alone makes it, by the lower confidence bound of that word's share of toxic texts.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.llm import ftrl
from wattline.llm.common import drawn, filled, with_python

# fixed values: signs and the letters they look like
LEET = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t",
}
#: Costs, in nats, of the channel: a sign for a letter, a sign as it is; a blank between single letters
#: left out, the same kept; letters left out, one of a common pair left out.
SIGN, PLAIN, JOIN, SPLIT, REPEAT, PAIR = 1.0, 9.0, 0.2, 5.0, 1.0, 4.0
#: Symbols of the letter model: a to z, any other letter, the edge of a word.
OTHER, EDGE, SYMBOLS = 26, 27, 28
#: Labelled rows that the classifier is fitted on at most, and hashed features.
SAMPLE, BINS = 12_000, 1 << 22
#: Tokens and spans that one worker remembers; longer ones than LONG are read in stretches of that length.
REMEMBERED, LONG = 300_000, 64
#: In groups with units of two letters, joining costs more and keeping the blank less.
JOIN_PAIRS, SPLIT_PAIRS = 1.0, 3.0
_SIGNS = re.escape("".join(LEET))
_GAP = r"[\s.\-_*]++"
_ONE = rf"[^\W_{_SIGNS}]|[{_SIGNS}]"
# three or more units of one or two letters or signs with gaps between them; every step is possessive, so a
# run is read once whatever it holds
_SHORT = rf"(?:{_ONE}){{1,2}}+(?![{_SIGNS}]{{0,3}}[^\W_])"
_GROUP = re.compile(rf"(?<![^\W_])(?<![^\W_][{_SIGNS}]){_SHORT}(?:{_GAP}{_SHORT}){{2,}}+")
_RUN = re.compile(rf"[^\W_{_SIGNS}]*+(?:[{_SIGNS}]++[^\W_{_SIGNS}]*+)*+")
_UNIT = re.compile(rf"[^\s.\-_*]+")
#: ASCII bytes that no word holds and no sign is, as blanks.
_BLANKS = bytes(b if b > 127 or chr(b).isalnum() or chr(b) in LEET else 32 for b in range(256))
_LETTER, _TWICE, _SIGN = re.compile(r"[^\W\d_]"), re.compile(r"([^\W\d_])\1"), re.compile(rf"[{_SIGNS}]")
_WORD = re.compile(r"[^\W\d_]+")
_TABLE = np.full(0x110000, EDGE, np.uint8)
_TABLE[ord("a") : ord("z") + 1] = np.arange(26)
for _first, _last in ((0xDF, 0xF7), (0xF8, 0x250), (0x370, 0x2000)):
    _TABLE[_first:_last] = OTHER


def _symbol(letter: str) -> int:
    return int(_TABLE[ord(letter)])


def letter_counts(df: DataFrame, text: str = "text") -> np.ndarray:
    """How often each letter follows two others, over all texts of `df`; one small table a task is summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for value in batch.column("text"):
                s = _TABLE[np.frombuffer(f"  {value.as_py().lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)]
                s = s.astype(np.int32)
                total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    sums = df.select(filled(text).alias("text")).mapInArrow(count, "gram bigint, n bigint")
    out = np.zeros(SYMBOLS**3)
    for r in sums.groupBy("gram").agg(F.sum("n").alias("n")).collect():
        out[r["gram"]] = r["n"]
    return out.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


def letter_costs(counts: np.ndarray) -> np.ndarray:
    """Negative log probabilities of the third letter, trigrams backed by bigrams and single letters."""
    one = (counts.sum((0, 1)) + 1) / (counts.sum() + SYMBOLS)
    pairs = counts.sum(0)
    two = (pairs + 5 * one) / (pairs.sum(1, keepdims=True) + 5)
    three = (counts + 5 * two) / (counts.sum(2, keepdims=True) + 5)
    return -np.log(three)


def lattice(span: str, pairs: bool = False) -> list[list[tuple[str, float]]]:
    """What each place of a lower-cased span may stand for, with the cost in the channel.

    Runs of a letter, of a sign (from four on) and of gaps are one place.  `pairs`: the gaps are those of a
    group with units of two letters.
    """
    places: list[list[tuple[str, float]]] = []
    join, split = (JOIN_PAIRS, SPLIT_PAIRS) if pairs else (JOIN, SPLIT)
    k, size = 0, len(span)
    while k < size:
        c, run = span[k], k + 1
        if c in LEET or c.isalpha():
            while run < size and span[run] == c:
                run += 1
        else:
            while run < size and not (span[run] in LEET or span[run].isalpha()):
                run += 1
        if c in LEET:
            once = [(x, SIGN) for x in LEET[c]] + [(" ", PLAIN)]
            if run - k < 4:
                places += [once] * (run - k)
            else:
                places.append([*once, *[(x * 2, 2 * SIGN) for x in LEET[c]]])
        elif not c.isalpha():
            places.append([("", join), (" ", split)])
        elif run - k >= 3:
            places.append([(c, REPEAT), (c * 2, REPEAT), (c * (run - k), 0.0)])
        elif run - k == 2:
            places.append([(c, PAIR), (c * 2, 0.0)])
        else:
            places.append([(c, 0.0)])
        k = run
    return places


class Channel:
    """The decoder with its letter costs; short spans and tokens are remembered, a bounded number of them.

    `asked` limits the terms told of a text to those a classifier knows.
    """

    def __init__(self, costs: np.ndarray, asked: set[int] | None = None):
        self.costs, self.asked = costs.tolist(), asked
        self.known: dict[str, str] = {}
        self.terms: dict[bytes, tuple[int, ...]] = {}

    def restore(self, span: str, pairs: bool = False) -> str:
        """The cheapest reading of a span; a long one is read in stretches, so its cost grows with its length only."""
        if len(span) > LONG:
            return "".join(self.restore(span[k : k + LONG], pairs) for k in range(0, len(span), LONG))
        if span not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[span] = self._decoded(span, pairs)
        return self.known[span]

    def _decoded(self, span: str, pairs: bool) -> str:
        costs = self.costs
        paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(EDGE, EDGE): (0.0, None)}
        for options in [*lattice(span, pairs), [(" ", 0.0)]]:
            best: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            coded = [(letters, price, [EDGE if x == " " else _symbol(x) for x in letters]) for letters, price in options]
            for (a, b), (cost, path) in paths.items():
                for letters, price, symbols in coded:
                    total, x, y = cost + price, a, b
                    for z in symbols:
                        total += costs[x][y][z]
                        x, y = y, z
                    known = best.get((x, y))
                    if known is None or total < known[0]:
                        best[x, y] = (total, (path, letters))
            paths = best
        _, path = min(paths.values(), key=lambda p: p[0])
        parts = []
        while path is not None:
            path, letters = path
            parts.append(letters)
        return "".join(reversed(parts)).strip()

    def _group(self, span: str) -> str:
        """A group of units with gaps: read by the lattice if it has a letter."""
        if not _LETTER.search(span):
            return span
        return self.restore(span, any(len(unit) > 1 for unit in _UNIT.findall(span)))

    def _run(self, run: str) -> str:
        """A run of letters, digits and signs: read by the lattice if it has a letter, and a sign or a double letter."""
        if len(run) > 1 and (_SIGN.search(run) or _TWICE.search(run)) and _LETTER.search(run):
            return self.restore(run)
        return run

    def clear(self, text: str) -> str:
        """The lower-cased text with every disguised span restored."""
        low, parts, at = text.lower(), [], 0
        for m in _GROUP.finditer(low):
            parts += [low[at : m.start()], self._group(m.group(0))]
            at = m.end()
        parts.append(low[at:])
        return "".join(_RUN.sub(lambda m: self._run(m.group(0)), part) for part in parts)

    def _of_token(self, token: bytes) -> tuple[int, ...]:
        known = self.terms.get(token)
        if known is None:
            text = token.decode("utf-8", "surrogatepass")
            words = set(_WORD.findall(text))
            for run in filter(None, _RUN.findall(text)):
                restored = self._run(run)
                if restored is not run:
                    words.update(_WORD.findall(restored))
            known = numbers(terms(words))
            if self.asked is not None:
                known &= self.asked
            known = tuple(known)
            if len(token) <= LONG:
                if len(self.terms) >= REMEMBERED:
                    self.terms.clear()
                self.terms[token] = known
        return known

    def features(self, text: str) -> set[int]:
        """Numbers of the terms of a text: of its words as written, and of those restored.

        No run of letters and signs crosses a blank, so each distinct token is read once; groups across
        gaps are read besides.
        """
        low = text.lower()
        tokens = _tokens(low)
        for m in _GROUP.finditer(low):
            restored = self._group(m.group(0))
            if restored is not m.group(0):
                tokens |= _tokens(restored)
        return set(itertools.chain.from_iterable(filter(None, map(self._of_token, tokens))))


def _tokens(low: str) -> set[bytes]:
    return set(low.encode("utf-8", "surrogatepass").translate(_BLANKS).split())


def terms(words: set[str]) -> set[str]:
    """Words and their first four to six letters."""
    out = set()
    for w in words:
        out.add(w)
        if len(w) > 4:
            out.update((w[:4] + "*", w[:5] + "*"))
            if len(w) > 6:
                out.add(w[:6] + "*")
    return out


def numbers(features: set[str]) -> set[int]:
    return {zlib.crc32(f.encode("utf-8", "surrogatepass")) % BINS for f in features}


def _telling(rows: list[np.ndarray], toxic: np.ndarray, most: int = 20_000, z: float = 2.5) -> tuple[np.ndarray, np.ndarray]:
    """Features that tell the kinds apart by their likelihood ratio, beyond what chance among all gives,
    and Wilson's lower bound of the share of toxic texts among those that have them."""
    joined = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    size = np.array([len(r) for r in rows], np.int64)
    n = np.bincount(joined, minlength=BINS).astype(float)
    t = np.bincount(joined, np.repeat(toxic, size), minlength=BINS)
    base = toxic.mean()
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.nan_to_num(t * np.log(t / n / base)) + np.nan_to_num((n - t) * np.log((n - t) / n / (1 - base)))
    picked = np.flatnonzero((gain > 12) & (t / np.maximum(n, 1) > base))
    picked = picked[np.argsort(-gain[picked], kind="stable")][:most]
    n, p = n[picked], t[picked] / n[picked]
    bound = (p + z * z / (2 * n) - z * np.sqrt(p * (1 - p) / n + (z / (2 * n)) ** 2)) / (1 + z * z / n)
    return picked, bound


def score_toxicity(
    df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", learn: Column | None = None, sample: int = SAMPLE, cut: float = 0.7,
    keep_text: bool = True,
) -> DataFrame:
    """`df` with restored (the text as the channel reads it, if `keep_text`), score (0 to 1) and predicted (score >= `cut`).

    The letter model counts all texts of `df`; labels are learned only from rows where `learn` holds
    (all, if not given), at most about `sample` of them, chosen by a hash of key and text; equal rows count
    once.  Repeated labels of a key are averaged (toxic from one half).  Null and empty texts are restored to empty and scored like any
    text without a telling word, long texts are read whole, repeated rows stay; without labels of both
    kinds all scores are 0.  Columns with the new names are replaced.
    """
    costs = letter_costs(letter_counts(df, text))
    marks = labels.groupBy(F.col(key).alias("key")).agg((F.avg(label) >= 0.5).alias("mark")).filter("mark is not null")
    source = df.filter(learn) if learn is not None else df
    count = source.select(F.col(key).alias("key")).join(marks, "key").count()
    labelled = source.select(F.col(key).alias("key"), filled(text).alias("text"))
    taken = labelled.filter(drawn(sample, count, "key", "text")).dropDuplicates(["key", "text"]).join(marks, "key")
    channels: dict[str, Channel] = {}  # one a worker for learning, one for judging

    def build(batch: pa.RecordBatch) -> list[pa.Array]:
        if "all" not in channels:
            channels["all"] = Channel(costs)
        channel = channels["all"]
        return [pa.array([sorted(channel.features(t.as_py())) for t in batch.column("_text")], pa.list_(pa.int32()))]

    told = with_python(taken, {"_text": F.col("text")}, "bins array<int>", build).select("key", "mark", "bins")
    table = told.toArrow().sort_by("key") if count else None
    weights: dict[int, tuple[float, float]] = {}
    bias = -50.0
    if table is not None and table.num_rows:
        toxic = np.array(table["mark"].to_pylist(), bool)
        rows = [r.values.to_numpy() for r in table["bins"]]
        if 0 < toxic.sum() < len(toxic):
            picked, bound = _telling(rows, toxic)
            place = np.full(BINS, -1, np.int32)
            place[picked] = np.arange(len(picked))
            at = [np.append(p[p >= 0], len(picked)) for p in (place[r] for r in rows)]  # the last one is always there
            w = ftrl.fit([(a, np.ones(len(a))) for a in at], toxic.astype(np.int64), len(picked) + 1, 2, alpha=1.0, l1=0.1, epochs=15)
            line = w[:, 1] - w[:, 0]
            weights = {int(b): (float(x), float(y)) for b, x, y in zip(picked, line, bound)}
            bias = float(line[-1])

    def judge(batch: pa.RecordBatch) -> list[pa.Array]:
        scores, texts = [], []
        if "told" not in channels:
            channels["told"] = Channel(costs, set(weights))
        channel = channels["told"]
        for t in batch.column("_text"):
            t = t.as_py()
            found = [weights[k] for k in sorted(channel.features(t))]
            total = bias + sum(x for x, _ in found)
            scores.append(max(1 / (1 + np.exp(-np.clip(total, -50, 50))), *(y for _, y in found), 0.0) if weights else 0.0)
            if keep_text:
                texts.append(channel.clear(t))
        values = np.array(scores, float)
        judged = [pa.array(values), pa.array((values >= cut).astype(np.int32))]
        return [pa.array(texts, pa.string()), *judged] if keep_text else judged

    made = "restored string, score double, predicted int" if keep_text else "score double, predicted int"
    return with_python(df.drop("restored"), {"_text": filled(text)}, made, judge)
