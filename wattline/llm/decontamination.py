"""Benchmark decontamination by an FM-index over each shard of the training text.

Every task indexes its shards in turn: the words that test phrases can be made of, in runs long enough
to hold one, become a sequence of word numbers; its suffixes are sorted, the last column goes into a
wavelet matrix, and all phrases are searched backwards at once.  Occurrences are located by walking to
the next sampled suffix position.  Their words are merged into spans to remove.  No shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm.common import LOWER, WORD, filled, slices, strings, text_bytes, with_python, word_hashes

#: A test set larger than this is searched in several rounds over the documents.
BLOCK_BYTES = 16 << 20
#: Every so many text positions keeps its suffix position.
SAMPLE = 8


@dataclass
class Phrases:
    """Distinct windows of one block of the test set, as numbers of its own words."""

    vocabulary: np.ndarray  # sorted word hashes; the number of a word is its place plus one
    grid: np.ndarray  # windows x longest, filled up with zeros
    lengths: np.ndarray
    item_at: np.ndarray  # the items of window k: items[item_at[k]:item_at[k + 1]]
    items: np.ndarray
    names: list[str | None]

    @classmethod
    def build(cls, rows: list[tuple[str | None, str]], size: int) -> Phrases:
        windows: dict[tuple[int, ...], set[int]] = {}
        texts = [text.encode() for _, text in rows]
        raw = np.frombuffer(b"".join(texts), np.uint8)
        bounds = np.cumsum([0, *map(len, texts)])
        hashes, row, *_ = word_hashes(raw, bounds, WORD)
        vocabulary, numbers = np.unique(hashes, return_inverse=True)
        at = np.searchsorted(row, np.arange(len(rows) + 1))
        for k in range(len(rows)):
            words = tuple((numbers[at[k] : at[k + 1]] + 1).tolist())
            for s in range(max(1, len(words) - size + 1) if words else 0):
                windows.setdefault(words[s : s + size], set()).add(k)
        keys = list(windows)
        grid = np.zeros((len(keys), size), np.int64)
        for k, words in enumerate(keys):
            grid[k, : len(words)] = words
        of = [sorted(windows[w]) for w in keys]
        return cls(
            vocabulary, grid, np.array([len(w) for w in keys], np.int64), np.cumsum([0, *map(len, of)]),
            np.array([k for ks in of for k in ks], np.int64), [name for name, _ in rows],
        )


def suffix_order(tokens: np.ndarray) -> np.ndarray:
    """All suffixes in order, by doubling the length of the compared prefixes."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: n - width] = rank[width:] + 1 if width < n else 0
        key = rank * (n + 2) + ahead
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.ones(n, bool)
        fresh[1:] = ordered[1:] != ordered[:-1]
        rank[order] = np.cumsum(fresh) - 1
        width *= 2
        if fresh.all() or width >= n:
            return order


class FmIndex:
    """Backward search and location over a sequence of numbers from 0 to `top`; phrases have no zeros."""

    def __init__(self, tokens: np.ndarray, top: int):
        order = suffix_order(tokens)
        last = tokens[order - 1]
        self.size = len(tokens)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(tokens, minlength=top + 1))))
        self.levels = []  # of the wavelet matrix, highest bit first: zeros before each place, all zeros
        for bit in range(int(top).bit_length() - 1, -1, -1):
            ones = (last >> bit) & 1
            zeros = np.concatenate(([0], np.cumsum(1 - ones))).astype(np.int32)
            self.levels.append((bit, zeros, int(zeros[-1])))
            last = np.concatenate((last[ones == 0], last[ones == 1]))
        sampled = (order % SAMPLE == 0) | (tokens[order - 1] == 0)  # no walk ever crosses a zero
        self.marks = np.concatenate(([0], np.cumsum(sampled))).astype(np.int32)
        self.samples = order[sampled]

    def _rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often `symbol` occurs in the last column before `place`."""
        start = np.zeros(len(place), np.int64)
        for bit, zeros, total in self.levels:
            one = (symbol >> bit) & 1 == 1
            before, first = zeros[place], zeros[start]
            place = np.where(one, total + place - before, before)
            start = np.where(one, total + start - first, first)
        return place - start

    def _back(self, row: np.ndarray) -> np.ndarray:
        """The row of the suffix that is one symbol longer."""
        symbol = np.zeros(len(row), np.int64)
        place, start = row, np.zeros(len(row), np.int64)
        for bit, zeros, total in self.levels:
            before = zeros[place]
            one = zeros[place + 1] == before
            first = zeros[start]
            symbol |= one.astype(np.int64) << bit
            place = np.where(one, total + place - before, before)
            start = np.where(one, total + start - first, first)
        return self.before[symbol] + place - start

    def search(self, grid: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of all phrases at once, taking their words from the last to the first."""
        low, high = np.zeros(len(grid), np.int64), np.full(len(grid), self.size, np.int64)
        for step in range(grid.shape[1]):
            live = np.flatnonzero((lengths > step) & (low < high))
            if not len(live):
                break
            symbol = grid[live, lengths[live] - 1 - step]
            low[live] = self.before[symbol] + self._rank(symbol, low[live])
            high[live] = self.before[symbol] + self._rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text positions of rows, by steps back to the next sampled one."""
        position = np.zeros(len(row), np.int64)
        open_, steps = np.arange(len(row)), 0
        while len(open_):
            at = row[open_]
            found = self.marks[at + 1] > self.marks[at]
            position[open_[found]] = self.samples[self.marks[at[found]]] + steps
            open_ = open_[~found]
            row = row.copy()
            row[open_] = self._back(row[open_])
            steps += 1
        return position


def _runs(flags: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last-plus-one of maximal runs of true flags; a run ends before a place in `breaks`."""
    cut = np.zeros(len(flags) + 1, bool)
    cut[breaks] = True
    start, stop = flags.copy(), flags.copy()
    start[1:] &= ~flags[:-1] | cut[1:-1]
    stop[:-1] &= ~flags[1:] | cut[1:-1]
    return np.flatnonzero(start), np.flatnonzero(stop) + 1


def _shard(raw: np.ndarray, bounds: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, ...]:
    """Of a shard: words of each row; located phrase and its first word; row, first byte, end of words."""
    hashes, row, first, end = word_hashes(raw, bounds, WORD)
    rows = len(bounds) - 1
    counts = np.bincount(row, minlength=rows)
    none = np.zeros(0, np.int64)
    if not len(hashes) or not len(phrases.grid):
        return counts, none, none, row, first, end
    place = np.searchsorted(phrases.vocabulary, hashes)
    place[place == len(phrases.vocabulary)] = 0
    known = phrases.vocabulary[place] == hashes
    starts, stops = _runs(known, np.flatnonzero(np.diff(row, prepend=-1)))
    long = stops - starts >= phrases.lengths.min()
    starts, stops = starts[long], stops[long]
    if not len(starts):
        return counts, none, none, row, first, end
    size = stops - starts + 1  # each run ends with a zero
    at = np.cumsum(size) - size
    origin = np.arange(int(size.sum())) + np.repeat(starts - at, size)
    inside = np.ones(len(origin), bool)
    inside[at + size - 1] = False
    tokens = np.zeros(len(origin), np.int64)
    tokens[inside] = place[origin[inside]] + 1
    index = FmIndex(tokens, len(phrases.vocabulary))
    low, high = index.search(phrases.grid, phrases.lengths)
    found = np.repeat(np.arange(len(low)), high - low)
    if not len(found):
        return counts, none, none, row, first, end
    rows_at = np.arange(len(found)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[found]
    return counts, found, origin[index.locate(rows_at)], row, first, end


def _lists(values: list[list], kind: pa.DataType) -> pa.Array:
    return pa.array(values, pa.list_(kind))


_SPAN = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
_SCHEMA = "n_words bigint, n_hit bigint, spans array<struct<start:int,stop:int>>, items array<string>"


def _merged(old: list[dict], new: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted([(s["start"], s["stop"]) for s in old] + new):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _step(phrases: Phrases):
    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        raw, bounds = strings(batch.column("_text"))
        earlier, listed = batch.column("_spans"), batch.column("_items")
        n_words, n_hit, spans, items = [], [], [], []
        for a, b in slices(bounds):
            base = bounds[a]
            counts, found, word, row, first, end = _shard(raw[base : bounds[b]], bounds[a : b + 1] - base, phrases)
            n_words.append(counts)
            change = np.zeros(len(row) + 1, np.int64)
            np.add.at(change, word, 1)
            np.add.at(change, word + phrases.lengths[found], -1)
            hit = np.cumsum(change[:-1]) > 0
            new: dict[int, list[tuple[int, int]]] = {}
            s, e = _runs(hit, np.flatnonzero(np.diff(row, prepend=-1)))
            for k, x, y in zip(row[s].tolist(), first[s].tolist(), end[e - 1].tolist()):
                new.setdefault(k, []).append((int(x + base - bounds[a + k]), int(y + base - bounds[a + k])))
            size = phrases.item_at[found + 1] - phrases.item_at[found]
            which = phrases.items[np.repeat(phrases.item_at[found], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
            pairs = np.unique(np.repeat(row[word], size) * len(phrases.names) + which)
            named: dict[int, set[str]] = {}
            for p in pairs.tolist():
                if (name := phrases.names[p % len(phrases.names)]) is not None:
                    named.setdefault(p // len(phrases.names), set()).add(name)
            hits = np.bincount(row[hit], minlength=b - a)
            for k in range(b - a):
                before = earlier[a + k].as_py()
                merged = _merged(before, new[k]) if k in new else [(x["start"], x["stop"]) for x in before]
                spans.append([{"start": x, "stop": y} for x, y in merged])
                items.append(sorted(named.get(k, set()).union(listed[a + k].as_py())))
                if before and k in new:  # words of merged spans, counted again
                    at = first[np.searchsorted(row, k) : np.searchsorted(row, k, "right")] + base - bounds[a + k]
                    hits[k] = sum(int(np.searchsorted(at, y) - np.searchsorted(at, x)) for x, y in merged)
                elif before:
                    hits[k] = batch.column("_hit")[a + k].as_py()
            n_hit.append(hits)
        joined = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (n_words, n_hit)]
        return [pa.array(joined[0], pa.int64()), pa.array(joined[1], pa.int64()), _lists(spans, _SPAN), _lists(items, pa.string())]

    return run


def find_passages(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", size: int = 10, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """`docs` with n_words, n_hit, spans (bytes to remove) and items (sorted ids of the items found).

    Words are runs of digits, lower-cased ASCII letters and other characters beyond ASCII.  A window is
    `size` consecutive words of an item; an item with fewer is one window; an item without any, none.
    The test set is read in blocks of about `block_bytes`, whatever its size, each searched over all
    documents; only a block is ever held by the driver and the tasks.  Null and empty texts have no words
    and no spans, very long ones make a shard of their own, repeated rows stay, items without an id are
    found but not listed, and empty tables give no hits.  Columns with the new names are replaced.
    """
    bench = benchmark.select(F.col(item).cast("string").alias("id"), filled(item_text).alias("text")).distinct()
    blocks = max(1, -(-text_bytes(bench, "text") // block_bytes))
    empty = (
        F.array().cast("array<struct<start:int,stop:int>>"), F.array().cast("array<string>"), F.lit(0).cast("bigint"),
    )
    out = docs
    for k in range(blocks):
        part = bench if blocks == 1 else bench.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k)
        phrases = Phrases.build([(r["id"], r["text"]) for r in part.collect()], size)
        spans, items, hit = (F.col("spans"), F.col("items"), F.col("n_hit")) if k else empty
        out = with_python(out, {"_text": filled(text), "_spans": spans, "_items": items, "_hit": hit}, _SCHEMA, _step(phrases))
    return out


def remove_passages(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """`docs` with their test passages cut out of `text`; the other columns as they were.

    Words of a passage and what stands between them go; null stays null.
    """
    found = find_passages(docs.select(F.struct("*").alias("row"), F.col(f"`{text}`").alias("text")), benchmark, **options)
    found = found.select("row", F.col("text").alias("_whole"), F.col("spans").alias("_cuts"))
    parts = F.transform(
        F.sequence(F.lit(0), F.size("_cuts")),
        lambda k: F.struct(
            F.when(k == 0, 0).otherwise(F.get(F.col("_cuts"), k - 1)["stop"]).alias("a"),
            F.coalesce(F.get(F.col("_cuts"), k)["start"], F.octet_length("_whole")).alias("b"),
        ),
    )
    whole = F.col("_whole").cast("binary")
    kept = F.aggregate(
        parts, F.lit("").cast("binary"), lambda acc, p: F.concat(acc, F.substring(whole, p["a"] + 1, p["b"] - p["a"]))
    )
    cut = F.when(F.size("_cuts") == 0, F.col("_whole")).otherwise(F.decode(kept, "UTF-8"))
    names = [c for c in docs.columns if c != text]
    return found.select(*[F.col("row").getField(c).alias(c) for c in names], cut.alias(text)).select(*docs.columns)


def plain_words(text: str | None) -> list[bytes]:
    """The words of one text; for tests."""
    low = bytes(LOWER[np.frombuffer((text or "").encode(), np.uint8)].tobytes())
    return re.findall(rb"[0-9a-z\x80-\xff]+", low)
