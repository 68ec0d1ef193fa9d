"""Quality scores by Bradley-Terry ranking.

A document beats another if people marked it good and the other bad.  The model gives each document a
strength, linear in its features; the chance that one beats the other is the logistic function of the
difference of their strengths, so the weights come from a logistic loss on feature differences.
Documents are kept above a quantile of the strengths of the labelled rows.

The loss is that of all pairs of a good and a bad labelled row.  A row's part in its gradient depends on the
row and, smoothly, on its strength against the strengths of the other kind; so one pass over the rows counts
these in narrow bins, and a second one sums the gradient and the curvature.  The work grows with the rows.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.llm.common import NOT_BLANK, filled, released, slices, stored, strings, with_python, word_hashes
from wattline.plans.percentiles import percentile_name, percentiles

#: Weight of the squared weights against the mean loss of a pair.
PENALTY = 1 / 200_000
#: Width of the bins that strengths are counted in, and bins that pairs are summed over, for slopes and for curvature.
WIDTH, BINS, CELLS = 1 / 256, 1024, 256
#: The score of a document right at the cut.
CUT = 0.3
_CLASSES = {
    "upper": np.isin(np.arange(256), np.arange(65, 91)),
    "digit": np.isin(np.arange(256), np.arange(48, 58)),
    "stop": np.isin(np.arange(256), [*b".,;:?'\""]),
    "shout": np.isin(np.arange(256), [*b"!"]),
    "symbol": np.isin(np.arange(256), [*b"#$%&*|<>{}[]@\\^~=+_/"]),
    "line": np.isin(np.arange(256), [10, 13]),
    "space": np.isin(np.arange(256), [9, 32]),
    "wide": np.arange(256) >= 128,
    "control": (np.arange(256) < 32) & ~np.isin(np.arange(256), [9, 10, 13]),
}
FEATURES = ["size", "words", *_CLASSES, "length", "spread", "distinct", "pairs", "echo", "capital", "closed"]


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def _distinct(row: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    order = np.lexsort((value, row))
    r, v = row[order], value[order]
    fresh = np.ones(len(r), bool)
    fresh[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
    return np.bincount(r[fresh], minlength=rows)


def describe(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows x features of whole texts: shares of kinds of bytes, word lengths, repetition, case."""
    rows = len(bounds) - 1
    size = np.diff(bounds)
    hashes, row, first, end = word_hashes(raw, bounds, NOT_BLANK)
    words = np.bincount(row, minlength=rows)
    length = (end - first).astype(float)
    mean = _ratio(np.bincount(row, length, rows), words)
    spread = np.sqrt(np.maximum(_ratio(np.bincount(row, length**2, rows), words) - mean**2, 0))
    same_row = row[1:] == row[:-1]
    pair = hashes[1:] * np.uint64(3) + hashes[:-1]
    echo = np.bincount(row[1:][same_row & (hashes[1:] == hashes[:-1])], minlength=rows)
    columns = [np.log1p(size), np.log1p(words)]
    for members in _CLASSES.values():
        inside = np.concatenate(([0], np.cumsum(members[raw])))
        columns.append(_ratio(inside[bounds[1:]] - inside[bounds[:-1]], size))
    columns += [
        np.log1p(mean), np.log1p(spread), _ratio(_distinct(row, hashes, rows), words),
        _ratio(_distinct(row[1:][same_row], pair[same_row], rows), words - 1), _ratio(echo, words - 1),
        _ratio(np.bincount(row, _CLASSES["upper"][raw[first]], rows), words),
        _ratio(np.bincount(row, _CLASSES["stop"][raw[end - 1]], rows), words),
    ]
    return np.stack(columns, 1)


def _described(batch: pa.RecordBatch) -> np.ndarray:
    raw, bounds = strings(batch.column("_text"))
    parts = [describe(raw[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]) for a, b in slices(bounds)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


def features(df: DataFrame, text: str = "text") -> DataFrame:
    """`df` with `features`, an array of doubles in the order of FEATURES; null texts count as empty."""

    def step(batch: pa.RecordBatch) -> list[pa.Array]:
        grid = _described(batch)
        return [pa.ListArray.from_arrays(np.arange(len(grid) + 1, dtype=np.int32) * len(FEATURES), pa.array(grid.ravel()))]

    return with_python(df, {"_text": filled(text)}, "features array<double>", step)


def _expanded(x: np.ndarray) -> np.ndarray:
    return np.concatenate((x, x**2), 1)


#: Numbered rows of sums.
Table = tuple[np.ndarray, np.ndarray]
Look = Callable[[np.ndarray, np.ndarray], tuple[Table, ...]]


def _added(tables: list[Table]) -> Table:
    """Rows of one number added up, in the order of their numbers."""
    keys, at = np.unique(np.concatenate([t[0] for t in tables]), return_inverse=True)
    sums = np.concatenate([t[1] for t in tables])
    return keys, np.stack([np.bincount(at, column, len(keys)) for column in sums.T], 1)


def _totals(found: list[tuple[Table, ...]]) -> tuple[Table, ...]:
    return tuple(_added(list(tables)) for tables in zip(*found))


class Labelled:
    """Labelled rows, looked at whole in every pass."""

    def __init__(self, x: np.ndarray, good: np.ndarray):
        self.x, self.good = x, good

    def look(self, look: Look) -> tuple[Table, ...]:
        """The sums that `look` makes of features and marks, over all rows; nothing if there are none."""
        return _totals([look(self.x, self.good)] if len(self.x) else [])

    def quantile(self, value: Callable[[np.ndarray], np.ndarray], share: float) -> float:
        return float(np.quantile(value(self.x), share))


class StoredLabelled(Labelled):
    """The same for a frame with `features` and `good`: tasks send their sums to the driver, never rows."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def look(self, look: Look) -> tuple[Table, ...]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = []
            for batch in batches:
                if batch.num_rows:
                    found = [_totals([*found, look(_grid(batch, "features"), batch.column("good").to_numpy(zero_copy_only=False))])]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found[0])], pa.binary())], names=["sums"])
            released()

        return _totals([pickle.loads(r["sums"]) for r in self.rows.mapInArrow(run, "sums binary").collect()])

    def quantile(self, value: Callable[[np.ndarray], np.ndarray], share: float) -> float:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(value(_grid(batch, "features")), pa.float64())], names=["value"])

        values = self.rows.mapInArrow(run, "value double").withColumn("all", F.lit(1))
        return percentiles(values, "value", [share], ["all"]).first()[percentile_name(share)]


def _grid(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).flatten().to_numpy().reshape(-1, len(FEATURES))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _binned(strength: np.ndarray, good: np.ndarray, width: float) -> Table:
    """By bin: bad and good rows, and the sums of their strengths."""
    keys, at = np.unique(np.floor(strength / width).astype(np.int64), return_inverse=True)
    is_good = good.astype(float)
    return keys, np.stack([np.bincount(at, w, len(keys)) for w in (1 - is_good, is_good, (1 - is_good) * strength, is_good * strength)], 1)


def _coarser(bins: Table, width: float, most: int) -> tuple[Table, float]:
    """Bins merged by twos until there are no more than `most`."""
    while len(bins[0]) > most:
        bins, width = _added([(bins[0] >> 1, bins[1])]), width * 2
    return bins, width


def _middles(bins: Table, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bad and good rows of the bins, and the means of their strengths."""
    keys, sums = bins
    means = [np.where(n > 0, total / np.maximum(n, 1), (keys + 0.5) * width) for n, total in zip(sums.T[:2], sums.T[2:])]
    return sums[:, 0], sums[:, 1], *means


@dataclass
class Ranking:
    """Strength weights, and the line from strengths to scores between 0 and 1."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float = 0.0
    slope: float = 1.0

    def _known(self, x: np.ndarray) -> np.ndarray:
        return _expanded(np.clip((x - self.mean) / self.scale, -8, 8))

    def strength(self, x: np.ndarray) -> np.ndarray:
        return (self._known(x) * self.weights).sum(1)  # a row's strength is the same in any batch

    @classmethod
    def fit(cls, x: np.ndarray, good: np.ndarray, quantile: float | None = None, penalty: float = PENALTY) -> Ranking | None:
        return cls.learn(Labelled(x, good), quantile, penalty)

    @classmethod
    def learn(cls, rows: Labelled, quantile: float | None = None, penalty: float = PENALTY) -> Ranking | None:
        """Fitted to all pairs of a good and a bad row; None without rows of both kinds.

        Numbers are rounded a little above the noise of sums in another order.
        """
        one = np.zeros(1, np.int64)
        first = rows.look(lambda x, good: ((one, np.array([[len(x), good.sum(), *x.sum(0)]])),))
        if not first or not 0 < first[0][1][0, 1] < first[0][1][0, 0]:
            return None
        n, wins, *total = first[0][1][0]
        mean = np.round(np.array(total) / n, 9)
        spread = rows.look(lambda x, good: ((one, ((x - mean) ** 2).sum(0)[None]),))[0][1][0]
        model = cls(mean, np.maximum(np.round(np.sqrt(spread / n), 9), 1e-6), np.zeros(2 * len(mean)))
        for _ in range(30):  # Newton steps on the penalised logistic loss
            step = model._step(rows, wins * (n - wins), penalty)
            model.weights = model.weights + step
            if np.abs(step).max() < 1e-6:
                break
        model.weights = np.round(model.weights, 6)
        squares = rows.look(lambda x, good: ((one, np.array([[(s := model.strength(x)).sum(), (s**2).sum()]])),))[0][1][0]
        spread = max(math.sqrt(max(squares[1] / n - (squares[0] / n) ** 2, 0)), 1e-9)
        model.cut = rows.quantile(model.strength, float((n - wins) / n) if quantile is None else quantile)
        model.slope = model._steepness(rows, spread)
        return model

    def _step(self, rows: Labelled, pairs: float, penalty: float) -> np.ndarray:
        """A Newton step from the present weights."""
        size = len(self.weights)
        bins, width = _coarser(rows.look(lambda x, good: (_binned(self.strength(x), good, WIDTH),))[0], WIDTH, BINS)
        lost, won, bad, good_ = _middles(bins, width)
        edges = np.unique(np.concatenate((bins[0], bins[0] + 1))) * width
        up = _logistic(bad - edges[:, None]) @ lost / pairs  # how much all bad rows push up a good one of this strength
        down = _logistic(edges[:, None] - good_) @ won / pairs
        cells, span = _coarser(bins, width, CELLS)
        lost, won, bad, good_ = _middles(cells, span)
        p = _logistic(good_[:, None] - bad)
        bend = p * (1 - p) / pairs  # of good rows of a cell against bad ones of another
        bends = np.stack((won @ bend, bend @ lost))

        def look(x: np.ndarray, good: np.ndarray) -> tuple[Table, Table]:
            z, kind = self._known(x), good.astype(np.int64)
            s = (z * self.weights).sum(1)
            push = np.where(good, np.interp(s, edges, up), -np.interp(s, edges, down))
            cell = np.searchsorted(cells[0], np.floor(s / span).astype(np.int64))
            curved = (z * bends[kind, cell][:, None]).T @ z
            return (np.zeros(1, np.int64), np.concatenate((push @ z, curved.ravel()))[None]), _added([(2 * cell + kind, z)])

        (_, sums), (place, z) = rows.look(look)
        gradient = sums[0, :size] - penalty * self.weights
        both = np.zeros((2 * len(cells[0]), size))
        both[place] = z
        across = both[1::2].T @ bend @ both[::2]
        hessian = sums[0, size:].reshape(size, size) - across - across.T + penalty * np.eye(size)
        return np.linalg.solve(hessian, gradient)

    def _steepness(self, rows: Labelled, spread: float) -> float:
        """How steeply the share of good rows rises with the strength."""
        width = spread / 1024
        lost, won, bad, good = _middles(rows.look(lambda x, good: (_binned(self.strength(x), good, width),))[0], width)
        s, n = np.concatenate((bad, good)) - self.cut, np.concatenate((lost, won))
        mark = np.repeat([0.0, 1.0], len(bad))
        slope = 2.0 / spread
        for _ in range(50):
            p = _logistic(slope * s + math.log(CUT / (1 - CUT)))
            slope += ((n * (mark - p)) @ s - 1e-3 * slope) / ((n * p * (1 - p)) @ s**2 + 1e-3)
            slope = float(np.clip(slope, 1e-3 / spread, 50 / spread))
        return float(f"{slope:.9g}")

    def score(self, x: np.ndarray) -> np.ndarray:
        return _logistic(self.slope * (self.strength(x) - self.cut) + math.log(CUT / (1 - CUT)))


def score_quality(
    df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", learn: Column | None = None,
    quantile: float | None = None, keep_text: bool = False,
) -> DataFrame:
    """`df` with score (0 to 1, higher: better) and predicted (1 if the score is at least CUT).

    `learn` says which rows of `df` may be learned from (all, if not given); all of those with a label are
    stored and fit the ranking, in passes whose sums meet on the driver.  The cut is the
    `quantile` of the strengths of these rows: by default the share marked bad.  Repeated labels of a key
    are averaged (good from one half).  Null and empty texts are scored like any other; without labels
    of both kinds every score is 0.5.  Other columns stay, those called score or predicted are replaced;
    the text goes unless `keep_text`.  The features are computed once for all rows and stored; with
    `keep_text` the scores come from a second look at the texts, so that these need not be stored too.
    """
    kept = [c for c in df.columns if c not in ("score", "predicted") and c != text]
    base = df.select(F.struct(*kept).alias("row"), F.col(key).alias("key"), filled(text).alias("text"), (learn if learn is not None else F.lit(True)).alias("learn"))
    known = stored(features(base).select("row", "key", "learn", "features"), "quality")
    marks = labels.groupBy(F.col(key).alias("key")).agg((F.avg(label) >= 0.5).alias("good")).filter("good is not null")
    rows = known.filter("learn").select("key", "features").join(marks, "key")
    model = Ranking.learn(StoredLabelled(stored(rows.select("features", "good"), "quality-labelled")), quantile)

    def judge(grid: np.ndarray) -> list[pa.Array]:
        scores = model.score(grid) if model else np.full(len(grid), 0.5)
        return [pa.array(scores), pa.array((scores >= CUT).astype(np.int32))]

    def step(batch: pa.RecordBatch) -> list[pa.Array]:
        return judge(_grid(batch, "_features"))

    if keep_text:

        def again(batch: pa.RecordBatch) -> list[pa.Array]:
            return judge(_described(batch))

        return with_python(df, {"_text": filled(text)}, "score double, predicted int", again)
    scored = with_python(known, {"_features": F.col("features")}, "score double, predicted int", step)
    return scored.select(*[F.col("row").getField(c).alias(c) for c in kept], "score", "predicted")

