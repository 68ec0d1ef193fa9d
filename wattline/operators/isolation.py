"""Isolation forest per key.

Trees see small random samples, so a key needs few of its rows: a pool of about `trees * sample`
readings, drawn by hash, whatever the length of the series.  Only that pool is grouped by key.  In
Python the trees of a key are merged into one step function, mean path length by value.  Scoring is
relational: the distinct values of a key are ordered together with the steps and take the last step
before them.  Short keys, whose trees see all their readings, are many: their trees grow together, some
thousands of readings at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.plans.attach import attach
from wattline.plans.missing import nan_is_missing
from wattline.plans.percentiles import percentile_name, percentiles
from wattline.plans.scale import Scale, dealt_out, measure
from wattline.plans.series import running
from wattline.schema import KEYS, TS, VALUE
from wattline.session import cut_lineage
#: Readings of short keys whose trees grow together.
ROWS = 10_000


def mean_path(n: float) -> float:
    """Mean depth of an unsuccessful search in a binary tree of `n` values."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def _uniform(*parts: Column) -> Column:
    """Number in [0, 1) that depends on the row only, so retried tasks draw the same sample."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / float(1 << 52)


def draw_pool(
    df: DataFrame, trees: int, sample: int, seed: int, keys: Sequence[str], ts: str, value: str, scale: Scale
) -> DataFrame:
    """Readings (key, ts, value, size of the key) the trees draw from: all of a short key, a random part of a long one.

    Copies of a reading count once; they are combined before the shuffle and cannot fill a group.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*keys, ts, F.col(value).cast("double").alias("_v"))
    wanted = trees * sample
    if scale.largest > wanted:
        sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
        draw = _uniform(*[F.col(k) for k in keys], F.col(ts), F.col("_v"), F.lit(seed))
        rows = attach(rows, sizes, keys, scale).filter(draw * F.col("_n") < wanted)
    else:
        rows = rows.withColumn("_n", F.lit(0).cast("bigint"))  # every key is short
    return rows.dropDuplicates([*keys, ts, "_v"])


# fixed values: modulus and multipliers of the draws (any engine's 64-bit integers can make them)
_MODULUS, _FIRST, _SECOND = 2147483647, 48271, 69621


def absorbed(state: np.ndarray | int, part: np.ndarray | int) -> np.ndarray | int:
    """A number below 2**31 that depends on `state` and `part` (both below 2**31), a hash step."""
    x = (state + part) * _FIRST % _MODULUS
    x = (x ^ (x >> 15)) * _SECOND % _MODULUS
    return x ^ (x >> 13)


def key_number(key: tuple, seed: int) -> int:
    """What the draws of a key start from: seven hex digits of its md5, and the seed."""
    text = "\x1f".join(str(part) for part in key)
    return int(hashlib.md5(text.encode(), usedforsecurity=False).hexdigest()[:7], 16) + seed


def sample_places(n: int, trees: int, sample: int, own: int) -> np.ndarray:
    """Which of `n` readings each tree sees (trees x min(sample, n)).

    The readings are put in a random order and dealt out to as many trees as they suffice for; then
    another order serves the next trees.
    """
    size = min(sample, n)
    hands = max(1, n // size)
    picks = []
    for deal in range(-(-trees // hands)):
        drawn = absorbed(absorbed(absorbed(0, own), deal), np.arange(n))
        picks.append(np.argsort(drawn, kind="stable")[: hands * size].reshape(hands, size))
    return np.concatenate(picks)[:trees]


def cut_shares(tree: np.ndarray, node: np.ndarray, own: int) -> np.ndarray:
    """Where in [0, 1) between its least and largest value a node (1 is the root, children 2k and 2k + 1) is cut."""
    return absorbed(absorbed(absorbed(1, own), tree), node) / 2147483648.0


def grow_steps(values: np.ndarray, trees: int, sample: int, own: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean path length by value over the trees of one key: boundaries, and the level before and after each.

    All trees grow together, level by level: a segment of a tree's sorted sample is cut at a uniform point
    between its ends until it is deep, single or constant.
    """
    size = min(sample, len(values))
    limit = int(np.ceil(np.log2(max(size, 2))))
    picks = sample_places(len(values), trees, sample, own)
    grid = np.sort(values[picks], axis=1)
    levels = np.unique(values)
    flat = (np.arange(trees)[:, None] * len(levels) + np.searchsorted(levels, grid)).ravel()
    rest = np.array([mean_path(n) for n in range(size + 1)])
    tree, node, lo, hi, depth = np.arange(trees), np.ones(trees, np.int64), np.zeros(trees, np.int64), np.full(trees, size), 0
    leaves, cuts = [], []
    while len(tree):
        first, last = grid[tree, lo], grid[tree, hi - 1]
        stop = (hi - lo <= 1) | (first == last) | (depth >= limit)
        leaves.append((tree[stop], lo[stop], depth + rest[(hi - lo)[stop]]))
        tree, node, lo, hi, first, last = (x[~stop] for x in (tree, node, lo, hi, first, last))
        at = first + (last - first) * cut_shares(tree, node, own)
        place = np.searchsorted(levels, at, side="right") - 1
        cut = np.searchsorted(flat, tree * len(levels) + place, side="right") - tree * size
        cut = np.clip(cut, lo + 1, hi - 1)
        cuts.append((tree, cut, at))
        node = np.concatenate((2 * node, 2 * node + 1))
        tree, lo, hi = np.concatenate((tree, tree)), np.concatenate((lo, cut)), np.concatenate((cut, hi))
        depth += 1
    tree, lo, path = (np.concatenate(x) for x in zip(*leaves))
    order = np.lexsort((lo, tree))
    lo, path = lo[order], path[order]
    inner = np.flatnonzero(lo > 0)  # leaves after the first one of a tree, each behind its own cut
    tree, cut, at = (np.concatenate(x) for x in zip(*cuts))
    at, jump = at[np.lexsort((cut, tree))], path[inner] - path[inner - 1]
    order = np.argsort(at, kind="stable")
    level = path[lo == 0].sum() + np.concatenate([[0.0], np.cumsum(jump[order])])
    return at[order], level / trees


def grow_short(values: np.ndarray, starts: np.ndarray, trees: int, own: np.ndarray) -> np.ndarray:
    """Mean path length of every value over the trees of its key, for many short keys at once.

    `values` are sorted within each key, which begins at `starts` and has the number `own`.  Every tree of such
    a key sees all its readings, so the trees differ by their cuts only.  All trees of all keys grow together.
    """
    sizes = np.diff(np.append(starts, len(values)))
    limit = np.array([int(np.ceil(np.log2(max(n, 2)))) for n in range(sizes.max() + 1)])[sizes]
    rest = np.array([mean_path(n) for n in range(sizes.max() + 1)])
    key, tree = np.repeat(np.arange(len(starts)), trees), np.tile(np.arange(trees), len(starts))
    node, lo, hi, depth = np.ones(len(key), np.int64), starts[key], (starts + sizes)[key], 0
    total = np.zeros(len(values))
    while len(key):
        first, last = values[lo], values[hi - 1]
        stop = (hi - lo <= 1) | (first == last) | (depth >= limit[key])
        held = (hi - lo)[stop]
        reached = np.arange(held.sum()) + np.repeat(lo[stop] - np.cumsum(held) + held, held)
        total += np.bincount(reached, np.repeat(depth + rest[held], held), len(values))
        key, tree, node, lo, hi, first, last = (x[~stop] for x in (key, tree, node, lo, hi, first, last))
        at = first + (last - first) * cut_shares(tree, node, own[key])
        cut, end = lo.copy(), hi.copy()  # by bisection, behind the last value that is not above the cut
        while (cut < end).any():
            middle = (cut + end) // 2
            below = (cut < end) & (values[np.minimum(middle, len(values) - 1)] <= at)
            cut, end = np.where(below, middle + 1, cut), np.where(below, end, middle)
        cut = np.clip(cut, lo + 1, hi - 1)
        key, tree, node = np.concatenate((key, key)), np.concatenate((tree, tree)), np.concatenate((2 * node, 2 * node + 1))
        lo, hi = np.concatenate((lo, cut)), np.concatenate((cut, hi))
        depth += 1
    return total / trees


def _numbered_keys(columns: list[pa.ChunkedArray], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's key, and the first row of each key."""
    code = np.zeros(rows, np.int64)
    for column in columns:
        found = column.combine_chunks().dictionary_encode("encode")
        code = np.unique(code * len(found.dictionary) + found.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    _, first, number = np.unique(code, return_index=True, return_inverse=True)
    return number, first


def _as_before(column: pa.ChunkedArray, row: int):
    """A part of a key as pandas gives it, which its draws are made of."""
    part = column[row].as_py()
    return column.slice(row, 1).to_pandas().iloc[0] if part is None else part


def fit_steps(
    pool: DataFrame, trees: int, sample: int, seed: int, keys: Sequence[str], ts: str, buckets: int = 1
) -> DataFrame:
    """Path lengths of every key.  Keys are dealt out to `buckets`, whose short keys grow their trees together.

    A key whose pool holds all its readings gets one row for each distinct value (`_kind` -1: valid at
    that value); a longer one the steps between values (`_kind` 1: valid above it).
    """
    names = list(keys)
    wanted = trees * sample

    def fit(table: pa.Table) -> pa.Table:
        number, firsts = _numbered_keys([table.column(k) for k in names], len(table))
        own = np.array([key_number(tuple(_as_before(table.column(k), row) for k in names), seed) for row in firsts.tolist()])
        values, moment = table.column("_v").to_numpy(), table.column(ts).combine_chunks()
        sizes, whole = np.bincount(number), table.column("_n").to_numpy()[firsts] <= wanted
        short = whole & (sizes <= sample)
        out = []  # key, value, path, kind
        order = np.lexsort((values, number))
        order = order[short[number[order]]]
        every = np.cumsum(sizes[short])
        while len(order):
            # as many keys as have some ten thousand readings
            taken = max(1, int(np.searchsorted(every, every[0] + ROWS)))
            at, order = order[: every[taken - 1]], order[every[taken - 1] :]
            every = every[taken:] - every[taken - 1]
            k, v = number[at], values[at]
            starts = np.flatnonzero(np.diff(k, prepend=-1))
            path = grow_short(v, starts, trees, own[k[starts]])
            fresh = np.ones(len(v), bool)
            fresh[1:] = (k[1:] != k[:-1]) | (v[1:] != v[:-1])
            out.append((k[fresh], v[fresh], path[fresh], np.full(fresh.sum(), -1, np.int32)))
        for k in np.flatnonzero(~short):
            # the draw depends on the key and its readings, not on the order of arrival
            at = np.flatnonzero(number == k)
            own_rows = pa.table({"ts": moment.take(pa.array(at)), "v": values[at]})
            v = own_rows.sort_by([("ts", "ascending"), ("v", "ascending")]).column("v").to_numpy()
            bounds, level = grow_steps(v, trees, sample, int(own[k]))
            if whole[k]:
                v = np.unique(v)
                path, kind = level[np.searchsorted(bounds, v)], -1
            else:
                v, path, kind = np.concatenate([[-np.inf], bounds]), level, 1
            out.append((np.full(len(v), k), v, path, np.full(len(v), kind, np.int32)))
        k, v, path, kind = (np.concatenate(x) for x in zip(*out))
        found = [table.column(name).combine_chunks().take(pa.array(firsts[k])) for name in names]
        return pa.table([*found, pa.array(v), pa.array(path), pa.array(kind)], names=[*names, "_v", "_path", "_kind"])

    fields = [pool.schema[name] for name in names]
    schema = T.StructType(
        [
            *fields,
            T.StructField("_v", T.DoubleType()),
            T.StructField("_path", T.DoubleType()),
            T.StructField("_kind", T.IntegerType()),
        ]
    )
    bucket = F.pmod(F.xxhash64(*names), F.lit(buckets)).alias("_bucket")
    dealt = dealt_out(pool.select(bucket, *names, ts, "_v", "_n"), ["_bucket"], buckets, 16)
    return dealt.groupBy("_bucket").applyInArrow(fit, schema)


def _buckets(df: DataFrame, scale: Scale) -> int:
    """Groups of keys: some 256 short keys or 200,000 readings each, and enough of them for the session's tasks."""
    wanted = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(4 * wanted, -(-scale.keys // 256), -(-scale.rows // 200_000))


@nan_is_missing
def isolation_scores(
    df: DataFrame,
    trees: int = 100,
    sample: int = 256,
    seed: int = 42,
    keys: Sequence[str] = KEYS,
    ts: str = TS,
    value: str = VALUE,
    scale: Scale | None = None,
) -> DataFrame:
    """Score in (0, 1) of every distinct value of a key, with its number of rows; 1 is isolated."""
    scale = scale or measure(df, keys)
    pool = draw_pool(df, trees, sample, seed, keys, ts, value, scale)
    steps = fit_steps(pool, trees, sample, seed, keys, ts, _buckets(df, scale))
    values = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.count("*").alias("_rows"))
    )
    # a path of the very value comes before it; a step at the same value after it, as it holds above
    line = values.withColumn("_path", F.lit(None).cast("double")).withColumn("_kind", F.lit(0)).unionByName(
        steps.withColumn("_rows", F.lit(None).cast("bigint"))
    )
    longest = replace(scale, largest=scale.largest + trees * sample)
    known = running(
        line, {"_known": ("last", F.col("_path"))}, keys, ["_v", "_kind"], scale=longest
    )
    sizes = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("_n"))
    scored = attach(known.filter("_kind = 0"), sizes, keys, scale)
    m = F.least(F.col("_n"), F.lit(sample)).cast("double")
    longest_path = F.when(m > 2, 2.0 * (F.log(m - 1.0) + float(np.euler_gamma)) - 2.0 * (m - 1.0) / m).otherwise(1.0)
    # rounded, so that values with the same paths tie whatever the order of the sums
    score = F.round(F.pow(F.lit(2.0), -F.col("_known") / longest_path), 12)
    return scored.select(*keys, F.col("_v").alias(value), "_rows", score.alias("score"))


@nan_is_missing
def isolation_forest(
    df: DataFrame,
    trees: int = 100,
    contamination: float = 0.01,
    sample: int = 256,
    seed: int = 42,
    keys: Sequence[str] = KEYS,
    ts: str = TS,
    value: str = VALUE,
    scale: Scale | None = None,
) -> DataFrame:
    """Readings whose score lies strictly above the key's 1 - `contamination` percentile."""
    scale = scale or measure(df, keys)
    scores = cut_lineage(isolation_scores(df, trees, sample, seed, keys, ts, value, scale))
    q = 1 - contamination
    limits = percentiles(scores, "score", [q], keys, weight="_rows", scale=scale)
    odd = (
        attach(scores, limits, keys, scale)
        .filter(F.col("score") > F.col(percentile_name(q)))
        .select(*keys, value, "score")
    )
    found = replace(scale, keys=odd.count())
    return attach(df, odd, [*keys, value], found)
