"""Random forests of one regressor for all keys at once.

With a single regressor a tree node is an interval of it, so all a tree needs are its sums per distinct
value of the regressor (a bin): weights and weighted targets of the bootstrap sample.  These come from
one pass, whatever the number of keys, trees and levels:

* a key of moderate length is one group, in which numpy draws the samples of all trees and sums them;
* a longer key is summed by (key, tree, bin) in a partial aggregation, so no task holds its rows, and
  each of its trees is one group of bins.

Both draw the same bootstrap: the weight of a row in a tree is a Poisson number made from a hash of the
row and the tree.  Trees then grow level by level, all nodes of a level at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from math import exp, factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.plans.attach import attach
from wattline.plans.scale import Scale, dealt_out, measure
from wattline.plans.series import running
from wattline.session import cut_lineage

#: Rows of a key that one group may hold.
GROUP_ROWS = 200_000
#: Numbers that one numpy step may hold.
STEP = 4_000_000

# fixed values: multipliers of the public xxHash64
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(x)
    for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
)
#: Chances of at most 0, 1, 2 ... draws of a row: Poisson with mean 1.
_AT_MOST = np.cumsum([exp(-1) / factorial(k) for k in range(13)])


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _ended(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _P2
    x = (x ^ (x >> np.uint64(29))) * _P3
    return x ^ (x >> np.uint64(32))


def row_tree_hash(rows: np.ndarray, trees: np.ndarray) -> np.ndarray:
    """Spark's `xxhash64(row, tree)` of bigint rows and int trees, as unsigned numbers (trees x rows)."""
    x = (np.uint64(42) + _P5 + np.uint64(8)) ^ (_turned(rows.astype(np.int64).view(np.uint64) * _P2, 31) * _P1)
    own = _ended(_turned(x, 27) * _P1 + _P4)[None, :]
    x = (own + _P5 + np.uint64(4)) ^ (trees.astype(np.uint64)[:, None] * _P1)
    return _ended(_turned(x, 23) * _P2 + _P3)


def bootstrap(rows: np.ndarray, trees: np.ndarray) -> np.ndarray:
    """How often each tree draws each row."""
    share = (row_tree_hash(rows, trees) & np.uint64((1 << 52) - 1)).astype(np.float64) / float(1 << 52)
    return np.searchsorted(_AT_MOST, share, side="right").astype(np.float64)


def _drawn(row: Column, tree: Column) -> Column:
    """`bootstrap` as a column."""
    share = F.pmod(F.xxhash64(row, tree), F.lit(1 << 52)) / float(1 << 52)
    steps = [F.when(share >= float(p), 1.0).otherwise(0.0) for p in _AT_MOST]
    total = steps[0]
    for step in steps[1:]:
        total = total + step
    return total


def grow(weight: np.ndarray, total: np.ndarray, max_depth: int) -> np.ndarray:
    """What each tree says of each bin, from its weights and weighted targets (trees x bins).

    A node is cut where the squared sums of its sides over their weights are largest, the first such place
    among equals; it stays whole at `max_depth`, or when no cut explains anything.  A tree without weight
    says NaN.
    """
    trees, bins = weight.shape
    start = np.zeros((trees, 1))
    w, s = (np.concatenate((start, np.cumsum(x, axis=1)), axis=1) for x in (weight, total))
    with np.errstate(divide="ignore", invalid="ignore"):
        least = 1e-12 * np.where(weight > 0, total * total / weight, 0.0).sum(axis=1)
    tree, lo, hi = np.arange(trees), np.zeros(trees, np.int64), np.full(trees, bins)
    leaves, depth = [], 0
    while len(tree):
        cuts = hi - lo - 1
        open_ = (cuts > 0) & (depth < max_depth)
        leaves.append((tree[~open_], lo[~open_], hi[~open_]))
        tree, lo, hi, cuts = (x[open_] for x in (tree, lo, hi, cuts))
        if not len(tree):
            break
        first = np.cumsum(cuts) - cuts
        node = np.repeat(np.arange(len(tree)), cuts)
        cut = lo[node] + 1 + np.arange(len(node)) - first[node]
        at = tree[node]
        w_left, s_left = w[at, cut] - w[at, lo[node]], s[at, cut] - s[at, lo[node]]
        w_right, s_right = w[at, hi[node]] - w[at, cut], s[at, hi[node]] - s[at, cut]
        with np.errstate(divide="ignore", invalid="ignore"):
            sides = s_left * s_left / w_left + s_right * s_right / w_right
            sides[(w_left <= 0) | (w_right <= 0)] = -np.inf
            whole = (s[tree, hi] - s[tree, lo]) ** 2 / (w[tree, hi] - w[tree, lo])
        best = np.maximum.reduceat(sides, first)
        hits = np.flatnonzero(sides == best[node])
        place = cut[hits[np.searchsorted(node[hits], np.arange(len(tree)))]]
        gains = best > whole + least[tree]
        leaves.append((tree[~gains], lo[~gains], hi[~gains]))
        tree, lo, hi, place = (x[gains] for x in (tree, lo, hi, place))
        tree, lo, hi = np.concatenate((tree, tree)), np.concatenate((lo, place)), np.concatenate((place, hi))
        depth += 1
    tree, lo, hi = (np.concatenate(x) for x in zip(*leaves))
    order = np.lexsort((lo, tree))
    tree, lo, hi = tree[order], lo[order], hi[order]
    with np.errstate(divide="ignore", invalid="ignore"):
        said = (s[tree, hi] - s[tree, lo]) / (w[tree, hi] - w[tree, lo])
    return np.repeat(said, hi - lo).reshape(trees, bins)


def _mean(said: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the trees with a say, and their number, per bin."""
    known = ~np.isnan(said)
    return np.where(known, said, 0.0).sum(axis=0), known.sum(axis=0)


def fit_group(bins: np.ndarray, target: np.ndarray, rows: np.ndarray, trees: int, max_depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct bins of a key and the forest's answer at each (0 without any drawn row)."""
    order = np.lexsort((target, rows, bins))  # sums do not depend on the order of arrival
    bins, target, rows = bins[order], target[order], rows[order]
    values, first = np.unique(bins, return_index=True)
    total, told = np.zeros(len(values)), np.zeros(len(values))
    step = max(1, STEP // len(bins))
    for tree in range(0, trees, step):
        weight = bootstrap(rows, np.arange(tree, min(trees, tree + step)))
        sums = [np.add.reduceat(x, first, axis=1) for x in (weight, weight * target)]
        part = _mean(grow(*sums, max_depth))
        total, told = total + part[0], told + part[1]
    return values, total / np.maximum(told, 1)


def binned(rows: DataFrame, max_bins: int | None, keys: Sequence[str], scale: Scale) -> DataFrame:
    """`rows` with `_bin`: the regressor itself, or its place among `max_bins` bins of about equally many rows."""
    if max_bins is None:
        return rows.withColumn("_bin", F.col("_x"))
    values = rows.groupBy(*keys, "_x").agg(F.count("*").alias("_k"))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_all"))
    upto = running(values, {"_upto": ("sum", F.col("_k"))}, keys, ["_x"], scale=scale)
    place = F.floor((F.col("_upto") - 1) * max_bins / F.col("_all")).cast("double")
    table = cut_lineage(attach(upto, sizes, keys, scale).select(*keys, "_x", place.alias("_bin")))
    return attach(rows, table, [*keys, "_x"], replace(scale, keys=table.count()))


def forest_answers(
    rows: DataFrame, y: str, trees: int, seed: int, max_depth: int, max_bins: int | None, keys: Sequence[str],
    group_rows: int = GROUP_ROWS, scale: Scale | None = None,
) -> DataFrame:
    """`rows` (with the regressor in `_x`) and `yhat`, the answer of their key's forest.

    Equal rows draw the same samples.  The number of Spark jobs does not depend on keys, trees or levels.
    """
    names = list(keys)
    scale = scale or measure(rows, keys)
    facts = rows.groupBy(*names).agg(F.avg(F.col(y).cast("double")).alias("_mean"), F.count("*").alias("_n"))
    ready = attach(binned(rows, max_bins, keys, scale), facts, keys, scale)
    identity = F.xxhash64(*[F.col(c) for c in names], "_x", F.col(y), F.lit(seed))
    if "ts" in rows.columns:
        identity = F.xxhash64(identity, F.col("ts"))
    slim = ready.select(*names, "_bin", (F.col(y).cast("double") - F.col("_mean")).alias("_y"), identity.alias("_h"), "_n")
    key_fields = [rows.schema[name] for name in names]
    number = lambda name: T.StructField(name, T.DoubleType())

    def framed(key: tuple, columns: dict) -> pd.DataFrame:
        out = pd.DataFrame(columns)
        for name, part in zip(reversed(names), reversed(key)):
            out.insert(0, name, part)
        return out

    def fit(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        values, said = fit_group(*(group[c].to_numpy() for c in ("_bin", "_y", "_h")), trees, max_depth)
        return framed(key, {"_bin": values, "_said": said})

    short = dealt_out(slim.filter(F.col("_n") <= group_rows), names, scale.keys).groupBy(*names).applyInPandas(fit, T.StructType([*key_fields, number("_bin"), number("_said")]))
    answers = short
    if scale.largest > group_rows:
        each = slim.filter(F.col("_n") > group_rows).select(*names, "_bin", "_y", "_h", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("_tree"))
        weight = _drawn(F.col("_h"), F.col("_tree"))
        sums = each.groupBy(*names, "_tree", "_bin").agg(F.sum(weight).alias("_w"), F.sum(weight * F.col("_y")).alias("_s"))

        def fit_tree(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("_bin")
            said = grow(group["_w"].to_numpy()[None, :], group["_s"].to_numpy()[None, :], max_depth)
            total, told = _mean(said)
            return framed(key[:-1], {"_bin": group["_bin"].to_numpy(), "_said": total, "_told": told.astype(float)})

        fields = T.StructType([*key_fields, number("_bin"), number("_said"), number("_told")])
        told = dealt_out(sums, [*names, "_tree"], scale.keys * trees).groupBy(*names, "_tree").applyInPandas(fit_tree, fields)
        told = told.groupBy(*names, "_bin").agg((F.sum("_said") / F.greatest(F.sum("_told"), F.lit(1.0))).alias("_said"))
        answers = short.unionByName(told)
    answers = cut_lineage(answers)
    known = attach(ready, answers, [*names, "_bin"], replace(scale, keys=answers.count()))
    return known.withColumn("yhat", F.col("_mean") + F.col("_said")).select(*rows.columns, "yhat")
