"""Near-duplicate vectors by random-hyperplane sign hashing.

The signs of a vector's products with random planes make one key in each of several tables.  Most vectors
that share a key do so by chance, so a bucket is screened first with sketches of SKETCH more signs: only
vectors with another one near by them in the bucket send their numbers there, and are compared exactly.
Full buckets are cut into blocks, so a task never holds more than two.  A pair that meets in several tables
counts in the first only.  A task returns how many links each vector has and a spanning forest of them,
never the pairs.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm.common import stored, with_python
from wattline.llm.components import components
from wattline.llm.near_dedup import _forest

#: Vectors of one block, and rows that make one task's work.
BLOCK, WORK = 512, 8192
#: Signs of a sketch, and deviations above the expected number of unlike ones that still count as near:
#: a pair right at the threshold fails the screen with a chance below one in a million.
SKETCH, DEVIATIONS = 512, 5.0


def plan(count: int, cosine: float, miss: float) -> tuple[int, int]:
    """Bits of a key, growing with the logarithm of the number of vectors, and tables, so that a pair right
    at the threshold is missed with at most the chance `miss`."""
    bits = min(30, max(4, round(math.log2(max(count, 2))) - 4))
    alike = 1 - math.acos(min(1.0, cosine)) / math.pi
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - min(alike**bits, 1 - 1e-12))))


def unlike(cosine: float) -> int:
    """Most unlike signs that two sketches of near vectors may have."""
    share = math.acos(min(1.0, cosine)) / math.pi
    return math.floor(SKETCH * share + DEVIATIONS * math.sqrt(SKETCH * share * (1 - share)))


@functools.cache
def _planes(size: int, many: int, seed: int = 20_011) -> np.ndarray:
    return np.random.default_rng(seed + size).standard_normal((size, many))


def sketches(vectors: np.ndarray) -> np.ndarray:
    """Vectors x bytes: SKETCH signs of products with planes of their own."""
    signs = [vectors[a : a + 4096] @ _planes(vectors.shape[1], SKETCH, 40_009) > 0 for a in range(0, len(vectors), 4096)]
    return np.packbits(np.concatenate(signs), axis=1)


def keys(vectors: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Vectors x tables: the signs of `bits` products, packed."""
    out = np.zeros((len(vectors), tables), np.int32)
    for a in range(0, len(vectors), 4096):
        signs = (vectors[a : a + 4096] @ _planes(vectors.shape[1], bits * tables) > 0).reshape(-1, tables, bits)
        out[a : a + 4096] = signs @ (1 << np.arange(bits))
    return out


def _grid(array: pa.Array) -> np.ndarray:
    """Vectors as rows, each scaled by a power of two so that its largest number is near one."""
    x = array.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(array), -1)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True, initial=0.0))[1])


_PLACE = ("size", "tab", "val", "low", "high")


def _meetings(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the rows in which each pair of blocks of a bucket is one stretch, their starts and the places."""
    columns = [table.column(c).to_numpy() for c in _PLACE]
    order = np.lexsort(columns[::-1])
    where = np.stack([c[order] for c in columns], 1)
    return order, np.flatnonzero(np.concatenate(([True], (where[1:] != where[:-1]).any(1)))), where


def _screen(most: int):
    """Rows that have another one near by them, by their sketches."""

    def run(table: pa.Table) -> pa.Table:
        order, starts, where = _meetings(table)
        block = table.column("block").to_numpy()[order]
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(order), -1)[order]
        near = np.zeros(len(order), bool)
        for a, b in zip(starts, np.append(starts[1:], len(order))):
            signs = 1.0 - 2.0 * np.unpackbits(sketch[a:b], axis=1).astype(np.float32)
            meet = signs @ signs.T >= SKETCH - 2 * most
            if where[a, 3] != where[a, 4]:  # two blocks: only pairs across
                meet &= block[a:b, None] != block[None, a:b]
            np.fill_diagonal(meet, False)
            near[a:b] = meet.any(1)
        return table.select(["node", *_PLACE[1:], "block"]).take(pa.array(order[near]))

    return run


def _compare(cosine: float):
    def run(table: pa.Table) -> pa.Table:
        order, starts, where = _meetings(table)
        node, copies = table.column("node").to_numpy()[order], table.column("copies").to_numpy()[order]
        block = table.column("block").to_numpy()[order]
        lists, signs = table.column("vector").combine_chunks(), table.column("signs").combine_chunks()
        links: dict[int, int] = {}
        edges_a, edges_b = [], []
        for a, b in zip(starts, np.append(starts[1:], len(order))):
            at = order[a:b]
            x = _grid(lists.take(pa.array(at)))
            x /= np.sqrt((x * x).sum(1, keepdims=True))
            link = np.triu(x @ x.T >= cosine, 1)
            if where[a, 3] != where[a, 4]:  # two blocks: only pairs across
                link &= block[a:b, None] != block[None, a:b]
            i, j = np.nonzero(link)
            if not len(i):
                continue
            s, t = _grid(signs.take(pa.array(at))), int(where[a, 1])
            first = np.ones(len(i), bool)
            for k in range(t):
                first &= s[i, k] != s[j, k]
            i, j = i[first] + a, j[first] + a
            for x_, y_ in ((i, j), (j, i)):
                sums = np.bincount(x_ - a, copies[y_], b - a)
                for k in np.flatnonzero(sums):
                    links[int(node[a + k])] = links.get(int(node[a + k]), 0) + int(sums[k])
            fresh = np.zeros((b - a, b - a), bool)
            fresh[i - a, j - a] = fresh[j - a, i - a] = True
            u, v = _forest(fresh)
            edges_a += node[a + u].tolist()
            edges_b += node[a + v].tolist()
        none = [None] * len(edges_a)
        return pa.table({
            "node": pa.array([*links, *edges_a], pa.int64()), "other": pa.array([None] * len(links) + edges_b, pa.int64()),
            "n": pa.array([*links.values(), *none], pa.int64()),
        })

    return run


def near_vectors(df: DataFrame, vector: str = "embedding", key: str = "vec_id", cosine: float = 0.9, miss: float = 0.005) -> DataFrame:
    """`df` with n_links (other rows with a cosine of at least `cosine`), component_id and kept.

    Links are checked in double precision; a pair right at the threshold is found with a chance of at least
    1 - `miss`.  component_id is the smallest key that links reach, kept says that it is the row's own.
    Vectors that are null, empty, zero or hold a null, NaN or infinity have no links; vectors of different
    length never link.  Equal vectors (repeated rows too) are one class, compared once; a null key counts
    as larger than all others, and as a component it is null.  Empty tables stay empty; columns with the
    new names are replaced.
    """
    new = ("n_links", "component_id", "kept")
    names = [c for c in df.columns if c not in new]
    last = 2**63 - 1
    numbers = F.col(f"`{vector}`").cast("array<double>")
    odd = F.exists(numbers, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fit = F.coalesce(~odd & F.exists(numbers, lambda x: x != 0), F.lit(False))
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.coalesce(F.col(f"`{key}`"), F.lit(last)).cast("bigint").alias("vec"),
        F.when(fit, F.transform(numbers, lambda x: x + F.lit(0.0))).alias("vector"),
    )
    classes = rows.filter("vector is not null").groupBy("vector").agg(F.min("vec").alias("vec"), F.count("*").alias("copies"))
    # a node is a distinct vector, numbered as it is stored: keys only label what links join
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    bits, tables = plan(classes.count(), cosine, miss)

    def step(batch: pa.RecordBatch) -> list[pa.Array]:
        lists = batch.column("_vector")
        size = lists.value_lengths().to_numpy()
        out, rough = np.zeros((len(lists), tables), np.int32), np.zeros((len(lists), SKETCH // 8), np.uint8)
        for d in np.unique(size):
            at = np.flatnonzero(size == d)
            grid = _grid(lists.take(pa.array(at)))
            out[at], rough[at] = keys(grid, bits, tables), sketches(grid)
        offsets = np.arange(len(lists) + 1, dtype=np.int32) * tables
        return [pa.ListArray.from_arrays(offsets, pa.array(out.ravel(), pa.int32())), pa.array([r.tobytes() for r in rough], pa.binary())]

    signed = with_python(classes, {"_vector": F.col("vector")}, "signs array<int>, sketch binary", step).withColumn("size", F.size("vector"))
    signed = stored(signed, "signs")
    places = signed.select("node", "size", F.posexplode("signs").alias("tab", "val"))
    buckets = places.groupBy("size", "tab", "val").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("n"))
    buckets = stored(buckets.filter("n > 1"), "buckets")
    # a vector of a full bucket is sent once for each block it meets
    sent = buckets.agg(F.coalesce(F.sum(F.col("n") * F.col("blocks")), F.lit(0))).first()[0]
    buckets = buckets.drop("n")
    spread = places.join(buckets, ["size", "tab", "val"]).withColumn("block", F.pmod(F.hash("node", "tab"), F.col("blocks")))
    spread = spread.select("node", "tab", "val", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    work = spread.select("node", "tab", "val", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))

    def shared(rows: DataFrame, sent: int) -> DataFrame:
        share = F.pmod(F.xxhash64(*_PLACE), F.lit(max(8, -(-sent // WORK)))).alias("share")
        return rows.select("*", share).groupBy("share")

    screened = shared(work.join(signed.select("node", "size", "sketch"), "node"), sent)
    places_kept = "node bigint, tab int, val int, low int, high int, block int"
    kept = stored(screened.applyInArrow(_screen(unlike(cosine)), places_kept), "near")
    full = kept.join(signed.drop("sketch"), "node")
    found = stored(shared(full, kept.count()).applyInArrow(_compare(cosine), "node bigint, other bigint, n bigint"), "links")
    links = found.filter("other is null").groupBy("node").agg(F.sum("n").alias("n"))
    reached = components(found.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    labels = reached.join(classes.select("node", "vec"), "node").groupBy("component").agg(F.min("vec").alias("least"))
    reached = reached.join(labels, "component").select("node", "least")
    homes = (
        classes.join(links, "node", "left").join(reached, "node", "left")
        .select("vector", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least", "vec").alias("least"))
    )
    out = rows.join(homes, "vector", "left").withColumn("least", F.coalesce("least", "vec"))
    return out.select(
        *[F.col("row").getField(c).alias(c) for c in names],
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.when(F.col("least") != last, F.col("least")).alias("component_id"),
        (F.col("least") == F.col("vec")).alias("kept"),
    )
