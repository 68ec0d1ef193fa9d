"""MinHash near-duplicates with tensored banding.

Two small collections of hash groups, each of a few minhashes, give every pair of groups as a table key:
`a * b` tables from `a` and `b` groups.  Documents that share a key are candidates; the components of the
candidate graph are cut into blocks, and full shingle sets are compared block by block with matrix
products.  What leaves a block is a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.llm.common import NOT_BLANK, filled, mixed, slices, stored, strings, with_python, word_hashes
from wattline.llm.components import components

#: Documents of one block; two blocks meet in a task.
BLOCK = 128
#: The place of a missing id: after all others.
_LAST = 2**63 - 1


def shape(percent: int, miss: float, count: int) -> tuple[tuple[int, int], tuple[int, int]]:
    """(minhashes in a group, groups) of the two collections.

    A key has one minhash for each power of ten in the number of documents (five at least), so that two
    texts with a tenth in common meet by chance about once; the groups are as many as it takes to
    miss a pair right at the threshold with at most the chance `miss`.
    """
    width = max(5, math.floor(math.log10(max(count, 1))))
    s, sides = percent / 100, []
    for side in ((width + 1) // 2, width // 2):
        hit = min(s**side, 1 - 1e-12)
        sides.append((side, max(1, math.ceil(math.log(miss / 2) / math.log(1 - hit)))))
    return sides[0], sides[1]


def _constants(n: int, salt: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)) | np.uint64(1)


def shingle_sets(raw: np.ndarray, bounds: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every distinct shingle, by row and hash; words are lower-cased in ASCII and end at
    ASCII blanks; a text of fewer words is one shingle."""
    h, row, *_ = word_hashes(raw, bounds, NOT_BLANK)
    factor = _constants(words, 11)
    n = len(h)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    value = np.zeros(max(n - words + 1, 0), np.uint64)
    for k in range(words):
        value += h[k : len(value) + k] * factor[k]
    full = row[: len(value)] == row[words - 1 : words - 1 + len(value)]
    rows, values = row[: len(value)][full], value[full] + np.uint64(words)
    counts = np.bincount(row, minlength=len(bounds) - 1)
    short = np.flatnonzero((counts > 0) & (counts < words))
    first = np.searchsorted(row, short)
    one = counts[short].astype(np.uint64)
    for k in range(words - 1):
        inside = counts[short] > k
        one[inside] += h[first[inside] + k] * factor[k]
    rows, values = np.concatenate((rows, short)), mixed(np.concatenate((values, one)))
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    return rows[fresh], values[fresh]


def sketch(
    raw: np.ndarray, bounds: np.ndarray, words: int, sides: tuple[tuple[int, int], tuple[int, int]]
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set sizes, two-number set identities and table keys (rows x tables) of whole texts."""
    rows, values = shingle_sets(raw, bounds, words)
    n = len(bounds) - 1
    size = np.bincount(rows, minlength=n)
    groups = [count for _, count in sides]
    identity, keys = np.zeros((n, 2), np.uint64), np.zeros((n, groups[0] * groups[1]), np.uint64)
    filled_rows = np.flatnonzero(size)
    if not len(filled_rows):
        return size, identity, keys
    starts = np.searchsorted(rows, filled_rows)
    for k in range(2):
        identity[filled_rows, k] = np.add.reduceat(mixed(values + np.uint64(k + 1)), starts)
    parts = []
    for side, (width, count) in enumerate(sides):
        factor = _constants(width * count, 100 + side)
        group = np.zeros((count, len(starts)), np.uint64)
        for k in range(width * count):
            least = np.minimum.reduceat((values ^ factor[-1 - k]) * factor[k], starts)
            group[k // width] = mixed(group[k // width] * np.uint64(31) + least)
        parts.append(group)
    for i in range(groups[0]):
        for j in range(groups[1]):
            t = i * groups[1] + j
            keys[filled_rows, t] = mixed(parts[0][i] * np.uint64(3) + parts[1][j] * np.uint64(5) + np.uint64(t))
    return size, identity, keys


def _forest(link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    free = np.ones(len(link), bool)
    a, b = [], []
    for root in range(len(link)):
        if not free[root]:
            continue
        free[root] = False
        front = [root]
        while front:
            x = front.pop()
            new = np.flatnonzero(link[x] & free)
            free[new] = False
            a += [x] * len(new)
            b += new.tolist()
            front += new.tolist()
    return np.array(a, np.int64), np.array(b, np.int64)


def linked(rows: np.ndarray, values: np.ndarray, n: int, percent: int) -> np.ndarray:
    """Which of `n` sets have 100 * intersection >= percent * union; sets without members with none."""
    size = np.bincount(rows, minlength=n)
    column = np.unique(values, return_inverse=True)[1]
    count = np.bincount(column)
    rank = np.cumsum(count > 1) - 1  # members of one set alone cannot be shared
    shared = count[column] > 1
    rows, column = rows[shared], rank[column[shared]]
    common = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    width = 4096
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (start, start + width))
        part = np.zeros((n, width), np.float32)
        part[rows[a:b], column[a:b] - start] = 1
        common += part @ part.T
    common = np.rint(common).astype(np.int64)
    union = size[:, None] + size[None, :] - common
    return (100 * common >= percent * union) & (size[:, None] > 0) & (size[None, :] > 0)


def _verify(words: int, percent: int):
    def run(table: pa.Table) -> pa.Table:
        raw, bounds = strings(table.column("text"))
        parts = [(a, *shingle_sets(raw[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], words)) for a, b in slices(bounds)]
        rows = np.concatenate([a + r for a, r, _ in parts])
        values = np.concatenate([v for *_, v in parts])
        a, b = _forest(linked(rows, values, len(table), percent))
        node = table.column("node").to_numpy()
        return pa.table({"a": node[a], "b": node[b]})

    return run


#: What tells rows apart: the key's number and 128 bits of the text's hash; equal ones are copies.
_PLACE = ["doc", "text_one", "text_two"]


def _place(text: str, key: str) -> list[Column]:
    number = F.coalesce(F.col(f"`{key}`"), F.lit(_LAST)).cast("bigint")
    return [c.alias(n) for c, n in zip((number, F.xxhash64(filled(text)), F.xxhash64(F.lit(1), filled(text))), _PLACE)]


def _often(count: int) -> int:
    """Copies beyond which a row is thinned in the map tasks; fewer than 10,000 kinds of rows have so many."""
    return max(1000, count // 10_000)


def _thinned(df: DataFrame, hot: list) -> DataFrame:
    """`df` (with the columns of _PLACE) with the first copy in each task of the rows in `hot`."""
    if not hot:
        return df
    known = {tuple(h) for h in hot}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = set()
        for batch in batches:
            take = []
            for n, place in enumerate(zip(*(batch.column(c).to_pylist() for c in _PLACE))):
                if place in met:
                    continue
                if place in known:
                    met.add(place)
                take.append(n)
            yield batch if len(take) == batch.num_rows else batch.take(pa.array(take, pa.int64()))

    return df.mapInArrow(run, df.schema)


def _marked(df: DataFrame, names: list[str], text: str, key: str, words: int, percent: int, miss: float) -> DataFrame:
    """Rows of `df` (their columns `names` in one struct) with their place, n_shingles as size, and the least
    place that links reach as best."""
    total = df.count()
    sides = shape(percent, miss, total)
    tables = sides[0][1] * sides[1][1]

    def step(batch: pa.RecordBatch) -> list[pa.Array]:
        raw, bounds = strings(batch.column("_text"))
        parts = [sketch(raw[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], words, sides) for a, b in slices(bounds)]
        size = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
        one, two = (np.concatenate([p[1][:, k] for p in parts]).view(np.int64) if parts else size for k in range(2))
        offsets = np.concatenate(([0], np.cumsum(np.where(size > 0, tables, 0)))).astype(np.int32)
        keys = np.concatenate([p[2] for p in parts])[size > 0].ravel().view(np.int64) if parts else size
        return [pa.array(size, pa.int64()), pa.array(one), pa.array(two), pa.ListArray.from_arrays(offsets, pa.array(keys))]

    row = F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.lit(1)
    base = df.select(row.alias("row"), *_place(text, key), filled(text).alias("text"))
    made = with_python(base, {"_text": F.col("text")}, "size bigint, one bigint, two bigint, keys array<bigint>", step)
    rows = stored(made.drop("text"), "sketches")
    # a node is a distinct set, numbered as it is stored: document numbers only label what links join
    sets = rows.filter("size > 0").groupBy("one", "two")
    sets = sets.agg(F.min(F.struct(*_PLACE)).alias("best"), F.count("*").alias("n"), F.first("keys").alias("keys"))
    sets = stored(sets.withColumn("node", F.monotonically_increasing_id()), "sets")
    places = sets.select("node", F.explode("keys").alias("at"))
    hubs = places.groupBy("at").agg(F.min("node").alias("hub"), F.max("node").alias("top")).filter("hub < top").select("at", "hub")
    touching = places.join(hubs, "at").filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    clusters = components(touching)
    sizes = clusters.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = clusters.join(sizes, "component").withColumn("block", F.pmod(F.hash("node"), F.col("blocks")))
    # a shuffle join at every size: member ids have no bound to broadcast, and beyond some size Spark puts its
    # own Bloom filter of them before the shuffle of the texts
    wanted = sets.select("node", "best.*").join(members, "node")
    hot = sets.filter(F.col("n") > _often(total)).select("best.*").collect()
    texts = _thinned(base.select(*_PLACE, "text"), hot).join(wanted.hint("merge"), _PLACE)
    # rows with one place have one text: the join has brought them together
    texts = texts.groupBy(*_PLACE).agg(*[F.first(c).alias(c) for c in ("text", "node", "component", "blocks", "block")])
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    meeting = texts.select("*", other).select(
        "node", "text", "component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    )
    links = meeting.groupBy("component", "low", "high").applyInArrow(_verify(words, percent), "a bigint, b bigint")
    reached = components(links)
    labels = reached.join(sets.select("node", "best"), "node").groupBy("component").agg(F.min("best").alias("least"))
    reached = reached.join(labels, "component").select("node", "least")
    homes = sets.select("one", "two", "node", "best").join(reached, "node", "left").select("one", "two", F.coalesce("least", "best").alias("best"))
    # stored, so that both sides of the join are dealt out anew and Spark can split the rows of a hot set
    out = rows.drop("keys").join(stored(homes, "homes"), ["one", "two"], "left")
    return out.withColumn("best", F.coalesce("best", F.struct(*_PLACE)))


def near_duplicates(
    df: DataFrame, text: str = "text", key: str = "doc_id", words: int = 5, percent: int = 80, miss: float = 0.003
) -> DataFrame:
    """`df` without its text, and n_shingles, component_id and kept.

    Two documents are linked if 100 * common shingles >= `percent` * all shingles of both, checked on
    full sets of `words`-word shingles; a pair right at the threshold becomes a candidate with the chance
    1 - `miss` at least, a closer one almost surely.  component_id is the smallest key that links reach, kept
    says that it is the row's own.  Texts that are null, empty or blank have no shingles and no links;
    rows with one set (repeated rows among them) are linked without a comparison; a key that several rows
    have, or none, links nothing; a null key counts as larger than all others, and as a component it is null.
    Long texts are read whole, empty tables stay empty, columns with the new names are replaced.
    """
    new = ("n_shingles", "component_id", "kept")
    names = [c for c in df.columns if c != text and c not in new]
    out = _marked(df, names, text, key, words, percent, miss)
    least = F.col("best")["doc"]
    return out.select(
        *[F.col("row").getField(c).alias(c) for c in names],
        F.col("size").alias("n_shingles"),
        F.when(least != _LAST, least).alias("component_id"),
        (least == F.col("doc")).alias("kept"),
    )


def keep_one(df: DataFrame, text: str = "text", key: str = "doc_id", words: int = 5, percent: int = 80, miss: float = 0.003) -> DataFrame:
    """`df` with one row of each group of near-duplicates: one with the smallest key.

    Groups are those of `near_duplicates`; equal rows of one key, or of none, are copies like all others.
    Texts without shingles stay.
    """
    marked = _marked(df.select(key, text), [], text, key, words, percent, miss).filter("size > 0")
    own = F.struct(*_PLACE)
    counted = marked.groupBy(*_PLACE).agg(F.count("*").alias("n"), F.first(F.col("best") == own).alias("wins"))
    counted = stored(counted.filter("not wins or n > 1"), "copies")
    tagged = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *_place(text, key))
    left = tagged.join(counted.select(*_PLACE), _PLACE, "left_anti").select("row")
    again = counted.filter("wins")
    if not again.isEmpty():
        hot = again.filter(F.col("n") > _often(df.count())).select(*_PLACE).collect()
        copies = _thinned(tagged, hot).join(again.select(*_PLACE), _PLACE, "left_semi")
        left = left.unionByName(copies.groupBy(*_PLACE).agg(F.first("row").alias("row")).select("row"))
    return left.select(*[F.col("row").getField(c).alias(c) for c in df.columns])
