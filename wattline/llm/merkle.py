"""A Merkle manifest of a dataset: a tree of hashes per group of rows, one more over the groups' roots.

A tree is built from below, one level a round.  Nodes of a level are rows (tree, idx, hash); each meets
the others of its run by equijoins on computed sibling indices: idx XOR 1 in binary trees, the other
slots of the run otherwise.  Index keys are unique, so a source that holds a third of all rows is dealt
out like any other.  Rows in slot zero then emit the parents.  Every level is stored, so the next one
starts from a table, and paths of siblings are handed down again from the root: a node adds its own
siblings to its parent's path, and paths are stored on the way, so no query holds more than a few levels
however many there are.  Only the size of the largest tree and the root reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.llm.common import stored
from wattline.llm.order import numbered

_NONE = bytearray()
#: Levels whose joins one query may hold when paths are handed down: the driver keeps the whole plan of a query.
PLAN_LEVELS = 3


def field(column: Column) -> Column:
    """A value as part of a leaf: `-` if null, else its UTF-8 byte count, `:` and itself."""
    text = column.cast("string")
    return F.when(column.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*columns: Column) -> Column:
    """The hash of a row, as bytes."""
    return _digest(F.concat(*[field(c) for c in columns]))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def written(digest: Column) -> Column:
    """A digest, or several in a row, as lowercase hex."""
    return F.lower(F.hex(digest))


def _joined(digests: Column) -> Column:
    """The hash of digests in a row, each taken as hex text."""
    return _digest(written(digests))


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """`nodes` (tree, idx, hash) with the digests of the run's others: `left` of the node and `right` of it."""
    slot, out = F.col("idx") % arity, nodes
    for offset in range(1, arity):
        sibling = F.col("idx").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("idx") - slot + (slot + arity - offset) % arity
        other = nodes.select(F.col("tree").alias("_tree"), sibling.alias("_idx"), F.col("hash").alias(f"_{offset}"))
        met = (F.col("tree") == F.col("_tree")) & (F.col("idx") == F.col("_idx"))
        out = out.join(other, met, "left").drop("_tree", "_idx")

    def side(test: Callable[[int], Column]) -> Column:
        parts = [F.when(test(o), F.coalesce(f"_{o}", F.lit(_NONE))).otherwise(F.lit(_NONE)) for o in range(1, arity)]
        return F.concat(*parts) if len(parts) > 1 else parts[0]

    left, right = side(lambda o: slot >= arity - o), side(lambda o: slot < arity - o)
    return out.select(*nodes.columns, left.alias("left"), right.alias("right"))


def _levels(nodes: DataFrame, arity: int, name: str) -> list[DataFrame]:
    """All levels (tree, idx, n, hash, left, right) from the leaves up; a tree ends where n, its nodes, is 1."""
    nodes = stored(nodes, f"{name}-leaves")
    size, levels = nodes.agg(F.max("n")).first()[0] or 0, []
    while size:
        with_others = with_siblings(nodes.filter("n > 1"), arity) if size > 1 else None
        alone = nodes.filter("n = 1").withColumn("left", F.lit(_NONE)).withColumn("right", F.lit(_NONE))
        level = stored(alone if with_others is None else with_others.unionByName(alone), f"{name}-{len(levels)}")
        levels.append(level)
        if size == 1:
            break
        heads = level.filter((F.col("n") > 1) & (F.col("idx") % arity == 0))
        nodes = heads.select(
            "tree",
            F.expr(f"idx div {arity}").alias("idx"),
            F.expr(f"(n + {arity - 1}) div {arity}").alias("n"),
            _joined(F.concat("hash", "right")).alias("hash"),
        )
        size = -(-size // arity)
    return levels


def _paths(levels: list[DataFrame], top: DataFrame, arity: int, name: str) -> DataFrame:
    """The rows of the lowest level with `path`, their siblings from there to the root of roots.

    `top` has the path above each tree's root, and columns for all nodes of the tree.
    """
    below, told = None, [c for c in top.columns if c not in ("tree", "path")]
    for number, level in reversed(list(enumerate(levels))):
        root = level.filter("n = 1").join(top, "tree")
        if below is None:
            found = root
        else:
            above = below.select(F.col("tree").alias("_tree"), F.col("idx").alias("_idx"), "path", *told)
            met = (F.col("tree") == F.col("_tree")) & (F.expr(f"idx div {arity}") == F.col("_idx"))
            inner = level.filter("n > 1").join(above, met).drop("_tree", "_idx")
            own = F.array(F.struct("left", "right"))
            found = inner.withColumn("path", F.concat(own, "path")).unionByName(root)
        if number and number % PLAN_LEVELS == 0:
            found = stored(found.select("tree", "idx", "path", *told), f"{name}-{number}")
        below = found
    return found


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf and its path of siblings give."""
    return F.aggregate(path, digest, lambda done, step: _joined(F.concat(step["left"], done, step["right"])))


def path_digest(path: Column) -> Column:
    """The hash of all digests of a path, as bytes."""
    return _joined(F.aggregate(path, F.lit(_NONE), lambda done, step: F.concat(done, step["left"], step["right"])))


@dataclass
class Manifest:
    """Stored levels of the groups' trees and of the tree over them, and the root (None without rows)."""

    levels: list[DataFrame]
    top: list[DataFrame]
    root: bytes | None
    keep: list[str]
    arity: int
    empty: DataFrame

    def subroots(self) -> DataFrame:
        """(tree, hash): the root of each group; the tree of the null group is '', others are '=' and the value."""
        if not self.levels:
            return self.empty.select("tree", "hash")
        return _roots(self.levels)

    def proofs(self) -> DataFrame:
        """One row per leaf: the kept columns, leaf, subroot, root (bytes) and path (left, right per level)."""
        path = "array<struct<left: binary, right: binary>>"
        if not self.levels:
            none = F.lit(None)
            digests = [none.cast("binary").alias(c) for c in ("leaf", "subroot", "root")]
            return self.empty.select(*self.keep, *digests, none.cast(path).alias("path"))
        start = stored(_roots(self.top).select("tree", F.array().cast(path).alias("path")), "manifest-start")
        over = _paths(self.top, start, self.arity, "manifest-top-paths")
        over = stored(over.select(F.col("group").alias("tree"), "path", F.col("hash").alias("subroot")), "manifest-over")
        found = _paths(self.levels, over, self.arity, "manifest-paths")
        root = F.lit(bytearray(self.root)).alias("root")
        return found.select(*self.keep, F.col("hash").alias("leaf"), "subroot", root, "path")


def _roots(levels: list[DataFrame]) -> DataFrame:
    parts = [level.filter("n = 1").select("tree", "hash") for level in levels]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def manifest(df: DataFrame, digest: Column, group: str, order: Sequence[str], keep: dict[str, Column], arity: int = 3) -> Manifest:
    """The manifest of `df`: a leaf (`digest`, see `leaf`) per row, a tree per value of `group`.

    Leaves ascend by `order` (nulls first; rows equal in it by their digest), roots by the group's UTF-8
    bytes, null first.  While a tree has several nodes, every `arity` consecutive ones (the last run: fewer,
    even one) become one.  `keep` names columns carried with each leaf; nothing else of `df` is kept, so no
    names clash.  Null and empty values differ; repeated rows are leaves of their own; texts are hashed
    whole; an empty table has no root and no proofs.
    """
    if arity < 2:
        raise ValueError("a run has two nodes at least")
    tree = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    kept = F.struct(*[c.alias(name) for name, c in keep.items()]).alias("kept")
    by = F.struct(*[F.col(c) for c in order]).alias("by")
    # the texts are read here only; the row number spreads rows that are equal in everything
    rows = df.select(tree.alias("tree"), by, digest.alias("hash"), kept, F.monotonically_increasing_id().alias("row"))
    rows = stored(rows, "manifest-rows")
    leaves = numbered(rows, "tree", ["by", "hash", "row"], "manifest-order")
    leaves = leaves.select("tree", "idx", "n", "hash", *[F.col("kept")[c].alias(c) for c in keep])
    levels = _levels(leaves, arity, "manifest")
    if not levels:
        return Manifest([], [], None, list(keep), arity, leaves.limit(0))
    groups = _roots(levels).select(F.lit("").alias("tree"), F.col("tree").alias("group"), "hash")
    top = _levels(numbered(groups, "tree", ["group"], "manifest-groups"), arity, "manifest-top")
    root = bytes(top[-1].select("hash").first()[0])
    return Manifest(levels, top, root, list(keep), arity, leaves.limit(0))
