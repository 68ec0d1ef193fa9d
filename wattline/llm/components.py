"""Connected components of a graph of any size, by contraction in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of `edges` (a, b); the component is its smallest node.

    In each round every node moves to the one with the least priority among itself and its neighbours;
    edges follow, and those within one node go.  Priorities are hashes that change from round to round,
    so a chain shrinks by a constant share each time and a star ends after two or three rounds.  Each
    round is stored: a lost executor costs no more than the current one.  Nothing but a count of edges
    reaches the driver.
    """
    left = stored(_tidy(edges), "edges")
    moved, rounds = None, 0
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        priority = F.struct(F.xxhash64("b", F.lit(rounds)).alias("p"), F.col("b").alias("n"))
        own = F.struct(F.xxhash64("a", F.lit(rounds)).alias("p"), F.col("a").alias("n"))
        goal = both.groupBy("a").agg(F.min(priority).alias("best")).select(F.col("a").alias("was"), F.least("best", own)["n"].alias("now"))
        goal = stored(goal, "goals")
        first = left.join(goal, left.a == goal.was).select(F.col("now").alias("a"), "b")
        left = stored(_tidy(first.join(goal, first.b == goal.was).select("a", F.col("now").alias("b"))), "edges")
        if moved is None:
            moved = goal.select(F.col("was").alias("node"), F.col("now").alias("at"))
        else:
            moved = moved.join(goal, F.col("at") == F.col("was"), "left").select("node", F.coalesce("now", "at").alias("at"))
        moved = stored(moved, "moved") if rounds % 4 == 3 else moved
        rounds += 1
    if moved is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    least = moved.groupBy("at").agg(F.min("node").alias("component"))
    return stored(moved.join(least, "at").select("node", "component"), "components")


def _tidy(edges: DataFrame) -> DataFrame:
    pair = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pair.distinct()
