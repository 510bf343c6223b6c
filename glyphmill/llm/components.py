"""Connected components by alternating large-star and small-star, over written edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, Scratch

#: A node with more edges than this, and than 1 / HOT_KEYS of them all, is joined by a broadcast row of its own,
#: so that its edges stay where they are. By the second bound there are HOT_KEYS such nodes at most.
HOT_DEGREE = 50_000


def _to_least(edges: DataFrame, least: DataFrame, n_edges: int, scratch: Scratch) -> DataFrame:
    """(u, v, m): edges with the least of each u."""
    if n_edges > HOT_DEGREE:  # else no node can be hot
        least = scratch.cut(least)
        hot = least.filter(F.col("n") > max(HOT_DEGREE, n_edges // HOT_KEYS)).select("u", "m")
        if hot.limit(1).count():
            there = edges.join(F.broadcast(hot), "u")
            rest = edges.join(F.broadcast(hot.select("u")), "u", "left_anti").join(least.select("u", "m"), "u")
            return there.unionByName(rest)
    return edges.join(least.select("u", "m"), "u")


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(id, component) of every id in ``edges`` (a, b): component is the smallest id that edges reach.

    Loops, repeated edges and either order of the ends are allowed; edges with a null end are not edges.
    An empty table gives an empty one. It has converged when every node has one edge, to a node without any.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("a IS NOT NULL AND b IS NOT NULL").distinct()
    pairs = scratch.cut(pairs)
    now = pairs.filter("u <> v")
    n, settled = now.count(), False
    for turn in range(rounds + 1):
        if not n or settled:
            break
        if turn == rounds:
            raise RuntimeError(f"no fixed point within {rounds} rounds of stars")
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = scratch.cut(_to_least(both.filter("v > u"), least, 2 * n, scratch).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _to_least(large, least, 2 * n, scratch).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        if turn:
            scratch.drop(now)
        now = scratch.cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        scratch.drop(large)
        # settled: one edge for each node, and none from a node that others point to
        each = now.groupBy("u").agg(F.count("*").alias("n")).join(now.select(F.col("v").alias("u"), F.lit(True).alias("root")).distinct(), "u", "left")
        n, loose = each.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(((F.col("n") > 1) | F.col("root").isNotNull()).cast("long")), F.lit(0))).first()
        settled = not loose
    stars = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    loops = pairs.filter("u = v").select(F.col("u").alias("id"))
    alone = loops.join(stars.select("id").unionByName(roots.select("id")), "id", "left_anti").select("id", F.col("id").alias("component"))
    return scratch.cut(stars.unionByName(roots).unionByName(alone))
