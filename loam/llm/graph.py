"""Connected components of an edge table by alternating large and small stars, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import checkpointed, parts_for


#: A node of more edges than this, and than a ``HUB_SHARE``-th of them all, is a hub.
HUB = 512
HUB_SHARE = 2048


def _with_least(edges: DataFrame, count: int) -> DataFrame:
    """Edges (u, v) with m, the least node among u and its neighbours.  Least values are combined before they move, and those of
    hubs, of which there are fewer than ``HUB_SHARE``, go to where the hubs' edges are."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    hub = F.col("n") > max(HUB, count // HUB_SHARE)
    known = edges.join(F.broadcast(least.filter(hub).select("u", F.col("m").alias("of_hub"))), "u", "left")
    others = known.filter("of_hub is null").join(least.filter(~hub).select("u", "m"), "u").select("u", "v", "m")
    return known.filter("of_hub is not null").select("u", "v", F.col("of_hub").alias("m")).unionByName(others)


def components(edges: DataFrame, limit: int = 64) -> DataFrame:
    """node, root of every node of the edges (u, v); root is the least node of its component.

    Each round is checkpointed to the shared folder, in files by its number of edges, which never grows.  Stars converge
    in a few rounds; ``limit`` only guards against a fault.
    """
    now = checkpointed(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(limit):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, 2 * mark[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        down = large.distinct()
        near = _with_least(down, 2 * mark[0])
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v"))).filter("u != v")
        now = checkpointed(small.distinct(), parts_for(mark[0]))
    raise RuntimeError("stars did not converge")
