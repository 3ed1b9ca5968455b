"""Connected components of large graphs by alternating star contractions.

Each round replaces edges so that every node points at the least node it can see: first from each node to its larger
neighbours (large star), then from each node to its smaller ones (small star). Components shrink to stars in a number of
rounds that grows with the logarithm of the node count. Work per round is two aggregations and two equi-joins over the edges;
nothing is collected, and each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karyoflux.runtime import discard, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): each node of an edge with the least node of its component.

    Self-loops and repeated edges are allowed; a node that only has a self-loop is its own component. Null ends are ignored.
    An edge table without rows gives no rows.
    """
    raw = materialize(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull()).distinct(),
        "edges",
    )
    now = raw
    before = None
    for _ in range(max_rounds):
        large = _large_star(now)
        small = materialize(_small_star(large), "star")
        mark = small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now is not raw:
            discard(now)
        now = small
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    loops = raw.where("u = v").select(F.col("u").alias("node"), F.col("u").alias("component"))
    return members.unionByName(roots).unionByName(loops).groupBy("node").agg(F.min("component").alias("component"))


def _large_star(e: DataFrame) -> DataFrame:
    both = e.where("u <> v")
    both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    e = e.where("u <> v").distinct()
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
