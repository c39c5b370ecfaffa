"""Connected components by alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.session import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    """Every vertex links its larger neighbours to the least of its neighbours and itself."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every vertex links its smaller neighbours and itself to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(vertex, component): the least vertex of each vertex's component, for every vertex that has an edge to another.

    ``edges`` has columns a and b of one orderable type. Null ends and loops don't count, repeated edges count once, an empty table
    gives no row. Every round is one job cut by a checkpoint; a round that changes nothing ends the loop. Rounds grow with
    the logarithm of the longest chain. Should ``max_rounds`` not suffice, it raises: half-merged components are no result.
    """
    now = cut_lineage(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(max_rounds):
        now = cut_lineage(_small_star(_large_star(now)))
        # The edge set is fixed once it is a star forest; count and sum of hashes tell two sets apart without moving them.
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            leaves = now.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
            return leaves.unionAll(now.select(F.col("b").alias("vertex"), F.col("b").alias("component"))).distinct()
        before = state
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
