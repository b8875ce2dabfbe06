"""Connected components over a distributed edge list, by alternating star operations.

Defined results. Loops and repeated or turned links do not matter; links with a null end are passed over; other
columns are not read. A node without a link to another has no row. No links: no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._util import BROADCAST_ROWS, checkpointed


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, broadcast_links: int = BROADCAST_ROWS // 2) -> DataFrame:
    """(node, component): the least node reachable from each node that has an edge.

    Large-star links each node's larger neighbours to its least neighbour, small-star its smaller
    ones; both together leave stars around the least node after a logarithmic number of rounds. A
    node's neighbour list is never gathered: only its minimum is, which Spark combines before the
    shuffle. Up to `broadcast_links` links the minima are broadcast (there are two nodes a link at most), so
    a hub's links stay where they are; beyond, they are joined, and the session's adaptive execution splits
    the partition of a hub. Each round is checkpointed."""
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    links = checkpointed(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    n, before = links.count(), None

    def with_least(rows: DataFrame, least: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(least) if n <= broadcast_links else least, "u")

    for _ in range(max_rounds):
        # Large-star: for each node u, all neighbours above u point at m(u), the least of its neighbours and itself.
        sides = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sides.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = with_least(sides.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small-star: for each u, its neighbours below and u itself point at the least of them.
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = with_least(large, below).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        links = checkpointed(small.union(below.select("u", F.col("m").alias("v"))).distinct())
        state = tuple(links.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v") % 1000003)).first())
        n = state[0]
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(links.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
