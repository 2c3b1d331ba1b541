"""Connected components of an edge table: distributed union-find by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonlake.session import pinned, shuffles_freed, unpinned


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root), stored: the smallest node reachable from each node of an edge.

    ``edges`` has ``a`` and ``b`` of one orderable type; self-loops and repeats do no harm.
    Large-star and small-star steps alternate until nothing changes: each joins
    neighbours to the smallest neighbour known, so the rounds grow with the logarithm of
    the longest path. Neighbourhoods are never gathered: the least neighbour is an
    aggregate, joined back, so a node with very many edges is split like any skewed key.
    Every round is written to the shared folder and takes the
    place of the one before. Nodes without edges do not appear.
    """
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    current = pinned(both.distinct())
    before = None
    for _ in range(most_rounds):
        # large star: larger neighbours of u go to the least of u and its neighbours
        ways = current.select("u", "v").union(current.select(F.col("v"), F.col("u"))).toDF("x", "y")
        least = ways.groupBy("x").agg(F.min("y").alias("m")).select(
            F.col("x"), F.least("x", "m").alias("m")
        )
        large = ways.join(least, "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v"))
        # small star: u and its smaller neighbours go to the least of them
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        )
        old, current = current, pinned(small)
        unpinned(old)
        with shuffles_freed(edges.sparkSession):
            state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            roots = pinned(current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            ))
            unpinned(current)
            return roots
        before = state
    raise RuntimeError("components did not settle")
