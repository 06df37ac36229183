"""Connected components of a graph of 64-bit nodes, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import pin


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) edges to (node, root): the smallest node that each node of an edge reaches.

    A round links every larger neighbour of a node to its smallest neighbour, then every smaller
    one; rounds grow with the logarithm of the longest path. Neighbours are reduced to a minimum
    before they are joined back, so no node's neighbourhood is gathered. Each round is written to
    the shared checkpoint folder.
    """
    links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    before = None
    for _ in range(max_rounds):
        both = links.union(links.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = pin(small.union(least).distinct())
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if state == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = state
    raise RuntimeError("components did not settle")
