"""Connected components of a link table by alternating large-star and small-star rounds, all in DataFrame operations.

Each round is two grouped minima and two joins, so a hub with any number of neighbours is summed before it is shuffled and
a skewed join can be split. The number of rounds grows with the logarithm of the longest chain. Every round ends in a table
in the shared folder, so a lost executor never restarts the loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import let_go, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u > v). Large: every larger neighbour of a node moves to the node's minimum. Small: every smaller one does."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        out = both.where("v > u").join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        out = edges.join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
    return out.where("u > v").distinct()


#: Edges in a file of a round, about: few links make one file, however many partitions a shuffle has.
FILE_EDGES = 500_000


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label) for every linked node: label is the least node of its component. Links to itself or null are none."""
    files = 1 + links.count() // FILE_EDGES
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    edges = written(edges.coalesce(files), "cc")
    last = None
    while True:
        before, edges = edges, written(_star(_star(edges, True), False).coalesce(files), "cc")
        let_go(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()).coalesce(files)
