"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm import common


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """`u` and the least node `v` reachable from it, for every node that is not the least itself.

    `edges` has nodes `u` > `v`, without nulls, and may repeat them. Rounds of two
    steps bring every edge to the least node of its component; each round is
    stored, and their number grows with the logarithm of the longest path. The least neighbour
    is a partial minimum; a node of many neighbours is split by the adaptive skew
    join.
    """
    now = edges.select("u", "v")
    while True:
        now = common.stored(_small_star(_large_star(now)).distinct())
        if _settled(now):
            return now


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge, to a node that has none to a smaller one."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(
        edges.select("v", F.lit(0), F.lit(1))
    )
    nodes = ends.groupBy("n").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return nodes.filter("out > 1 OR (out = 1 AND into = 1)").isEmpty()
