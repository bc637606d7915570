"""Connected components of a graph given as edges, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitbook.session import settle


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour or itself."""
    both = _both(edges)
    lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    lowest = settle(lowest, edges.sparkSession, "lowest")
    return both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = settle(down.groupBy("u").agg(F.min("v").alias("m")), edges.sparkSession, "lowest")
    moved = down.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """node, root for every node that has an edge to another; root is its component's smallest.

    `edges` has columns u and v of one orderable type; loops, repeats and edges with a null end
    are ignored. Each round is written to the shared folder. A node with very many edges is
    only ever a join key: what it is joined with is written out first, so its edges come from an
    exchange of their own, which adaptive execution may split.
    """
    now = settle(edges.select("u", "v").where("u <> v").distinct(), spark, "edges")
    while True:
        now = settle(_small_star(_large_star(now)), spark, "edges")
        # Done when every node hangs on one root, and no root hangs on another.
        tall = now.join(now.select(F.col("u").alias("v")), "v", "left_semi")
        if tall.isEmpty() and now.groupBy("u").count().where("count > 1").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
