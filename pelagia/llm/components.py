"""Connected components of a link table, by alternating large-star and small-star steps over Spark joins.

Only (node, root) tables are kept, each step written to the shared folder; nothing is collected but a count. A node
with a third of all links is aggregated map-side; the sums are written before they are joined, so Spark can split its join side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pelagia.session import written


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (x, y): root is the least node that links reach."""
    edges = written(links.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u <> v").distinct())
    if not edges.head(1):
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        # large star: each larger neighbour of a node, and the node's least neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        # small star: each smaller neighbour, and the node itself, to the least smaller neighbour
        least = written(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = written(small.where("u <> v").distinct())
        # done when every node has one parent, which has none
        ends = edges.select(F.col("u").alias("k"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(edges.select(F.col("v").alias("k"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
        open_ = ends.groupBy("k").agg(F.sum("child").alias("child"), F.max("parent").alias("parent")).where("child > 1 or (child = 1 and parent = 1)")
        if not open_.limit(1).count():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
