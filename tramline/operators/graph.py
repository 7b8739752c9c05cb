"""Connected parts of graphs, by rounds over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that each node of the edges a, b is connected with.

    Each round links every node's neighbours to its smallest neighbour (large star, then small star), which at least
    halves what is left to contract; a round's edges are written, so that plans stay short and lost executors cost
    little. Joins, not groups, gather neighbours, so that a node with very many of them is dealt to many tasks. Rounds go
    on until one changes nothing.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.where("a <> b").distinct(), "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        after = materialize(small.where("a <> b").distinct(), "edges")
        changed = after.join(edges, ["a", "b"], "left_anti").limit(1).count() or edges.join(after, ["a", "b"], "left_anti").limit(1).count()
        edges = after
        if not changed:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
