"""Connected components by minimum labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.lineage import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the least node that can be reached. Large-star and small-star steps until
    nothing changes, each written to the shared folder; their number grows with the logarithm of a component's length."""
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    before = None
    while True:
        # large star: every larger neighbour of a node is linked to the node's least neighbour (or to itself)
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").distinct()
        # small star: every smaller neighbour of a node, and the node, are linked to the least of them
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).filter("a <> b").distinct()
        edges = cut(small, "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        before = now
