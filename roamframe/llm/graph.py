"""Connected components of an edge list, as joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of every node that has an edge (a, b); root is the smallest node reachable.

    Alternates two steps until nothing changes: every node's larger neighbours are linked to the smallest of
    its neighbourhood, then every node and its smaller neighbours are linked to the smallest of those. A
    neighbourhood is only ever reduced to its minimum, never gathered; each round is written to shared storage.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges, name)
    mark = None
    while True:
        # Large star, over both directions.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star, over larger to smaller.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = materialize(small.select("e.*").where("a <> b").distinct(), name)
        # A forest of stars has no node that is both a leaf and a centre; sums tell whether a round changed nothing.
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = now
