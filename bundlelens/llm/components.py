"""Distributed union-find over a table of links."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bundlelens.llm.common import hold


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``component`` (the least node reachable) of every node with a link to another, the component's own name included.

    Alternates two steps until the links no longer change, at which point each node is linked with its component only:
    every node's larger neighbours are linked with its least neighbour, then its smaller ones are. Least neighbours come
    from a pre-aggregated group and a join, so a node with very many links is never gathered. Each pass is a written table.
    A null or self link joins nothing. The number of passes grows with the logarithm of the longest chain.
    """
    edges = hold(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct())
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = hold(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            roots = edges.select(F.col("b").alias("a"), "b").distinct()
            return edges.unionByName(roots).select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark = now
