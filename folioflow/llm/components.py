"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.frames import written


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(links: DataFrame) -> DataFrame:
    """node and root: the smallest node reachable over the links (a, b). Nodes without links are left out.

    Each round is written to the shared folder; the number of rounds grows with the logarithm of the longest chain.
    A node with very many links is no group of rows in one task: minima are combined in the map tasks and joined back.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(edges, "edges")
    seen = _mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = written(large, "large")
        lower = written(large.groupBy("a").agg(F.min("b").alias("m")), "lower")
        small = large.join(lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(lower.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        edges = written(small, "edges")
        now = _mark(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
