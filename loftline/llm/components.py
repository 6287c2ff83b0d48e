"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b): long.  Returns (node, root) for each node of an edge that isn't its component's smallest.

    Loops and repeated edges count once; null ends are ignored; no edge gives no row.  Each round shuffles the edges
    only.  A hub's edges pass as map-side minima and as the long side of a join on the hub, which Spark splits.
    """
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = staged(edges.where("a < b").distinct(), "edges")
    before = _digest(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").distinct()
        large = staged(large, "edges")
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        moved = large.join(least, "b").where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        last, edges = edges, staged(moved.unionByName(least.select(F.col("m").alias("a"), "b")).distinct(), "edges")
        discard(last, large)
        now = _digest(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
