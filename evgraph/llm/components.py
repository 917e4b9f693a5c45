"""Connected components of an edge table by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evgraph.llm.shared import store


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours to the smallest of them and it: larger ones (large) or the node and smaller ones."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low"))
    seen = both.join(least, "u")
    if large:
        out = seen.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        out = seen.select(F.col("v").alias("u"), F.col("low").alias("v")).union(least.select("u", F.col("low").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of each node of the edges (u, v), by the smallest node that links reach.

    Each round is a fixed number of joins, and edges stay as many at most; rounds grow with the logarithm of the number of nodes.
    Each round's edges are written to the shared folder, which cuts lineage.
    """
    edges = store(edges.select("u", "v").filter(F.col("u") != F.col("v")).distinct(), "links")
    check = None
    while True:
        edges = store(_star(_star(edges, True), False), "links")
        total = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(total) == check or not total[0]:
            break
        check = tuple(total)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
