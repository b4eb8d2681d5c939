"""Connected components of an edge list by alternating large and small stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def connected(edges: DataFrame) -> DataFrame:
    """(cid, component) for every node of the edges (a, b): the smallest node that it reaches.

    Each round replaces the edges by stars around smaller nodes; rounds end when nothing changes,
    after about the logarithm of the longest path."""
    edges = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written first, here and below: where one node has most of the edges, a join of two plain exchanges can be split.
        least = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")), "least")
        # Large star: every larger neighbour is tied to the smallest one.
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        # What the smallest neighbours leave out: nodes whose own smallest neighbour is below them.
        large = large.unionByName(least.where("low < a").select("a", F.col("low").alias("b"))).distinct()
        large = materialise(large, "large-star")
        # Small star: every smaller neighbour, and the node itself, is tied to the smallest one.
        least = materialise(large.groupBy("a").agg(F.min("b").alias("low")), "least")
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(least.select("a", F.col("low").alias("b")))
        edges = materialise(small.where("a <> b").distinct(), "small-star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("cid"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("cid"), F.col("b").alias("component")).distinct())
        before = now
