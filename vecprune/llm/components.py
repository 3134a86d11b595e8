"""Distributed union-find: connected components by alternating large and small stars.

Every round is a few joins and minima over the edges, each round's edges are written to the shared folder, and no group is
gathered: a node of very many edges is a minimum with map-side aggregation and a join whose skew Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _done(edges: DataFrame) -> bool:
    """Whether every node has one edge, to a root that has none."""
    n = edges.agg(F.count("*").alias("n"), F.countDistinct("a").alias("a")).first()
    return n["n"] == n["a"] and edges.select(F.col("b").alias("a")).join(edges.select("a"), "a", "left_semi").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges(a, b)``; root is the component's smallest node."""
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while not _done(now):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, "large-star")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(moved.union(down.select("a", F.col("m").alias("b"))).distinct(), "small-star")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
