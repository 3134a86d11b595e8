"""The index: levels of leaders, each node tied to its nearest nodes a level up.

Nodes and edges are two tables, as a node has several parents. Level 0 holds the leaves; the root is virtual, at level
``height``, over all nodes of the level below it.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.stage import written
from .knn import nearest_of
from .sampling import IO_GRANULARITY, RECORD_BYTES, expected_size, sample_leaves, sample_nodes


@dataclass
class Index:
    nodes: DataFrame  # level, node_id, descriptor
    edges: DataFrame  # level (of the child), parent_id, child_id
    height: int
    n_points: int
    record_bytes: int = RECORD_BYTES
    io_granularity: int = IO_GRANULARITY

    def level(self, level: int) -> DataFrame:
        """id, descriptor of the nodes of a level."""
        return self.nodes.where(F.col("level") == level).select(F.col("node_id").alias("id"), "descriptor")

    def leaves(self) -> DataFrame:
        return self.level(0)

    def children(self, level: int) -> DataFrame:
        """parent_id, children (array of (id, descriptor) structs) of the nodes of ``level``; childless nodes have none."""
        below = self.level(level - 1)
        tied = self.edges.where(F.col("level") == level - 1).join(below, F.col("child_id") == F.col("id"))
        lists = tied.groupBy("parent_id").agg(F.array_sort(F.collect_list(F.struct("id", "descriptor"))).alias("children"))
        own = self.level(level).select(F.col("id").alias("parent_id"))
        return own.join(lists, "parent_id", "left").select("parent_id", F.coalesce("children", F.array().cast(lists.schema["children"].dataType)).alias("children"))

    def save(self, path: str, mode: str = "errorifexists") -> None:
        """Nodes, edges and parameters under ``path``, so that the tree itself can be loaded again."""
        self.nodes.write.mode(mode).parquet(f"{path}/nodes")
        self.edges.write.mode(mode).parquet(f"{path}/edges")
        about = json.dumps({"height": self.height, "n_points": self.n_points, "record_bytes": self.record_bytes, "io_granularity": self.io_granularity})
        self.nodes.sparkSession.range(1).select(F.lit(about).alias("value")).write.mode(mode).text(f"{path}/about")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        about = json.loads(spark.read.text(f"{path}/about").first()["value"])
        return Index(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"), **about)


def find_parents(nodes: DataFrame, above: DataFrame, tree_a: int, engine: str = "arrow") -> DataFrame:
    """(parent_id, child_id) of each node's ``tree_a`` nearest nodes a level up."""
    return nearest_of(nodes, above, tree_a, engine).select(F.col("target_id").alias("parent_id"), F.col("id").alias("child_id"))


def find_children(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, children) of every node; an empty list for a node that is nobody's parent."""
    lists = edges.groupBy("parent_id").agg(F.array_sort(F.collect_list("child_id")).alias("children"))
    joined = nodes.select(F.col("id").alias("node_id")).join(lists.withColumnRenamed("parent_id", "node_id"), "node_id", "left")
    return joined.select("node_id", F.coalesce("children", F.array().cast("array<bigint>")).alias("children"))


def build_index(points: DataFrame, height: int = 2, tree_a: int = 3, seed: int = 0, record_bytes: int = RECORD_BYTES, io_granularity: int = IO_GRANULARITY, engine: str = "arrow") -> Index:
    """An index of ``height`` levels below the root over ``points`` (point_id, descriptor)."""
    if height < 1:
        raise ValueError("an index has one level at least")
    base = points.select(F.col("point_id").alias("id"), "descriptor")
    n = base.count()
    current = written(sample_leaves(base, n, seed, record_bytes, io_granularity), "leaves")
    levels, edges = [current], []
    for level in range(1, height):
        above = written(sample_nodes(current, current.count(), n, level, height, seed), "nodes")
        edges.append(written(find_parents(current, above, tree_a, engine).select(F.lit(level - 1).alias("level"), "parent_id", "child_id"), "edges"))
        levels.append(above)
        current = above
    spark = points.sparkSession
    nodes = None
    for level, rows in enumerate(levels):
        rows = rows.select(F.lit(level).alias("level"), F.col("id").alias("node_id"), "descriptor")
        nodes = rows if nodes is None else nodes.union(rows)
    ties = spark.createDataFrame([], "level int, parent_id long, child_id long")
    for e in edges:
        ties = ties.union(e)
    return Index(nodes, ties, height, n, record_bytes, io_granularity)


def sizes(index: Index) -> DataFrame:
    """(level, actual, expected) of every level; distinct nodes, however many paths lead to them."""
    actual = index.nodes.groupBy("level").agg(F.countDistinct("node_id").alias("actual"))
    expected = [(level, expected_size(index.n_points, level, index.height, index.record_bytes, index.io_granularity)) for level in range(index.height)]
    return actual.join(F.broadcast(index.nodes.sparkSession.createDataFrame(expected, "level int, expected long")), "level")


def paths(index: Index, level: int = 0) -> DataFrame:
    """(node_id, paths): how many ways lead from the root to each node of a level."""
    now = index.level(index.height - 1).select(F.col("id").alias("node_id"), F.lit(1).cast("long").alias("paths"))
    for below in range(index.height - 2, level - 1, -1):
        down = index.edges.where(F.col("level") == below)
        now = down.join(now, F.col("parent_id") == F.col("node_id")).groupBy("child_id").agg(F.sum("paths").alias("paths")).withColumnRenamed("child_id", "node_id")
    return now


def visits(index: Index, level: int) -> DataFrame:
    """The nodes of a level as a walk from the root meets them: once for each path."""
    return paths(index, level).select(F.explode(F.expr("array_repeat(node_id, cast(paths as int))")).alias("node_id"))
