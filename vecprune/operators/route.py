"""Routing: to which leaf clusters a vector goes, by a scan of the leaves or by descent from the root."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import matrix, nearest, sq_l2
from .index import Index
from .knn import RANKED, fits, nearest_of, ranked


def route_leaf_scan(vectors: DataFrame, index: Index, keep: int, engine: str = "arrow", carry: bool = False) -> DataFrame:
    """(id, cluster_id, dist, rank) of each vector's ``keep`` nearest leaves; ``carry`` adds its descriptor."""
    return nearest_of(vectors, index.leaves(), keep, engine, carry).withColumnRenamed("target_id", "cluster_id")


class Tree:
    """An index held in memory, for vectorised descent."""

    def __init__(self, index: Index):
        self.height = index.height
        self.ids, self.vectors, self.children = [], [], []
        for level in range(index.height):
            rows = index.level(level).orderBy("id").toArrow()
            self.ids.append(rows.column("id").to_numpy())
            self.vectors.append(matrix(rows.column("descriptor")))
        for level in range(1, index.height):
            ties = index.edges.where(F.col("level") == level - 1).orderBy("parent_id", "child_id").toArrow()
            parent, child = ties.column("parent_id").to_numpy(), np.searchsorted(self.ids[level - 1], ties.column("child_id").to_numpy())
            cuts = np.searchsorted(parent, self.ids[level], side="left"), np.searchsorted(parent, self.ids[level], side="right")
            self.children.append([child[a:b] for a, b in zip(*cuts)])

    def under(self, level: int, node: int) -> np.ndarray:
        """Distinct leaves below a node."""
        rows = np.array([node])
        for below in range(level, 0, -1):
            rows = np.unique(np.concatenate([self.children[below - 1][r] for r in rows])) if len(rows) else rows
        return rows

    def descend(self, x: np.ndarray, keep: int, widen: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of x, leaf id, distance) of up to ``keep`` leaves for each row."""
        top = self.height - 1
        if top == 0:
            return nearest(self.ids[0], self.vectors[0], x, keep)
        rows, found, _ = nearest(np.arange(len(self.ids[top])), self.vectors[top], x, 1)
        at, before = np.full(len(x), -1), np.full(len(x), -1)
        at[rows] = found
        for level in range(top, 1, -1):
            before, at = at, self._step(level, at, x)
        out = []
        for node in np.unique(at[at >= 0]):
            own = np.flatnonzero(at == node)
            leaves = self.children[0][node]
            if widen and len(leaves) < keep:
                wide = {p: self.under(2, p) if p >= 0 else np.arange(len(self.ids[0])) for p in np.unique(before[own])}
            else:
                wide = {None: leaves}
            for p, leaves in wide.items():
                mine = own if p is None else own[before[own] == p]
                r, ids, d = nearest(self.ids[0][leaves], self.vectors[0][leaves], x[mine], keep)
                out.append((mine[r], ids, d))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return tuple(np.concatenate([o[i] for o in out]) for i in range(3))

    def _step(self, level: int, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.full(len(at), -1)
        for node in np.unique(at[at >= 0]):
            own, kids = np.flatnonzero(at == node), self.children[level - 1][node]
            rows, found, _ = nearest(kids, self.vectors[level - 1][kids], x[own], 1)
            out[own[rows]] = found
        return out


def route_greedy(vectors: DataFrame, index: Index, keep: int, widen: bool = False, engine: str = "arrow", carry: bool = False) -> DataFrame:
    """(id, cluster_id, dist, rank), and the descriptor with ``carry``: descent to the nearest child at every level, then the ``keep`` nearest leaf children.

    ``widen``: where the last node has fewer children, all leaves under the node before it are considered, once; with two
    levels that node is the root. An index of up to ``MAX_BROADCAST_BYTES`` goes to every task; a larger one is joined
    level by level.
    """
    kept = ["id", "cluster_id", "dist", "rank", *(["descriptor"] if carry else [])]
    if engine == "arrow" and fits(index.nodes):
        held = vectors.sparkSession.sparkContext.broadcast(Tree(index))

        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, ids, dist = held.value.descend(matrix(batch.column("descriptor")), keep, widen)
                order = np.lexsort((ids, dist, rows))
                yield ranked(batch, rows[order], ids[order], dist[order], kept)

        return vectors.select("id", "descriptor").mapInArrow(kernel, RANKED.format("cluster_id") + (", descriptor array<float>" if carry else ""))
    return _greedy_joins(vectors.select("id", "descriptor"), index, keep, widen, engine).select(kept)


def _greedy_joins(vectors: DataFrame, index: Index, keep: int, widen: bool, engine: str) -> DataFrame:
    """The same descent as one join a level: vectors at a node with the node's children."""
    top = index.height - 1
    if top == 0:
        return route_leaf_scan(vectors, index, keep, engine, True)
    now = nearest_of(vectors, index.level(top), 1, engine, True).select("id", "descriptor", F.col("target_id").alias("_at"), F.lit(None).cast("long").alias("_before"))
    for level in range(top, 1, -1):
        lists = index.children(level).withColumnRenamed("parent_id", "_at")
        best = F.array_min(F.transform("children", lambda c: F.struct(sq_l2(c["descriptor"], F.col("descriptor")).alias("dist"), c["id"].alias("id"))))
        now = now.join(lists, "_at").select("id", "descriptor", best["id"].alias("_next"), F.col("_at").alias("_before"))
        now = now.where("_next IS NOT NULL").withColumnRenamed("_next", "_at")
    last = index.children(1).withColumnRenamed("parent_id", "_at")
    now = now.join(last, "_at")
    if widen:
        if index.height > 2:
            below = index.edges.where("level = 1").select(F.col("parent_id").alias("_before"), F.col("child_id").alias("_mid")).join(index.edges.where("level = 0"), F.col("_mid") == F.col("parent_id")).select("_before", "child_id").distinct()
        else:
            below = index.leaves().select(F.lit(None).cast("long").alias("_before"), F.col("id").alias("child_id"))
        below = below.join(index.leaves(), F.col("child_id") == F.col("id")).groupBy("_before").agg(F.array_sort(F.collect_list(F.struct("id", F.col("descriptor")))).alias("_wide"))
        now = now.join(below, now["_before"].eqNullSafe(below["_before"]), "left").drop(below["_before"])
        now = now.withColumn("children", F.when(F.size("children") < keep, F.col("_wide")).otherwise(F.col("children")))
    scored = F.transform("children", lambda c: F.struct(sq_l2(c["descriptor"], F.col("descriptor")).alias("dist"), c["id"].alias("cluster_id")))
    chosen = F.slice(F.array_sort(scored), 1, keep)
    return now.select("id", "descriptor", F.posexplode(chosen).alias("_pos", "_c")).select("id", "_c.cluster_id", "_c.dist", (F.col("_pos") + 1).alias("rank"), "descriptor")


def assign(points: DataFrame, index: Index, a: int = 1, engine: str = "arrow") -> DataFrame:
    """(point_id, descriptor, cluster_id): every point in up to ``a`` clusters, by descent. Points aren't shuffled."""
    routed = route_greedy(points.select(F.col("point_id").alias("id"), "descriptor"), index, a, False, engine, True)
    return routed.select(F.col("id").alias("point_id"), "descriptor", "cluster_id")


def random_cluster(point_id, clusters: int):
    """A cluster from 1 to ``clusters`` by a hash of the id."""
    mixed = F.pmod(F.pmod(point_id, F.lit(2**31)) * F.lit(2654435761), F.lit(2**32))
    return F.floor(mixed / 65536).cast("long") % clusters + 1


def assign_random(points: DataFrame, clusters: int) -> DataFrame:
    """(point_id, descriptor, cluster_id) with clusters that only cut the table into chunks."""
    return points.select("point_id", "descriptor", random_cluster(F.col("point_id"), clusters).alias("cluster_id"))


def unwritten_leaders(index: Index, assignments: DataFrame) -> DataFrame:
    """(node_id) of the leaves whose cluster has no point."""
    return index.leaves().select(F.col("id").alias("node_id")).join(assignments.select(F.col("cluster_id").alias("node_id")).distinct(), "node_id", "left_anti")


def rank_routes(routes: DataFrame) -> DataFrame:
    """``routes`` (id, cluster_id, dist) with rank by (dist, cluster_id)."""
    return routes.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("dist", "cluster_id")))
