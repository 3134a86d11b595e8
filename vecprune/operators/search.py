"""Cluster-pruned search: every query visits its clusters only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.stage import written
from ..sources.clusters import read_clusters
from .index import Index
from .knn import pair_distances, topk
from .route import route_greedy, route_leaf_scan


def routes_of(queries: DataFrame, index: Index, b: int, routing: str = "leaf_scan", engine: str = "arrow") -> DataFrame:
    """(query_id, descriptor, cluster_id, rank): the ``b`` clusters of each query. ``routing``: leaf_scan, greedy or widen."""
    vectors = queries.select(F.col("query_id").alias("id"), "descriptor")
    if routing == "leaf_scan":
        found = route_leaf_scan(vectors, index, b, engine, True)
    elif routing in ("greedy", "widen"):
        found = route_greedy(vectors, index, b, routing == "widen", engine, True)
    else:
        raise ValueError(f"routing is leaf_scan, greedy or widen, not {routing}")
    return found.select(F.col("id").alias("query_id"), "descriptor", "cluster_id", "rank")


def index_knn(assignments: DataFrame, routes: DataFrame, k: int, keep_empty: bool = False, engine: str = "arrow") -> DataFrame:
    """(query_id, point_id, dist, rank) of the k nearest points in each query's clusters.

    A cluster without points is dropped after the routes are cut to b, so a query may visit fewer. A point in several of
    a query's clusters counts once: each cluster gives its own k nearest, and repeats go from those few.
    ``keep_empty``: a query without any candidate gets a row of nulls.
    """
    points = assignments.select("cluster_id", "point_id", F.col("descriptor").alias("_p"))
    pairs = routes.select("cluster_id", "query_id", F.col("descriptor").alias("_q")).join(points, "cluster_id")
    of_each = topk(pair_distances(pairs, "_q", "_p", ["query_id", "cluster_id", "point_id"], engine), k, ["query_id", "cluster_id"])
    found = topk(of_each.select("query_id", "point_id", "dist").repartition("query_id").distinct(), k)
    if not keep_empty:
        return found
    return routes.select("query_id").distinct().join(found, "query_id", "left").select("query_id", "point_id", "dist", "rank")


#: Clusters that a scan is told by name; beyond, it reads all files.
MAX_NAMED_CLUSTERS = 10_000


def index_knn_files(spark: SparkSession, path: str, routes: DataFrame, k: int, keep_empty: bool = False, engine: str = "arrow") -> DataFrame:
    """``index_knn`` over a written cluster table, of which only the files of the routed clusters are opened."""
    routes = written(routes, "routes")
    named = [r["cluster_id"] for r in routes.select("cluster_id").distinct().limit(MAX_NAMED_CLUSTERS + 1).collect()]
    points = read_clusters(spark, path, named if len(named) <= MAX_NAMED_CLUSTERS else None)
    return index_knn(points, routes, k, keep_empty, engine)
