"""Command line: batch and streaming jobs.

    python -m vecprune.job batch --method index --base base.fvecs --query query.fvecs --truth truth.ivecs --output scores
    python -m vecprune.job stream --method index --recluster true --clusters work/clusters --index work/index ...

Paths are read as vector files by their extension, else as parquet with the engine's column names.
"""

from __future__ import annotations

import argparse
import logging
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.evaluate import score, score_lines
from .operators.index import Index, build_index, sizes
from .operators.knn import collect_nn, exact_knn
from .operators.route import assign, assign_random, unwritten_leaders
from .operators.search import index_knn, routes_of
from .operators.sampling import IO_GRANULARITY, RECORD_BYTES
from .plans.sink import write_scores
from .plans.stage import new_path, written
from .sources.clusters import BUCKETS, POINTS_OF_BUCKET, read_clusters, write_clusters, written_clusters
from .sources.vecs import COMPONENT, read_vecs, register
from .streaming.search import latencies, stream_exact, stream_index

log = logging.getLogger(__name__)


def arguments(args: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="vecprune")
    p.add_argument("mode", choices=["batch", "stream"])
    p.add_argument("--method", choices=["scan", "index"], required=True)
    for name in ("base", "query", "truth", "output"):
        p.add_argument(f"--{name}", required=True)
    for name, value in (("L", 2), ("treeA", 3), ("a", 1), ("b", 5), ("k", 100), ("reduction", 1), ("seed", 0), ("record-bytes", RECORD_BYTES), ("io-granularity", IO_GRANULARITY)):
        p.add_argument(f"--{name}", type=int, default=value)
    p.add_argument("--routing", choices=["leaf_scan", "greedy", "widen"], help="leaf_scan in batch, widen in streams if not given")
    p.add_argument("--recluster", choices=["true", "false"], help="streams: build the cluster table, or use the one there")
    p.add_argument("--clusterSize", type=int, help="streams that scan: number of random clusters")
    p.add_argument("--clusters", help="streams: where the cluster table is")
    p.add_argument("--index", help="streams: where the index is")
    out = p.parse_args(args)
    if out.mode == "stream":
        if out.recluster is None or not out.clusters:
            p.error("streams need --recluster and --clusters")
        if out.method == "scan" and out.recluster == "true" and not out.clusterSize:
            p.error("a scan that reclusters needs --clusterSize")
        if out.method == "index" and not out.index:
            p.error("a stream with an index needs --index")
    return out


def _read(spark: SparkSession, path: str, reduction: int = 1) -> DataFrame:
    if path.rstrip("/").rpartition(".")[2] in COMPONENT:
        return read_vecs(spark, path, reduction=reduction)
    rows = spark.read.parquet(path)
    return prefix(rows, reduction) if reduction > 1 else rows


def prefix(points: DataFrame, reduction: int) -> DataFrame:
    """The first 1/reduction of the points, by their dense ids."""
    return points.where(F.col("point_id") < points.count() // reduction)


def _as_queries(points: DataFrame) -> DataFrame:
    return points.select(F.col("point_id").alias("query_id"), "descriptor")


def run(spark: SparkSession, o: argparse.Namespace) -> None:
    truth = _read(spark, o.truth)
    base = _read(spark, o.base, o.reduction)
    began = time.time()
    if o.mode == "batch":
        queries = _as_queries(_read(spark, o.query))
        if o.method == "scan":
            found = exact_knn(base, queries, o.k)
        else:
            index = build_index(base, o.L, o.treeA, o.seed, o.record_bytes, o.io_granularity)
            for r in sizes(index).orderBy("level").collect():
                log.info("level %d: %d nodes, %d expected", r["level"], r["actual"], r["expected"])
            found = index_knn(assign(base, index, o.a), routes_of(queries, index, o.b, o.routing or "leaf_scan"), o.k)
        found = written(collect_nn(found), "found")  # the search runs here, so that the time that follows covers it
        took = int((time.time() - began) * 1000)
        log.info("searched in %.1f s", took / 1000)
        write_scores(score_lines(score(found, truth), o.k, F.lit(took)), o.output)
        return
    buckets = max(BUCKETS, base.count() // POINTS_OF_BUCKET) if o.recluster == "true" else BUCKETS
    if o.method == "scan":
        if o.recluster == "true":
            write_clusters(assign_random(base, o.clusterSize), o.clusters, buckets)
    elif o.recluster == "true":
        index = build_index(base, o.L, o.treeA, o.seed, o.record_bytes, o.io_granularity)
        index.save(o.index)
        assigned = assign(base, index, o.a)
        write_clusters(assigned, o.clusters, buckets)
        log.info("clustered %d points in %.1f s", index.n_points, time.time() - began)
    points = read_clusters(spark, o.clusters)
    if o.method == "index":
        missing = unwritten_leaders(Index.load(spark, o.index), written_clusters(spark, o.clusters)).count()
        if missing:
            log.warning("%d leaders have no cluster file", missing)
    out, checkpoint = new_path(spark, "stream-out"), new_path(spark, "stream-checkpoint")
    register(spark)
    if o.query.rpartition(".")[2] in COMPONENT:
        stream = spark.readStream.format("vecs").load(o.query)
    else:
        stream = spark.readStream.schema(spark.read.parquet(o.query).schema).parquet(o.query)
    if o.method == "scan":
        query = stream_exact(_as_queries(stream), points, o.k, out, checkpoint)
    else:
        query = stream_index(_as_queries(stream), o.clusters, Index.load(spark, o.index), o.b, o.k, out, checkpoint, o.routing or "widen")
    query.awaitTermination()
    found = spark.read.parquet(out)
    scored = score(collect_nn(found), truth).join(latencies(found, out), "query_id")
    write_scores(score_lines(scored, o.k, F.col("latency_ms")), o.output)


def main(args: list[str] | None = None) -> None:
    logging.basicConfig(level=logging.INFO)
    o = arguments(args)
    run(SparkSession.builder.appName("vecprune").getOrCreate(), o)


if __name__ == "__main__":
    main()
