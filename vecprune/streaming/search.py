"""Streams of queries: each micro-batch runs the batch operators, and its results replace any of an earlier attempt."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import Index
from ..operators.knn import exact_knn
from ..operators.search import index_knn, index_knn_files, routes_of

log = logging.getLogger(__name__)


def search_stream(queries: DataFrame, search: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, partitions: int | None = None) -> StreamingQuery:
    """Run ``search`` on every micro-batch of ``queries`` (query_id, descriptor); results go to ``out``, one folder a batch.

    All that is there when the stream starts is processed, then it ends. latency_ms is the time from the start of a
    batch's search to its end.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        began = time.time()
        batch = batch.repartition(partitions) if partitions else batch
        path = f"{out}/batch={batch_id}"
        search(batch).withColumn("start_ms", F.lit(int(began * 1000))).write.mode("overwrite").parquet(path)
        took = int((time.time() - began) * 1000)
        batch.sparkSession.range(1).select(F.lit(batch_id).cast("long").alias("id"), F.lit(took).cast("long").alias("latency_ms")).write.mode("overwrite").parquet(f"{out}-latency/batch={batch_id}")
        log.info("batch %d took %d ms", batch_id, took)

    return queries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_exact(queries: DataFrame, points: DataFrame, k: int, out: str, checkpoint: str, engine: str = "arrow", **options) -> StreamingQuery:
    return search_stream(queries, lambda q: exact_knn(points, q, k, engine), out, checkpoint, **options)


def stream_index(queries: DataFrame, assignments: DataFrame | str, index: Index, b: int, k: int, out: str, checkpoint: str, routing: str = "widen", keep_empty: bool = True, **options) -> StreamingQuery:
    """``assignments``: a table, or the path of a cluster table, of which a batch opens only the files that it needs."""

    def search(q: DataFrame) -> DataFrame:
        routes = routes_of(q, index, b, routing)
        if isinstance(assignments, str):
            return index_knn_files(q.sparkSession, assignments, routes, k, keep_empty)
        return index_knn(assignments, routes, k, keep_empty)

    return search_stream(queries, search, out, checkpoint, **options)


def latencies(found: DataFrame, out: str) -> DataFrame:
    """(query_id, latency_ms) of every query that was answered under ``out``: its own batch's."""
    of_batch = found.sparkSession.read.parquet(f"{out}-latency").select(F.col("id").alias("batch"), "latency_ms")
    return found.select("query_id", F.col("batch").cast("long").alias("batch")).distinct().join(F.broadcast(of_batch), "batch").groupBy("query_id").agg(F.max("latency_ms").alias("latency_ms"))
