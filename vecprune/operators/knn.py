"""Exact nearest neighbours: scan, top-k, collecting and merging of lists."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import matrix, nearest, sq_l2, sq_l2_pairs, sq_l2_wide

#: Bytes of vectors that a task may hold of a broadcast side; beyond, both sides are dealt into blocks of ``BLOCK_BYTES``.
MAX_BROADCAST_BYTES = 128 << 20
BLOCK_BYTES = 16 << 20
#: Components compared in a task of the scan in built-in functions.
PAIRS_A_TASK = 1 << 30


def extent(vectors: DataFrame) -> tuple[int, int]:
    """Rows, and bytes of a row: an id and 32-bit floats."""
    found = vectors.agg(F.count("*").alias("n"), F.max(F.size("descriptor")).alias("dim")).first()
    return found["n"], 8 + 4 * (found["dim"] or 0)


def fits(vectors: DataFrame) -> bool:
    """Whether every task may hold all of ``vectors``."""
    n, width = extent(vectors)
    return n * width <= MAX_BROADCAST_BYTES


def topk(candidates: DataFrame, k: int, by: str | list[str] = "query_id", item: str = "point_id") -> DataFrame:
    """Each group's k nearest by (dist, item), with rank from 1. Catalyst limits groups before the shuffle as well."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy("dist", item))
    return candidates.withColumn("rank", rank).where(F.col("rank") <= k)


def collect_nn(ranked: DataFrame, by: str = "query_id", item: str = "point_id") -> DataFrame:
    """One row per query: nn, an array of (dist, point_id) structs, nearest first."""
    return ranked.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("dist", F.col(item).alias("point_id")))).alias("nn"))


def merge_nn(a: Column | str, b: Column | str, k: int) -> Column:
    """The k nearest of two lists without repeats."""
    return F.slice(F.array_sort(F.array_distinct(F.concat(a, b))), 1, k)


def cross_distances(points: DataFrame, queries: DataFrame) -> DataFrame:
    """All (query_id, point_id, dist). Queries are broadcast if they're small enough by a count."""
    q = queries.select("query_id", F.col("descriptor").alias("_q"))
    return points.crossJoin(F.broadcast(q) if fits(queries) else q).select("query_id", "point_id", sq_l2("_q", "descriptor").alias("dist"))


def pair_distances(pairs: DataFrame, a: str, b: str, keep: list[str], engine: str = "arrow") -> DataFrame:
    """``keep`` and dist of joined rows that hold both vectors."""
    if engine == "sql":
        return pairs.select(*keep, sq_l2(a, b).alias("dist"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dist = sq_l2_pairs(matrix(batch.column(a)), matrix(batch.column(b))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(dist)], names=[*keep, "dist"])

    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    return pairs.select(*dict.fromkeys([*keep, a, b])).mapInArrow(kernel, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", dist double")


def exact_knn(points: DataFrame, queries: DataFrame, k: int, engine: str = "arrow") -> DataFrame:
    """(query_id, point_id, dist, rank) of each query's k nearest points.

    Up to ``MAX_BROADCAST_BYTES`` of queries go to every task and the points stream past them, each batch giving its k best a
    query; more queries are dealt into blocks. Either way one shuffle by query_id merges the partial lists.
    """
    points, queries = points.select("point_id", "descriptor"), queries.select("query_id", "descriptor")
    if not fits(queries):
        return topk(_in_blocks(points, queries, k), k)
    if engine == "sql":
        return _by_bounds(points, queries, k)
    asked = queries.toArrow()
    ids, vectors = asked.column("query_id").to_numpy(), matrix(asked.column("descriptor"))
    held = points.sparkSession.sparkContext.broadcast((ids, vectors))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, q = held.value
        for batch in batches:
            rows, found, dist = nearest(batch.column("point_id").to_numpy(), matrix(batch.column("descriptor")), q, k)
            yield pa.RecordBatch.from_arrays([pa.array(query_ids[rows]), pa.array(found), pa.array(dist)], names=["query_id", "point_id", "dist"])

    return topk(points.mapInArrow(kernel, "query_id long, point_id long, dist double"), k)


def _by_bounds(points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The lists in built-in functions only, without sorting all pairs.

    A query's k-th pair by (dist, point_id) among some of the points is a bound on its k-th among all. Some sqrt(n * k)
    points, by a hash of their ids, give the bounds; then every point meets every query, and only pairs up to the bound
    are ranked: some sqrt(n * k) a query, whatever the vectors and however many are equal. A query without a bound keeps
    all its pairs.
    """
    n, dim, regular = _shape(points)
    asked, asked_dim, asked_regular = _shape(queries)
    if not (n and asked and dim == asked_dim and regular and asked_regular and 2 * asked * (8 + 4 * dim) <= MAX_BROADCAST_BYTES):
        return topk(cross_distances(points, queries), k)
    tasks = max(2 * points.sparkSession.sparkContext.defaultParallelism, -(-n * asked * dim // PAIRS_A_TASK))
    p = _wide(points, "point_id", "p", dim).repartition(min(tasks, n), "point_id")
    q = _wide(queries, "query_id", "q", dim)
    dist = sq_l2_wide([f"p{i}" for i in range(dim)], [f"q{i}" for i in range(dim)])
    some = p.where(F.pmod(F.xxhash64("point_id"), F.lit(max(1, math.isqrt(n // max(1, k))))) == 0)
    tried = topk(some.crossJoin(F.broadcast(q)).select("query_id", "point_id", dist.alias("dist")), k)
    bounds = tried.where(F.col("rank") == k).select("query_id", F.col("dist").alias("_far"), F.col("point_id").alias("_last"))
    bounded = q.join(bounds, "query_id", "left")
    near = F.col("_far").isNull() | (dist <= F.col("_far"))
    found = p.join(F.broadcast(bounded), near).select("query_id", "point_id", dist.alias("dist"), "_far", "_last")
    return topk(found.where("_far IS NULL OR dist < _far OR point_id <= _last").select("query_id", "point_id", "dist"), k)


def _shape(vectors: DataFrame) -> tuple[int, int, bool]:
    """Rows, the longest vector, and whether all vectors are as long, without a null."""
    whole = F.coalesce(F.size("descriptor") - F.size(F.array_compact("descriptor")) == 0, F.lit(False))
    found = vectors.agg(F.count("*").alias("n"), F.max(F.size("descriptor")).alias("most"), F.min(F.size("descriptor")).alias("least"), F.bool_and(whole).alias("whole")).first()
    return found["n"], found["most"] or 0, found["most"] == found["least"] and bool(found["whole"]) and found["most"] > 0


def _wide(vectors: DataFrame, key: str, prefix: str, dim: int) -> DataFrame:
    """``key`` and a column a component, which Spark knows to hold no null."""
    return vectors.select(key, *[F.coalesce(F.get("descriptor", F.lit(i)), F.lit(0.0).cast("float")).alias(f"{prefix}{i}") for i in range(dim)])


def _in_blocks(points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Partial lists from every pair of a block of points and a block of queries, each of bounded size."""
    rows, cols = (max(1, -(-n * width // BLOCK_BYTES)) for n, width in (extent(points), extent(queries)))
    p = points.withColumn("_b", F.pmod(F.xxhash64("point_id"), F.lit(rows)).cast("int")).withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    q = queries.withColumn("_q", F.pmod(F.xxhash64("query_id"), F.lit(cols)).cast("int")).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))

    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "point_id": pd.Series(dtype="int64"), "dist": pd.Series(dtype="float64")})
        found, ids, dist = nearest(left["point_id"].to_numpy(), np.stack(left["descriptor"]), np.stack(right["descriptor"]), k)
        return pd.DataFrame({"query_id": right["query_id"].to_numpy()[found], "point_id": ids, "dist": dist})

    return p.groupBy("_b", "_q").cogroup(q.groupBy("_b", "_q")).applyInPandas(kernel, "query_id long, point_id long, dist double")


def nearest_of(vectors: DataFrame, targets: DataFrame, k: int, engine: str = "arrow", carry: bool = False) -> DataFrame:
    """(id, target_id, dist, rank) of each vector's k nearest targets; ``carry`` adds the vector's descriptor.

    ``vectors`` and ``targets``: id, descriptor. Targets up to ``MAX_BROADCAST_BYTES`` go to every task and the vectors
    stream past them, so that no vector is shuffled; more are searched in blocks.
    """
    vectors, targets = vectors.select("id", "descriptor"), targets.select("id", "descriptor")
    kept = ["id", "target_id", "dist", "rank", *(["descriptor"] if carry else [])]
    if not fits(targets):
        points, queries = (x.withColumnRenamed("id", name) for x, name in ((targets, "point_id"), (vectors, "query_id")))
        found = topk(_in_blocks(points, queries, k), k).select(F.col("query_id").alias("id"), F.col("point_id").alias("target_id"), "dist", "rank")
        return found.join(vectors, "id").select(kept) if carry else found
    if engine == "sql":
        # The targets are the broadcast side; a vector's distances to all of them stay in its row, so nothing is shuffled.
        lists = targets.agg(F.collect_list(F.struct("id", "descriptor")).alias("_targets"))
        scored = F.transform("_targets", lambda t: F.struct(sq_l2(t["descriptor"], F.col("descriptor")).alias("dist"), t["id"].alias("target_id")))
        best = vectors.crossJoin(F.broadcast(lists)).select("id", "descriptor", F.posexplode(F.slice(F.array_sort(scored), 1, k)).alias("_pos", "_t"))
        return best.select("id", "_t.target_id", "_t.dist", (F.col("_pos") + 1).alias("rank"), "descriptor").select(kept)
    table = targets.toArrow()
    held = vectors.sparkSession.sparkContext.broadcast((table.column("id").to_numpy(), matrix(table.column("descriptor"))))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, t = held.value
        for batch in batches:
            yield ranked(batch, *nearest(ids, t, matrix(batch.column("descriptor")), k), kept)

    return vectors.mapInArrow(kernel, RANKED.format("target_id") + (", descriptor array<float>" if carry else ""))


RANKED = "id long, {} long, dist double, rank int"


def ranked(batch: pa.RecordBatch, rows: np.ndarray, found: np.ndarray, dist: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """Rows of ``batch`` (sorted by row and distance) with what was found for them, and with their vectors if those are named."""
    rank = (np.arange(len(rows)) - np.searchsorted(rows, rows) + 1).astype(np.int32)
    at = pa.array(rows)
    columns = [batch.column("id").take(at), pa.array(found), pa.array(dist), pa.array(rank)]
    return pa.RecordBatch.from_arrays(columns + [batch.column(c).take(at) for c in names[4:]], names=names)
