"""Cluster tables: assigned points on disk, in buckets of clusters, with a list of the clusters that exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.distance import quantize_u8

#: Buckets of a table if the writer doesn't say; a job makes one for so many points.
BUCKETS, POINTS_OF_BUCKET = 16, 4_000_000


def write_clusters(assignments: DataFrame, path: str, buckets: int = BUCKETS, u8: bool = False) -> None:
    """Write (point_id, descriptor, cluster_id) under ``path``, which must not exist yet.

    Rows are dealt by ranges of (bucket, cluster, point): a task's rows are of one or two buckets, and a large cluster is
    split over tasks. Rows are sorted by cluster, so row groups can be skipped.
    """
    rows = assignments.select("point_id", quantize_u8("descriptor").alias("descriptor") if u8 else "descriptor", "cluster_id", F.pmod("cluster_id", F.lit(buckets)).cast("int").alias("bucket"))
    dealt = rows.repartitionByRange("bucket", "cluster_id", "point_id").sortWithinPartitions("bucket", "cluster_id", "point_id")
    dealt.write.mode("errorifexists").partitionBy("bucket").parquet(f"{path}/points")
    spark = assignments.sparkSession
    counts = spark.read.parquet(f"{path}/points").groupBy("cluster_id").agg(F.count("*").alias("points"))
    counts.withColumn("buckets", F.lit(buckets)).write.mode("errorifexists").parquet(f"{path}/clusters")


def read_clusters(spark: SparkSession, path: str, cluster_ids: list[int] | None = None) -> DataFrame:
    """(point_id, descriptor, cluster_id); with ``cluster_ids``, only their buckets' files are opened."""
    points = spark.read.parquet(f"{path}/points")
    if cluster_ids is not None:
        first = written_clusters(spark, path).first()
        buckets = sorted({c % first["buckets"] for c in cluster_ids}) if first else []
        points = points.where(F.col("bucket").isin(buckets) & F.col("cluster_id").isin(list(cluster_ids)))
    return points.select("point_id", "descriptor", "cluster_id")


def written_clusters(spark: SparkSession, path: str) -> DataFrame:
    """(cluster_id, points, buckets) of the clusters that exist."""
    return spark.read.parquet(f"{path}/clusters")
