"""Seeded samples of leaders, level by level.

A row is kept if the first 32 bits of md5("seed:id") are below its probability, so a sample is the same after any
recomputation or repartitioning, and levels are independent. An empty draw is replaced by the row of the least hash.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RECORD_BYTES, IO_GRANULARITY = 264, 8192


def expected_size(n: int, level: int, height: int, record_bytes: int = RECORD_BYTES, io_granularity: int = IO_GRANULARITY) -> int:
    """Expected nodes at a level of an index over n points; leaves are level 0."""
    if level == 0:
        return math.ceil(n / max(1, io_granularity // record_bytes))
    return math.ceil(n ** (1 - level / (height + 1)))


def kept(rows: DataFrame, share: float, seed: int, id_column: str = "id") -> DataFrame:
    """A Bernoulli sample of about ``share`` of the rows, never empty unless ``rows`` is."""
    if share >= 1:
        return rows
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_column).cast("string")))
    hashed = rows.withColumn("_hash", h)
    limit = format(int(share * 2**32), "08x")
    some = hashed.where(F.substring("_hash", 1, 8) < limit)
    if some.isEmpty():
        some = hashed.orderBy("_hash", id_column).limit(1)
    return some.drop("_hash")


def sample_leaves(points: DataFrame, n: int, seed: int = 0, record_bytes: int = RECORD_BYTES, io_granularity: int = IO_GRANULARITY) -> DataFrame:
    """Leaders of the leaf clusters, from ``points`` (id, descriptor)."""
    return kept(points, expected_size(n, 0, 1, record_bytes, io_granularity) / max(1, n), seed)


def sample_nodes(current: DataFrame, size: int, n: int, level: int, height: int, seed: int = 0) -> DataFrame:
    """Nodes of ``level`` from the ``size`` nodes of the level below; a level is smaller than the one below."""
    target = expected_size(n, level, height)
    if target > size:
        target = math.ceil(0.6 * size)
    return kept(current, target / max(1, size), seed + level)
