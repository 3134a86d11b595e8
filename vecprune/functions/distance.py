"""Squared Euclidean distance with one arithmetic in every engine.

Components are subtracted and squared as 32-bit floats, and added up in order as 64-bit floats. The Column form and the
NumPy forms give the same bits, so results of different engines can be compared by value.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def sq_l2(a: Column | str, b: Column | str) -> Column:
    """Distance of two ARRAY<FLOAT> columns; vectors of different lengths are an error."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    fold = F.aggregate(squares, F.lit(0.0), lambda acc, v: acc + v.cast("double"))
    return F.when(F.size(a) == F.size(b), fold).otherwise(F.raise_error(F.lit("vectors of different lengths")).cast("double"))


def sq_l2_wide(a: list[str], b: list[str]) -> Column:
    """Distance of two vectors with a column a component. Spark compiles it; a fold over arrays it interprets."""
    total = F.lit(0.0)
    for x, y in zip(a, b, strict=True):
        diff = F.col(x) - F.col(y)
        total = total + (diff * diff).cast("double")
    return total


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column as rows of 32-bit floats; rows of different lengths are an error."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    n = len(column)
    if n and len(flat) % n or n and not (np.diff(column.offsets.to_numpy()) == len(flat) // n).all():
        raise ValueError("vectors of different lengths")
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def sq_l2_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of the rows of ``a`` to the same rows of ``b``."""
    if a.shape[1] != b.shape[1]:
        raise ValueError("vectors of different lengths")
    out = np.zeros(len(a), dtype=np.float64)
    for d in range(a.shape[1]):
        diff = a[:, d] - b[:, d]
        out += diff * diff
    return out


def nearest(ids: np.ndarray, points: np.ndarray, queries: np.ndarray, k: int, cells: int = 4_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, distance) of each query's k nearest points by (distance, id).

    A matrix product in double precision finds all points that could be among them, with a margin far above the
    rounding of either arithmetic; only those get the exact distance.
    """
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if not len(points) or not len(queries):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    wide = points.astype(np.float64)
    norms = (wide * wide).sum(axis=1)
    block = max(1, cells // len(points))
    for at in range(0, len(queries), block):
        q = queries[at : at + block].astype(np.float64)
        qn = (q * q).sum(axis=1)
        near = norms[None, :] - 2 * (q @ wide.T) + qn[:, None]
        if k < len(points):
            limit = np.partition(near, k - 1, axis=1)[:, k - 1]
            rows, cols = np.nonzero(near <= (limit + 1e-5 * (np.abs(limit) + qn + norms.max()))[:, None])
        else:
            rows, cols = (x.ravel() for x in np.indices(near.shape))
        dist = np.concatenate([sq_l2_pairs(queries[at + rows[i : i + 200_000]], points[cols[i : i + 200_000]]) for i in range(0, len(rows), 200_000)])
        order = np.lexsort((ids[cols], dist, rows))
        rows, cols, dist = rows[order], cols[order], dist[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = rank < k
        found.append((rows[keep] + at, ids[cols[keep]], dist[keep]))
    return tuple(np.concatenate([f[i] for f in found]) for i in range(3))


def quantize_u8(vector: Column | str) -> Column:
    """The byte codec: truncation toward zero, modulo 256. Lossless for whole numbers from 0 to 255 only."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    return F.transform(vector, lambda x: F.pmod(x.cast("int"), F.lit(256)).cast("float"))
