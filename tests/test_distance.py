import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecprune.functions.distance import nearest, quantize_u8, sq_l2, sq_l2_pairs
from vecprune.schema import POINTS


def fold(a, b):
    total = 0.0
    for x, y in zip(a, b):
        d = np.float32(x) - np.float32(y)
        total += float(np.float32(d * d))
    return total


def test_column_and_kernel_give_the_same_bits(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(2, 50, 17)).astype(np.float32)
    rows = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))], "i int, a array<float>, b array<float>")
    got = [r["d"] for r in rows.select("i", sq_l2("a", "b").alias("d")).orderBy("i").collect()]
    assert got == sq_l2_pairs(x, y).tolist() == [fold(a, b) for a, b in zip(x, y)]


def test_lengths_must_agree(spark):
    rows = spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<float>, b array<float>")
    with pytest.raises(Exception, match="different lengths"):
        rows.select(sq_l2("a", "b")).collect()
    with pytest.raises(ValueError):
        sq_l2_pairs(np.zeros((1, 2), np.float32), np.zeros((1, 3), np.float32))


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 40), st.integers(1, 6), st.integers(1, 50), st.integers(0, 1000))
def test_nearest_is_exact_with_ties(n, q, k, seed):
    rng = np.random.default_rng(seed)
    points = rng.integers(0, 3, size=(n, 3)).astype(np.float32)
    queries = rng.integers(0, 3, size=(q, 3)).astype(np.float32)
    ids = rng.permutation(n) * 7
    rows, found, dist = nearest(ids, points, queries, k, cells=50)
    for i in range(q):
        want = sorted((fold(queries[i], p), int(j)) for p, j in zip(points, ids))[:k]
        assert [(d, int(j)) for d, j in zip(dist[rows == i], found[rows == i])] == want


def test_quantize(spark):
    row = spark.createDataFrame([(1, [255.9, 256.0, -1.0, 0.4, 7.0])], POINTS).select(quantize_u8("descriptor").alias("v")).first()
    assert row["v"] == [255.0, 0.0, 255.0, 0.0, 7.0]
    assert F.col("x") is not None
