import numpy as np
import pytest
from pyspark.sql import functions as F

from vecprune.llm import mih

KIND = "vec_id long, embedding array<float>"


def by_query(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    table = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    got = by_query(mih.search(table, F.col("id") % 20 == 0, block_rows=700))
    rows = sorted(table.select("vec_id", "embedding").collect())
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    want = mih.brute(ids, x, [i for i in ids if i % 20 == 0])
    assert set(got) == set(want)
    assert np.mean([len({i for i, _ in got[q]} & set(want[q])) / 10 for q in want]) >= 0.95
    for q, found in list(got.items())[:20]:
        assert all(s == pytest.approx(np.linalg.norm(x[i] - x[q]), abs=1e-12) for i, s in found)


def test_pigeonhole_finds_every_code():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 16))
    codes = mih.Codes(x, bits=32)
    index = mih.Index(np.arange(500), x, codes)
    all_codes = codes.code(x)
    for radius in (0, 3, 4, 7, 9, 31):
        want = np.flatnonzero(np.bitwise_count(all_codes ^ all_codes[7]).sum(axis=1) <= radius)
        assert sorted(index.within(all_codes[7], radius)) == want.tolist()


def test_cases(spark):
    rows = [(i, [1.0, 0.0]) for i in range(30)] + [(30, None), (31, [0.0, 0.0]), (32, [float("nan"), 1.0]), (33, [None, 1.0]), (34, [float("inf"), 1.0]), (35, []), (None, [1.0, 1.0]), (36, [0.5, 0.5, 0.5])]
    rows += [(40, [0.0, 1.0]), (40, [0.0, 1.0])]
    t = spark.createDataFrame([(*r, 1) for r in rows], KIND + ", rank int")
    got = by_query(mih.search(t, F.col("id") % 10 == 0))
    assert [i for i, _ in got[0]] == list(range(1, 11)) and all(s == 0.0 for _, s in got[0])
    assert [i for i, _ in got[10]] == [*range(10)]
    assert 30 not in got and all(len(v) in (10, 20) for v in got.values())
    few = by_query(mih.search(t.where("vec_id in (0, 1, 2)"), F.col("id") == 0))
    assert [i for i, _ in few[0]] == [1, 2]
    assert mih.search(t.where("vec_id = 30"), F.col("id") % 10 == 0).count() == 0
    assert mih.search(t.where("vec_id < 0"), F.col("id") % 10 == 0).columns == ["query_id", "rank", "vec_id", "score"]


def test_chunks_and_blocks_change_nothing_exact(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = sorted(table.select("vec_id", "embedding").collect())
    want = mih.brute(np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64), range(0, 500, 10))
    for options in ({}, {"block_rows": 60, "chunk_bytes": 3000}):
        got = by_query(mih.search(table, F.col("id") % 10 == 0, **options))
        assert set(got) == set(want) and np.mean([len({i for i, _ in got[q]} & set(want[q])) / 10 for q in want]) >= 0.95


def test_dimensions_are_searched_apart(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=2 + i % 3).tolist()) for i in range(90)]
    got = by_query(mih.search(spark.createDataFrame(rows, KIND), F.col("id") % 10 == 0, k=4))
    assert set(got) == set(range(0, 90, 10))
    assert all(len(v) == 4 and all(i % 3 == q % 3 for i, _ in v) for q, v in got.items())


def test_vectors_in_groups_probe_little():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(300, 64))
    x = np.repeat(centres, 40, axis=0) + 0.05 * rng.normal(size=(12_000, 64))
    ids = np.arange(len(x))
    index = mih.Index(ids, x, mih.Codes(x[rng.permutation(len(x))[:3000]]))
    queries = ids[::200]
    want = mih.brute(ids, x, queries)
    got = {q: index.nearest(x[q], q, 10)[0] for q in queries}
    assert np.mean([len(set(got[q]) & set(want[q])) / 10 for q in queries]) >= 0.9
    assert index.probed < 0.1 * len(ids) * len(queries)
