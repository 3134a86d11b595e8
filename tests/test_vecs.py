import numpy as np
import pytest

from vecprune.job import arguments, run
from vecprune.operators.evaluate import truth_of
from vecprune.operators.knn import exact_knn
from vecprune.sources.vecs import COMPONENT, read_vecs, register, write_vecs


def save(path, rows, kind):
    with open(path, "wb") as f:
        for v in rows:
            f.write(np.int32(len(v)).tobytes() + np.asarray(v).astype(COMPONENT[kind]).tobytes())


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at, rng = tmp_path_factory.mktemp("vecs"), np.random.default_rng(2)
    base = rng.integers(0, 256, size=(1000, 128))
    save(at / "base.fvecs", base, "fvecs")
    save(at / "base.bvecs", base, "bvecs")
    save(at / "query.fvecs", base[::50], "fvecs")
    return at, base


@pytest.mark.parametrize("kind", ["fvecs", "bvecs"])
@pytest.mark.parametrize("splits", [1, 3, 7])
def test_points(spark, folder, kind, splits):
    at, base = folder
    rows = sorted(read_vecs(spark, f"{at}/base.{kind}", splits=splits).collect())
    assert [r["point_id"] for r in rows] == list(range(1000))
    assert np.array_equal(np.array([r["descriptor"] for r in rows]), base)


@pytest.mark.parametrize("reduction", [1, 2, 3])
def test_reduction_is_a_prefix(spark, folder, reduction):
    got = sorted(r["point_id"] for r in read_vecs(spark, f"{folder[0]}/base.fvecs", reduction=reduction).collect())
    assert got == list(range(1000 // reduction))


def test_truth_and_round_trip(spark, folder, tmp_path):
    at, base = folder
    points = read_vecs(spark, f"{at}/base.fvecs")
    queries = read_vecs(spark, f"{at}/query.fvecs").withColumnRenamed("point_id", "query_id")
    truth = truth_of(exact_knn(points, queries, 100))
    write_vecs(truth.selectExpr("cast(query_id as int) query_id", "neighbours"), str(tmp_path / "truth.ivecs"), "ivecs", 3)
    again = read_vecs(spark, str(tmp_path / "truth.ivecs")).orderBy("query_id").collect()
    assert [r["query_id"] for r in again] == list(range(20))
    assert [r["neighbours"] for r in again] == [r["neighbours"] for r in truth.orderBy("query_id").collect()]
    assert all(r["neighbours"][0] == 50 * r["query_id"] for r in again)


def test_broken_files(spark, tmp_path):
    save(tmp_path / "a.fvecs", np.zeros((3, 64)), "fvecs")
    assert read_vecs(spark, str(tmp_path / "a.fvecs"), dim=64).count() == 3
    with pytest.raises(Exception, match="dimension 64, not 128"):
        read_vecs(spark, str(tmp_path / "a.fvecs"), dim=128).collect()
    (tmp_path / "b.fvecs").write_bytes((tmp_path / "a.fvecs").read_bytes()[:-4])
    with pytest.raises(Exception, match="no multiple"):
        read_vecs(spark, str(tmp_path / "b.fvecs")).collect()
    with pytest.raises(Exception, match="ends in"):
        read_vecs(spark, str(tmp_path / "a.txt")).collect()
    mixed = (tmp_path / "a.fvecs").read_bytes()[:260] + np.int32(63).tobytes() + bytes(256)
    (tmp_path / "c.fvecs").write_bytes(mixed)
    with pytest.raises(Exception, match="another dimension"):
        read_vecs(spark, str(tmp_path / "c.fvecs")).collect()


def test_stream(spark, folder, tmp_path):
    register(spark)
    rows = spark.readStream.format("vecs").load(f"{folder[0]}/base.fvecs")
    q = rows.select("point_id").writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "o")).collect()) == list(range(1000))


def test_stream_reads_every_file_once(spark, tmp_path):
    """Files that arrive later come first by name, and one grows; a new query goes on from the checkpoint."""
    register(spark)
    (tmp_path / "in").mkdir()

    def seen():
        rows = spark.readStream.format("vecs").option("kind", "fvecs").load(str(tmp_path / "in"))
        q = rows.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r["point_id"], r["descriptor"][0]) for r in spark.read.parquet(str(tmp_path / "o")).collect())

    save(tmp_path / "in" / "b.fvecs", [[1.0], [2.0], [3.0]], "fvecs")
    assert seen() == [(0, 1.0), (1, 2.0), (2, 3.0)]
    save(tmp_path / "in" / "a.fvecs", [[100.0], [200.0]], "fvecs")
    assert [v for _, v in seen()] == [1.0, 2.0, 3.0, 100.0, 200.0]
    save(tmp_path / "in" / "b.fvecs", [[1.0], [2.0], [3.0], [4.0]], "fvecs")
    assert seen() == [(0, 1.0), (1, 2.0), (2, 3.0), (3, 100.0), (4, 200.0), (5, 4.0)]


def test_append_and_overwrite(spark, tmp_path):
    path = str(tmp_path / "x.fvecs")
    vectors = lambda a, b: spark.createDataFrame([(i, [float(i), 0.5]) for i in range(a, b)], "point_id long, descriptor array<float>")
    write_vecs(vectors(0, 20), path, "fvecs", 3)
    write_vecs(vectors(20, 25), path, "fvecs", 2)
    assert [r["descriptor"][0] for r in read_vecs(spark, path).orderBy("point_id").collect()] == list(range(25))
    write_vecs(vectors(7, 10), path, "fvecs", 2, "overwrite")
    assert [r["descriptor"][0] for r in read_vecs(spark, path).orderBy("point_id").collect()] == [7.0, 8.0, 9.0]


def test_splits_follow_the_size(spark, folder):
    at, base = folder
    assert read_vecs(spark, f"{at}/base.fvecs").rdd.getNumPartitions() == 1
    assert read_vecs(spark, f"{at}/base.fvecs", splitBytes=516 * 90).rdd.getNumPartitions() == 12


@pytest.mark.parametrize("mode", ["batch", "stream"])
@pytest.mark.parametrize("method", ["scan", "index"])
def test_jobs(spark, folder, tmp_path, mode, method):
    at, _ = folder
    points = read_vecs(spark, f"{at}/base.fvecs")
    truth = truth_of(exact_knn(points, points.where("point_id % 50 = 0").selectExpr("point_id div 50 query_id", "descriptor"), 100))
    write_vecs(truth.selectExpr("cast(query_id as int) query_id", "neighbours"), str(tmp_path / "truth.ivecs"), "ivecs", 1)
    args = [mode, "--method", method, "--base", f"{at}/base.fvecs", "--query", f"{at}/query.fvecs", "--truth", str(tmp_path / "truth.ivecs"), "--output", str(tmp_path / "scores"), "--k", "10", "--record-bytes", "516"]
    if mode == "stream":
        args += ["--recluster", "true", "--clusters", str(tmp_path / "clusters"), "--clusterSize", "8", "--index", str(tmp_path / "index")]
    run(spark, arguments(args))
    lines = sorted(r["value"] for r in spark.read.text(str(tmp_path / "scores")).collect())
    assert len(lines) == 20 and all(len(x.split(";")) == 22 and x.split(";")[2] == "1.00" for x in lines)
    if method == "scan":
        assert all(set(x.split(";")[2:]) == {"1.00"} for x in lines)
    if mode == "stream":
        run(spark, arguments([*args[:-7], "false", *args[-6:]]) if args[-7] == "true" else arguments(args))


def test_arguments():
    with pytest.raises(SystemExit):
        arguments(["stream", "--method", "scan", "--base", "a", "--query", "b", "--truth", "c", "--output", "d"])
