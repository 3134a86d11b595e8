import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecprune.operators.evaluate import formatted, score, score_lines, truth_of
from vecprune.operators.index import Index, build_index, find_children, paths, sizes, visits
from vecprune.operators.knn import _in_blocks, collect_nn, exact_knn, nearest_of, topk
from vecprune.operators.route import assign, assign_random, route_greedy, unwritten_leaders
from vecprune.operators.sampling import expected_size, kept
from vecprune.operators import knn
from vecprune.operators.search import index_knn, index_knn_files, routes_of
from vecprune.plans.stage import discard, written
from vecprune.schema import EDGES, NODES, POINTS, QUERIES
from vecprune.sources.clusters import read_clusters, write_clusters, written_clusters


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.integers(0, 255, size=(600, 8)).astype(float))], POINTS).cache()


@pytest.fixture(scope="module")
def queries(points):
    return points.where("point_id % 40 = 0").select(F.expr("point_id div 40").alias("query_id"), "descriptor").cache()


@pytest.fixture(scope="module", params=[1, 2, 3])
def index(points, request):
    return build_index(points, request.param, 2, record_bytes=40, io_granularity=400)


def test_engines_agree(points, queries):
    a, b = exact_knn(points, queries, 7), exact_knn(points, queries, 7, "sql")
    assert rows(a.select(b.columns)) == rows(b)
    blocks = topk(_in_blocks(points, queries, 7), 7)
    assert rows(blocks.select(b.columns)) == rows(b)


def test_nearest_of_agrees(points, queries):
    v = queries.withColumnRenamed("query_id", "id")
    t = points.withColumnRenamed("point_id", "id")
    a = nearest_of(v, t, 3)
    assert rows(a) == rows(nearest_of(v, t, 3, "sql").select(a.columns))


def test_levels(points, index):
    levels = {r["level"]: r for r in sizes(index).collect()}
    assert sorted(levels) == list(range(index.height))
    counts = [levels[i]["actual"] for i in range(index.height)]
    assert counts == sorted(counts, reverse=True) and counts[-1] >= 1
    leaves = {r["id"] for r in index.leaves().collect()}
    assert len(leaves) == counts[0] and leaves <= set(range(600))
    for level in range(1, index.height):
        assert {r["id"] for r in index.level(level).collect()} <= {r["id"] for r in index.level(level - 1).collect()}


def test_leader_is_in_its_own_cluster(points, index):
    own = {(r["point_id"], r["cluster_id"]) for r in assign(points, index, 1).collect()}
    if index.height < 3:  # deeper descents may take another way
        assert all((leaf["id"], leaf["id"]) in own for leaf in index.leaves().collect())
    assert len(own) == 600


def test_descent_as_joins_is_the_same(queries, index):
    v = queries.withColumnRenamed("query_id", "id")
    for keep, widen in ((1, False), (6, False), (40, True)):
        a = route_greedy(v, index, keep, widen)
        assert rows(a) == rows(route_greedy(v, index, keep, widen, "sql").select(a.columns))


def test_all_leaves_give_the_exact_result(points, queries, index):
    n = index.leaves().count()
    found = index_knn(assign(points, index, 2), routes_of(queries, index, n), 10)
    assert rows(found) == rows(exact_knn(points, queries, 10).select(found.columns))


def test_recall_grows_with_b(points, queries, index):
    truth = truth_of(exact_knn(points, queries, 10))
    assigned, last = assign(points, index, 1).cache(), 0.0
    for b in (1, 3, 8):
        found = collect_nn(index_knn(assigned, routes_of(queries, index, b), 10))
        mean = score(found, truth).select(F.avg(F.coalesce(F.try_element_at("recall_at", F.lit(10)), F.lit(0.0)))).first()[0]
        assert mean >= last
        last = mean


def test_scan_scores_one(points, queries):
    exact = exact_knn(points, queries, 10)
    got = score(collect_nn(exact), truth_of(exact)).collect()
    assert all(r["hit_at"] == r["recall_at"] == [1.0] * 10 for r in got)


def test_two_level_hand_index(spark):
    nodes = spark.createDataFrame([(0, i, [float(i)]) for i in range(7)] + [(1, i, [float(i)]) for i in (0, 3, 6)], NODES)
    edges = spark.createDataFrame([(0, p, c) for p, c in ((0, 0), (0, 1), (3, 1), (3, 2), (3, 3), (3, 4), (6, 4), (6, 5), (6, 6))], EDGES)
    index = Index(nodes, edges, 2, 7)
    assert rows(paths(index)) == [(0, 1), (1, 2), (2, 1), (3, 1), (4, 2), (5, 1), (6, 1)]
    assert [r[0] for r in rows(visits(index, 0))] == [0, 1, 1, 2, 3, 4, 4, 5, 6]
    at = spark.createDataFrame([(9, [0.4])], "id long, descriptor array<float>")
    assert [r[1] for r in sorted(map(tuple, route_greedy(at, index, 3).collect()), key=lambda r: r[3])] == [0, 1]
    assert [r[1] for r in sorted(map(tuple, route_greedy(at, index, 3, True).collect()), key=lambda r: r[3])] == [0, 1, 2]
    few = spark.createDataFrame([(1, [0.0]), (2, [6.0])], POINTS)
    assert sorted(r[0] for r in unwritten_leaders(index, assign(few, index)).collect()) == [1, 2, 3, 4, 5]
    lonely = spark.createDataFrame([(8, [1.0])], "id long, descriptor array<float>")
    assert find_children(edges, lonely).first()["children"] == []


def test_keep_empty(spark, points, queries, index):
    none = assign(points.where("point_id < 0"), index, 1)
    routes = routes_of(queries, index, 2)
    assert index_knn(none, routes, 3).count() == 0
    assert rows(index_knn(none, routes, 3, True).select("query_id", "point_id")) == [(i, None) for i in range(15)]


def test_save_and_load(spark, points, queries, index, tmp_path):
    index.save(str(tmp_path / "i"))
    again = Index.load(spark, str(tmp_path / "i"))
    v = queries.withColumnRenamed("query_id", "id")
    assert rows(route_greedy(v, again, 4, True)) == rows(route_greedy(v, index, 4, True))
    with pytest.raises(Exception, match="(?i)exists"):
        index.save(str(tmp_path / "i"))


def test_cluster_table(spark, points, tmp_path):
    path = str(tmp_path / "c")
    assigned = assign_random(points, 9)
    write_clusters(assigned, path, 4, u8=True)
    assert {r["cluster_id"] for r in written_clusters(spark, path).collect()} == set(range(1, 10))
    assert rows(read_clusters(spark, path)) == rows(assigned)
    some = read_clusters(spark, path, [3, 7])
    assert rows(some) == rows(assigned.where("cluster_id in (3, 7)"))
    assert re.search(r"PartitionFilters: \[[^]]*bucket", some._jdf.queryExecution().toString())
    with pytest.raises(Exception, match="(?i)exists"):
        write_clusters(assigned, path)


def test_scores_with_ties(spark):
    results = spark.createDataFrame([(1, [(1.0, 3), (1.0, 5)]), (2, [(1.0, 3)]), (3, [])], "query_id long, nn array<struct<dist:double,point_id:long>>")
    truth = spark.createDataFrame([(1, [3, 5]), (2, [4])], "query_id long, neighbours array<int>")
    got = {r["query_id"]: r for r in score(results, truth).collect()}
    assert (got[1]["hit_at"], got[1]["recall_at"]) == ([1.0, 1.0], [0.0, 1.0])
    assert (got[2]["hit_at"], got[2]["recall_at"]) == ([0.0], [0.0])
    assert got[3]["hit_at"] is None
    swapped = spark.createDataFrame([(1, [5, 3])], "query_id long, neighbours array<int>")
    again = score(results.where("query_id = 1"), swapped).first()
    assert (again["hit_at"], again["recall_at"]) == ([1.0, 1.0], [1.0, 1.0])
    lines = {r["value"] for r in score_lines(score(results, truth), 3).collect()}
    assert "1;0;1.00;1.00;#I/T;0.00;1.00;#I/T" in lines and "3;0;#I/T;#I/T;#I/T;#I/T;#I/T;#I/T" in lines


def test_rounding_is_half_up(spark):
    assert spark.range(1).select(formatted(F.array(F.lit(0.125), F.lit(0.5)), 3).alias("v")).first()["v"] == "0.13;0.50;#I/T"


def test_sampling(spark):
    t = spark.range(2000)
    a = kept(t, 0.1, 4)
    assert rows(a) == rows(kept(t.repartition(7), 0.1, 4)) and 120 < a.count() < 280
    assert kept(t, 1e-9, 1).count() == 1 and kept(t, 1.0, 1).count() == 2000
    assert kept(t.where("id < 0"), 0.5, 1).count() == 0
    assert (expected_size(500, 0, 2), expected_size(500, 1, 2), expected_size(2000, 0, 2)) == (17, 63, 65)


def test_empty_tables(spark):
    empty, query = spark.createDataFrame([], POINTS), spark.createDataFrame([(1, [0.0])], QUERIES)
    assert exact_knn(empty, query, 3).count() == 0
    assert exact_knn(spark.createDataFrame([(1, [0.0])], POINTS), spark.createDataFrame([], QUERIES), 3).count() == 0


def test_points_are_neither_shuffled_nor_broadcast(spark, points, queries, index):
    """Assignment streams the points past the index; a search shuffles them once, by cluster."""
    plan = assign(points, index, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    joins = route_greedy(points.withColumnRenamed("point_id", "id"), index, 2, False, "sql")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin BuildLeft" not in joins
    routed = routes_of(queries, index, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in routed


def test_search_opens_only_the_files_of_routed_clusters(spark, points, queries, tmp_path):
    index, path = build_index(points, 2, 2, record_bytes=40, io_granularity=400), str(tmp_path / "c")
    write_clusters(assign(points, index, 2), path, 8)
    routes = routes_of(queries.where("query_id = 3"), index, 1)
    found = index_knn_files(spark, path, routes, 5)
    assert rows(found) == rows(index_knn(read_clusters(spark, path), routes, 5))
    opened = read_clusters(spark, path, [r["cluster_id"] for r in routes.collect()])
    assert len(opened.inputFiles()) >= 1 and opened.select("point_id").rdd.getNumPartitions() < read_clusters(spark, path).rdd.getNumPartitions()
    assert re.search(r"PartitionFilters: \[[^]]*bucket", found._jdf.queryExecution().executedPlan().toString())


def test_a_point_of_several_clusters_counts_once(spark, points, queries, index):
    found = index_knn(assign(points, index, 3), routes_of(queries, index, 4), 10)
    assert found.count() == found.select("query_id", "point_id").distinct().count()


def test_queries_too_large_to_broadcast(points, queries, monkeypatch):
    want = rows(exact_knn(points, queries, 7))
    monkeypatch.setattr(knn, "MAX_BROADCAST_BYTES", 100)
    monkeypatch.setattr(knn, "BLOCK_BYTES", 6000)
    assert rows(exact_knn(points, queries, 7)) == want == rows(exact_knn(points, queries, 7, "sql"))


def test_written_tables_can_be_discarded(spark):
    table = written(spark.range(5).toDF("id"), "five")
    assert table.count() == 5 and os.path.isdir(table.written_path)
    discard(table)
    assert not os.path.exists(table.written_path)


def test_sql_scan_ranks_few_pairs(spark, monkeypatch):
    """The scan in built-in functions ranks a small part of the pairs, also when many vectors are equal, and loses none."""
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(3000, 6)).astype(np.float32)
    vectors[::3] = vectors[0]
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "point_id long, descriptor array<float>")
    queries = points.where("point_id % 50 = 0").withColumnRenamed("point_id", "query_id")
    ranked, plain = [], knn.topk
    monkeypatch.setattr(knn, "topk", lambda candidates, k: ranked.append(candidates.count()) or plain(candidates, k))
    got = sorted(map(tuple, knn.exact_knn(points, queries, 10, "sql").collect()))
    assert sum(ranked) < 3000 * 60 / 4
    monkeypatch.undo()
    assert got == sorted(map(tuple, knn.exact_knn(points, queries, 10).collect()))
    few = points.where("point_id < 7")
    assert sorted(map(tuple, knn.exact_knn(few, queries, 10, "sql").collect())) == sorted(map(tuple, knn.exact_knn(few, queries, 10).collect()))
    assert knn.exact_knn(few.where("point_id < 0"), queries, 10, "sql").count() == 0
