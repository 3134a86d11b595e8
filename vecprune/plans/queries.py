"""The registered queries of the search engine, and the same results as DuckDB SQL.

Fixture: ``embeddings`` are the points; those whose id is divisible by 20 are the queries. An index uses 264 bytes a record and reads of 8192.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.distance import quantize_u8, sq_l2
from ..operators.evaluate import score, score_lines, truth_of
from ..operators.index import Index, build_index, find_children, find_parents, paths, sizes, visits
from ..operators.knn import collect_nn, cross_distances, exact_knn, merge_nn, topk
from ..operators.route import assign, assign_random, route_greedy, route_leaf_scan, unwritten_leaders
from ..operators.sampling import sample_leaves, sample_nodes
from ..operators.search import index_knn, routes_of
from ..sources.clusters import read_clusters, write_clusters, written_clusters
from ..sources.vecs import read_vecs, write_vecs
from ..streaming.search import stream_exact, stream_index
from .sink import write_scores
from .stage import new_path, written

K, B, TREE_A = 10, 5, 3


def points_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(F.col("vec_id").alias("point_id"), F.col("embedding").alias("descriptor"))


def queries_of(points: DataFrame) -> DataFrame:
    return points.where("point_id % 20 = 0").select(F.expr("point_id div 20").alias("query_id"), "descriptor")


def _index(points: DataFrame, height: int = 2) -> Index:
    return build_index(points, height, TREE_A)


def _by_id(points: DataFrame) -> DataFrame:
    return points.select(F.col("point_id").alias("id"), "descriptor")


def pairwise_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = points_of(spark, sf_dir)
    return cross_distances(points, queries_of(points))


def exact_knn_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = points_of(spark, sf_dir)
    return exact_knn(points, queries_of(points), K)


def exact_knn_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = points_of(spark, sf_dir)
    return exact_knn(points, queries_of(points), K, "sql")


def knn_collected(spark: SparkSession, sf_dir: str) -> DataFrame:
    nn = collect_nn(exact_knn_scan(spark, sf_dir))
    return nn.select("query_id", F.posexplode("nn").alias("pos", "n")).select("query_id", (F.col("pos") + 1).alias("rank"), "n.point_id", "n.dist")


def knn_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists over the even and over the odd points, merged."""
    points = points_of(spark, sf_dir)
    lists = [collect_nn(exact_knn(points.where(f"point_id % 2 = {i}"), queries_of(points), K)).withColumnRenamed("nn", f"nn{i}") for i in (0, 1)]
    merged = lists[0].join(lists[1], "query_id").select("query_id", F.posexplode(merge_nn(F.col("nn0"), F.col("nn1"), K)).alias("pos", "n"))
    return merged.select("query_id", (F.col("pos") + 1).alias("rank"), "n.point_id", "n.dist")


def leaf_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = points_of(spark, sf_dir)
    return sample_leaves(_by_id(points), points.count()).select(F.col("id").alias("node_id"))


def node_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = points_of(spark, sf_dir)
    n = points.count()
    leaves = sample_leaves(_by_id(points), n)
    return sample_nodes(leaves, leaves.count(), n, 1, 2).select(F.col("id").alias("node_id"))


def find_parents_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(points_of(spark, sf_dir))
    return find_parents(index.level(0), index.level(1), TREE_A)


def find_children_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(points_of(spark, sf_dir))
    lists = find_children(index.edges, index.level(1))
    return lists.select("node_id", F.size("children").cast("long").alias("n_children"), F.array_join("children", ",").alias("children"))


def index_nodes_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sizes(_index(points_of(spark, sf_dir), 3))


def paths_to_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths(_index(points_of(spark, sf_dir), 3))


def route_leaf_scan_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = points_of(spark, sf_dir)
    routes = route_leaf_scan(queries_of(points).withColumnRenamed("query_id", "id"), _index(points), B)
    return routes.select(F.col("id").alias("query_id"), "cluster_id", "dist", "rank")


def route_greedy_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = points_of(spark, sf_dir)
    routes = route_greedy(queries_of(points).withColumnRenamed("query_id", "id"), _index(points), B)
    return routes.select(F.col("id").alias("query_id"), "cluster_id", "dist", "rank")


def route_greedy_widen(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = points_of(spark, sf_dir)
    routes = route_greedy(queries_of(points).withColumnRenamed("query_id", "id"), _index(points, 3), 8, True)
    return routes.select(F.col("id").alias("query_id"), "cluster_id", "dist", "rank")


def route_greedy_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as route_greedy_widen, as joins."""
    points = points_of(spark, sf_dir)
    routes = route_greedy(queries_of(points).withColumnRenamed("query_id", "id"), _index(points, 3), 8, True, "sql")
    return routes.select(F.col("id").alias("query_id"), "cluster_id", "dist", "rank")


def assign_a1(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = points_of(spark, sf_dir)
    return assign(points, _index(points), 1).select("point_id", "cluster_id")


def assign_a3(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = points_of(spark, sf_dir)
    return assign(points, _index(points), 3).select("point_id", "cluster_id")


def random_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_random(points_of(spark, sf_dir), 16).select("point_id", "cluster_id")


def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the cluster table as written and read again."""
    points, path = points_of(spark, sf_dir), new_path(spark, "clusters")
    write_clusters(assign(points, _index(points), 1), path)
    return written_clusters(spark, path).select("cluster_id", "points")


def cluster_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cluster, the largest, read alone."""
    points, path = points_of(spark, sf_dir), new_path(spark, "clusters")
    write_clusters(assign(points, _index(points), 1), path)
    largest = written_clusters(spark, path).orderBy(F.desc("points"), "cluster_id").first()["cluster_id"]
    return read_clusters(spark, path, [largest]).select("cluster_id", "point_id")


def unwritten_leaders_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaders to whose cluster none of the queries belongs, the queries being assigned like points."""
    points = points_of(spark, sf_dir)
    index = _index(points)
    return unwritten_leaders(index, assign(queries_of(points).withColumnRenamed("query_id", "point_id"), index, 1))


def index_knn_leaf_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = points_of(spark, sf_dir)
    index = _index(points)
    return index_knn(assign(points, index, 1), routes_of(queries_of(points), index, B), K)


def index_knn_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = points_of(spark, sf_dir)
    index = _index(points)
    return index_knn(assign(points, index, 1), routes_of(queries_of(points), index, B, "widen"), K)


def index_knn_redundant_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = points_of(spark, sf_dir)
    index = _index(points)
    return index_knn(assign(points, index, 3), routes_of(queries_of(points), index, B), K)


def index_knn_keep_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cluster a query: queries without candidates stay."""
    points = points_of(spark, sf_dir)
    index = _index(points, 3)
    found = index_knn(assign(points, index, 1), routes_of(queries_of(points), index, 1), K, True)
    return found.select("query_id", F.coalesce("point_id", F.lit(-1)).alias("point_id"), F.coalesce("dist", F.lit(-1.0)).alias("dist"), F.coalesce("rank", F.lit(0)).alias("rank"))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact = written(exact_knn(points_of(spark, sf_dir), queries_of(points_of(spark, sf_dir)), 100), "truth")
    return score(collect_nn(index_knn_leaf_scan(spark, sf_dir)), truth_of(exact))


def hit_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).select("query_id", F.posexplode("hit_at").alias("pos", "hit")).select("query_id", (F.col("pos") + 1).alias("i"), "hit")


def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).select("query_id", F.posexplode("recall_at").alias("pos", "recall")).select("query_id", (F.col("pos") + 1).alias("i"), "recall")


def score_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As written to the score file and read again; a line is padded to 12 places."""
    path = new_path(spark, "scores")
    write_scores(score_lines(_scores(spark, sf_dir), 12), path)
    return spark.read.text(path)


def reduction_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = points_of(spark, sf_dir)
    return points.where(F.col("point_id") < points.count() // 3).select("point_id")


def quantize_u8_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The byte codec over vectors that are spread over a range beyond the bytes'."""
    scaled = points_of(spark, sf_dir).select("point_id", F.transform("descriptor", lambda x: (x * F.lit(1000.0).cast("float"))).alias("v"))
    coded = scaled.select("point_id", F.posexplode(quantize_u8("v")).alias("i", "value"))
    return coded.select("point_id", "i", F.col("value").cast("int").alias("value"))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries as files of a folder, two files a micro-batch."""
    path, queries = new_path(spark, "stream-queries"), queries_of(points_of(spark, sf_dir))
    queries.repartition(4, "query_id").write.parquet(path)
    return spark.readStream.schema(queries.schema).option("maxFilesPerTrigger", 2).parquet(path)


def stream_exact_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_path(spark, "stream")
    stream_exact(_stream(spark, sf_dir), points_of(spark, sf_dir), K, out, new_path(spark, "stream-checkpoint")).awaitTermination()
    return spark.read.parquet(out).select("query_id", "point_id", "dist", "rank")


def stream_index_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, out = points_of(spark, sf_dir), new_path(spark, "stream")
    index, path = _index(points), new_path(spark, "clusters")
    write_clusters(assign(points, index, 1), path)
    stream_index(_stream(spark, sf_dir), path, index, B, K, out, new_path(spark, "stream-checkpoint")).awaitTermination()
    return spark.read.parquet(out).select("query_id", "point_id", "dist", "rank")


def vecs_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points written as a folder of fvecs files and read again; each vector's sum of components, added in order."""
    path = new_path(spark, "vecs") + "/base.fvecs"
    write_vecs(points_of(spark, sf_dir), path, "fvecs")
    total = F.aggregate("descriptor", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return read_vecs(spark, path).select("point_id", F.size("descriptor").cast("long").alias("dim"), total.alias("total"))


def bvecs_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points spread over the bytes' range and beyond, written as bvecs files and read again."""
    path = new_path(spark, "vecs") + "/base.bvecs"
    scaled = points_of(spark, sf_dir).select("point_id", quantize_u8(F.transform("descriptor", lambda x: (x * F.lit(1000.0).cast("float")))).alias("descriptor"))
    write_vecs(scaled, path, "bvecs")
    return read_vecs(spark, path).select("point_id", F.posexplode("descriptor").alias("i", "value")).select("point_id", "i", F.col("value").cast("int").alias("value"))


def truth_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact neighbours written as ivecs files and read again."""
    path = new_path(spark, "vecs") + "/truth.ivecs"
    write_vecs(truth_of(exact_knn_scan(spark, sf_dir)).select(F.col("query_id").cast("int").alias("query_id"), "neighbours"), path, "ivecs")
    ids = read_vecs(spark, path).select("query_id", F.posexplode("neighbours").alias("pos", "point_id"))
    return ids.select(F.col("query_id").cast("long").alias("query_id"), (F.col("pos") + 1).alias("rank"), F.col("point_id").cast("long").alias("point_id"))


def dimension_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a vector file of another dimension than asked for is refused."""
    points, path = points_of(spark, sf_dir), new_path(spark, "vecs") + "/base.fvecs"
    write_vecs(points, path, "fvecs")
    dim = points.select(F.size("descriptor").alias("dim")).first()["dim"]
    return spark.createDataFrame([(d - dim, _refused(lambda: read_vecs(spark, path, dim=d).count())) for d in (dim, dim + 1)], "more int, refused boolean")


def _refused(do: Callable[[], object]) -> bool:
    try:
        do()
    except Exception as e:
        if re.search(r"(?i)already exists|of dimension", str(e)):
            return True
        raise
    return False


def target_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a cluster table is refused where one is already."""
    clusters, path = assign_random(points_of(spark, sf_dir), 4), new_path(spark, "clusters")
    return spark.createDataFrame([(i, _refused(lambda: write_clusters(clusters, path))) for i in (1, 2)], "attempt int, refused boolean")


def index_saved_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and their children, of an index that was saved and loaded again."""
    path = new_path(spark, "index")
    _index(points_of(spark, sf_dir), 3).save(path)
    index = Index.load(spark, path)
    ties = index.edges.groupBy((F.col("level") + 1).alias("level"), F.col("parent_id").alias("node_id")).agg(F.count("*").alias("n"))
    return index.nodes.select("level", "node_id").join(ties, ["level", "node_id"], "left").select("level", "node_id", F.coalesce("n", F.lit(0)).alias("n_children"))


def index_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visits(_index(points_of(spark, sf_dir), 3), 0)


def stream_rebalanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries of a stream dealt round to three tasks."""
    out = new_path(spark, "stream")
    stream_exact(_stream(spark, sf_dir), points_of(spark, sf_dir), K, out, new_path(spark, "stream-checkpoint"), partitions=3).awaitTermination()
    return spark.read.parquet(out).select("query_id", "point_id", "dist", "rank")


def _job(spark: SparkSession, sf_dir: str, mode: str, method: str, *more: str) -> DataFrame:
    """The score lines of a whole job from its arguments, with 0 in the place of the latency."""
    from ..job import arguments, run

    at, points = new_path(spark, "job"), points_of(spark, sf_dir)
    points.write.parquet(f"{at}/base")
    queries_of(points).withColumnRenamed("query_id", "point_id").write.parquet(f"{at}/query")
    truth_of(exact_knn(points, queries_of(points), 100)).write.parquet(f"{at}/truth")
    paths_of = [x for name in ("base", "query", "truth") for x in (f"--{name}", f"{at}/{name}")]
    run(spark, arguments([mode, "--method", method, *paths_of, "--output", f"{at}/scores", "--k", str(K), *[m.format(at=at) for m in more]]))
    return spark.read.text(f"{at}/scores").select(F.regexp_replace("value", r"^(\d+);\d+;", "$1;0;").alias("value"))


def job_batch_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _job(spark, sf_dir, "batch", "scan")


def job_batch_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _job(spark, sf_dir, "batch", "index")


def job_stream_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _job(spark, sf_dir, "stream", "index", "--recluster", "true", "--clusters", "{at}/clusters", "--index", "{at}/index", "--routing", "leaf_scan")


def squared_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance to the first point, as a Column expression."""
    points = points_of(spark, sf_dir)
    first = points.where("point_id = 0").select(F.col("descriptor").alias("o"))
    return points.crossJoin(F.broadcast(first)).select("point_id", sq_l2("o", "descriptor").alias("dist"))


def topk_by_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group top-k: the three points nearest to each leader among its own."""
    points = points_of(spark, sf_dir)
    index = _index(points)
    own = assign(points, index, 1).join(F.broadcast(index.leaves().select(F.col("id").alias("cluster_id"), F.col("descriptor").alias("_leader"))), "cluster_id")
    return topk(own.select("cluster_id", "point_id", sq_l2("_leader", "descriptor").alias("dist")), 3, "cluster_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "exact_knn": exact_knn_scan,
    "find_parents": find_parents_query,
    "find_children": find_children_query,
    "route_greedy": route_greedy_query,
    "unwritten_leaders": unwritten_leaders_query,
    "quantize_u8": quantize_u8_query,
    **{
        f.__name__: f
        for f in (pairwise_distance, exact_knn_sql, knn_collected, knn_merged, leaf_sample, node_sample, index_nodes_by_level, paths_to_leaves, route_leaf_scan_b, route_greedy_widen, route_greedy_joins, assign_a1, assign_a3, random_clusters)
        + (cluster_sizes, cluster_scan, index_knn_leaf_scan, index_knn_greedy, index_knn_redundant_distinct, index_knn_keep_empty, hit_at_k, recall_at_k, score_line, reduction_prefix, stream_exact_knn, stream_index_knn, vecs_round_trip, squared_norm, topk_by_cluster)
        + (bvecs_round_trip, truth_round_trip, dimension_check, target_check, index_saved_nodes, index_visits, stream_rebalanced, job_batch_scan, job_batch_index, job_stream_index)
    },
}


def _dist(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _sample(name: str, source: str, share: str, seed: int) -> str:
    """A sampled level: the rows of least hash, or the one of the least if there are none."""
    return f"""{name}_h AS (SELECT id, d, md5('{seed}:' || id) AS h, {share} AS share FROM {source}),
{name}_k AS (SELECT id, d, h, share >= 1 OR substr(h, 1, 8) < format('{{:08x}}', CAST(floor(share * 4294967296) AS BIGINT)) AS k FROM {name}_h),
{name} AS (SELECT id, d FROM {name}_k WHERE k OR (NOT EXISTS (SELECT 1 FROM {name}_k WHERE k) AND h = (SELECT min(h) FROM {name}_k)))"""


def _level(name: str, below: str, level: int, height: int) -> str:
    target = f"ceil(pow((SELECT n FROM n), 1e0 - {level}e0 / {height + 1}e0))"
    size = f"(SELECT count(*) FROM {below})"
    return _sample(name, below, f"(CASE WHEN {target} > {size} THEN ceil(6e-1 * {size}) ELSE {target} END) / {size}", level)


def _nearest(name: str, left: str, right: str, k: int) -> str:
    return f"{name} AS (SELECT id, target, dist, rank FROM (SELECT l.id, r.id AS target, {_dist('l.d', 'r.d')} AS dist, row_number() OVER (PARTITION BY l.id ORDER BY {_dist('l.d', 'r.d')}, r.id) AS rank FROM {left} l, {right} r) WHERE rank <= {k})"


_BASE = "p AS (SELECT vec_id AS id, embedding AS d FROM embeddings), q AS (SELECT id // 20 AS id, d FROM p WHERE id % 20 = 0), n AS (SELECT count(*) AS n FROM p)"
_LEAVES = _sample("l0", "p", "ceil((SELECT n FROM n) / 31e0) / (SELECT n FROM n)", 0)


def _tree(height: int) -> str:
    out = [_BASE, _LEAVES]
    for level in range(1, height):
        out += [_level(f"l{level}", f"l{level - 1}", level, height), _nearest(f"e{level - 1}", f"l{level - 1}", f"l{level}", TREE_A)]
    return ", ".join(out)


def _greedy(name: str, vectors: str, keep: int, height: int, widen: bool = False) -> str:
    """Descent of ``vectors`` through a tree of 2 or 3 levels; ``name``: id, cluster_id, dist, rank."""
    if height == 2:
        out = [_nearest(f"{name}_1", vectors, "l1", 1)]
        at = f"SELECT id, target AS a, NULL AS before FROM {name}_1"
        wide = f"SELECT c.id, l0.id AS leaf FROM {name}_c c, l0 WHERE c.n < {keep}"
    else:
        step = f"SELECT t.id, e.id AS a, t.target AS before, row_number() OVER (PARTITION BY t.id ORDER BY {_dist('v.d', 'l1.d')}, e.id) AS r FROM {name}_2 t JOIN {vectors} v ON v.id = t.id JOIN e1 e ON e.target = t.target JOIN l1 ON l1.id = e.id"
        out = [_nearest(f"{name}_2", vectors, "l2", 1)]
        at = f"SELECT id, a, before FROM ({step}) WHERE r = 1"
        wide = f"SELECT DISTINCT c.id, y.id AS leaf FROM {name}_c c JOIN e1 x ON x.target = c.before JOIN e0 y ON y.target = x.id WHERE c.n < {keep}"
    out.append(f"{name}_a AS ({at})")
    out.append(f"{name}_c AS (SELECT t.id, t.a, t.before, count(e.id) AS n FROM {name}_a t LEFT JOIN e0 e ON e.target = t.a GROUP BY ALL)")
    leaves = f"SELECT c.id, e.id AS leaf FROM {name}_c c JOIN e0 e ON e.target = c.a" + (f" WHERE c.n >= {keep} UNION ALL {wide}" if widen else "")
    out.append(f"{name}_l AS ({leaves})")
    out.append(f"{name} AS (SELECT id, cluster_id, dist, rank FROM (SELECT x.id, x.leaf AS cluster_id, {_dist('v.d', 'l0.d')} AS dist, row_number() OVER (PARTITION BY x.id ORDER BY {_dist('v.d', 'l0.d')}, x.leaf) AS rank FROM {name}_l x JOIN {vectors} v ON v.id = x.id JOIN l0 ON l0.id = x.leaf) WHERE rank <= {keep})")
    return ", ".join(out)


def _search(assigned: str, routed: str, k: int = K) -> str:
    """``found``: the k nearest of the points in the routed clusters."""
    pairs = f"SELECT DISTINCT r.id AS query_id, p.id AS point_id, {_dist('q.d', 'p.d')} AS dist FROM {routed} r JOIN q ON q.id = r.id JOIN {assigned} a ON a.cluster_id = r.cluster_id JOIN p ON p.id = a.id"
    return f"found AS (SELECT query_id, point_id, dist, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, point_id) AS rank FROM ({pairs})) WHERE rank <= {k})"


def _leaf_routes(b: int = B) -> str:
    return _nearest("rt", "q", "l0", b) + ", r AS (SELECT id, target AS cluster_id, dist, rank FROM rt)"


_SCAN = f"WITH {_BASE}, {_nearest('x', 'q', 'p', K)} SELECT id AS query_id, target AS point_id, dist, CAST(rank AS INT) AS rank FROM x"
_RESULT = " SELECT query_id, point_id, dist, CAST(rank AS INT) AS rank FROM found"
_ROUTED = " SELECT id AS query_id, cluster_id, dist, CAST(rank AS INT) AS rank FROM r"
_PRUNED = f"WITH {_tree(2)}, {_greedy('a', 'p', 1, 2)}, {_leaf_routes()}, {_search('a', 'r')}"
_GREEDY_FOUND = f"WITH {_tree(2)}, {_greedy('a', 'p', 1, 2)}, {_greedy('r', 'q', B, 2, True)}, {_search('a', 'r')}" + _RESULT
_SCORES = (
    f""", {_nearest('tr', 'q', 'p', 100)},
up AS (SELECT query_id, point_id, row_number() OVER (PARTITION BY query_id ORDER BY dist, point_id) AS i FROM found),
dn AS (SELECT query_id, point_id, row_number() OVER (PARTITION BY query_id ORDER BY dist, point_id DESC) AS i FROM found),
hit AS (SELECT up.query_id, up.i, avg(CASE WHEN up.point_id = tr.target OR dn.point_id = tr.target THEN 1e0 ELSE 0e0 END) OVER (PARTITION BY up.query_id ORDER BY up.i ROWS UNBOUNDED PRECEDING) AS hit FROM up JOIN dn ON dn.query_id = up.query_id AND dn.i = up.i LEFT JOIN tr ON tr.id = up.query_id AND tr.rank = up.i),
rec AS (SELECT o.query_id, o.i, (SELECT count(*) FROM dn JOIN tr ON tr.id = dn.query_id AND tr.target = dn.point_id WHERE dn.query_id = o.query_id AND dn.i <= o.i AND tr.rank <= o.i) / CAST(o.i AS DOUBLE) AS recall FROM dn o)"""
)
_SCORED = _PRUNED + _SCORES
_SCAN_FOUND = f"WITH {_BASE}, {_nearest('x', 'q', 'p', K)}, found AS (SELECT id AS query_id, target AS point_id, dist, rank FROM x)"


def _lines(scored: str, k: int) -> str:
    """Score lines with latency 0, padded to k places."""
    part = f"SELECT {{t}}.query_id, string_agg(format('{{{{:.2f}}}}', round({{v}}, 2)), ';' ORDER BY i) || repeat(';#I/T', {k} - CAST(count(*) AS INT)) AS s FROM {{t}} GROUP BY query_id"
    return scored + f" SELECT CAST(h.query_id AS VARCHAR) || ';0;' || h.s || ';' || c.s AS value FROM ({part.format(t='hit', v='hit')}) h JOIN ({part.format(t='rec', v='recall')}) c ON c.query_id = h.query_id"


_CODED = "SELECT vec_id AS point_id, CAST(t.i - 1 AS INT) AS i, CAST(((CAST(trunc(embedding[t.i] * CAST(1000 AS FLOAT)) AS INT) % 256) + 256) % 256 AS INT) AS value FROM embeddings, unnest(range(1, len(embedding) + 1)) AS t(i)"

ORACLE_SQL: dict[str, str] = {
    "pairwise_distance": f"WITH {_BASE} SELECT q.id AS query_id, p.id AS point_id, {_dist('q.d', 'p.d')} AS dist FROM q, p",
    "squared_norm": f"WITH {_BASE} SELECT p.id AS point_id, {_dist('o.d', 'p.d')} AS dist FROM p, (SELECT d FROM p WHERE id = 0) o",
    **dict.fromkeys(("exact_knn", "exact_knn_sql", "knn_collected", "knn_merged", "stream_exact_knn", "stream_rebalanced"), _SCAN),
    "leaf_sample": f"WITH {_BASE}, {_LEAVES} SELECT id AS node_id FROM l0",
    "node_sample": f"WITH {_tree(2)} SELECT id AS node_id FROM l1",
    "find_parents": f"WITH {_tree(2)} SELECT target AS parent_id, id AS child_id FROM e0",
    "find_children": f"WITH {_tree(2)} SELECT l1.id AS node_id, count(e0.id) AS n_children, coalesce(string_agg(CAST(e0.id AS VARCHAR), ',' ORDER BY e0.id), '') AS children FROM l1 LEFT JOIN e0 ON e0.target = l1.id GROUP BY l1.id",
    "index_nodes_by_level": f"WITH {_tree(3)} SELECT 0 AS level, (SELECT count(*) FROM l0) AS actual, CAST(ceil(n / 31e0) AS BIGINT) AS expected FROM n UNION ALL SELECT 1, (SELECT count(*) FROM l1), CAST(ceil(pow(n, 1e0 - 1e0 / 4e0)) AS BIGINT) FROM n UNION ALL SELECT 2, (SELECT count(*) FROM l2), CAST(ceil(pow(n, 1e0 - 2e0 / 4e0)) AS BIGINT) FROM n",
    "paths_to_leaves": f"WITH {_tree(3)} SELECT e0.id AS node_id, count(*) AS paths FROM e0 JOIN e1 ON e1.id = e0.target GROUP BY e0.id",
    "route_leaf_scan_b": f"WITH {_BASE}, {_LEAVES}, {_leaf_routes()}" + _ROUTED,
    "route_greedy": f"WITH {_tree(2)}, {_greedy('r', 'q', B, 2)}" + _ROUTED,
    **dict.fromkeys(("route_greedy_widen", "route_greedy_joins"), f"WITH {_tree(3)}, {_greedy('r', 'q', 8, 3, True)}" + _ROUTED),
    "assign_a1": f"WITH {_tree(2)}, {_greedy('a', 'p', 1, 2)} SELECT id AS point_id, cluster_id FROM a",
    "assign_a3": f"WITH {_tree(2)}, {_greedy('a', 'p', 3, 2)} SELECT id AS point_id, cluster_id FROM a",
    "random_clusters": f"WITH {_BASE} SELECT id AS point_id, ((id % 2147483648) * 2654435761 % 4294967296) // 65536 % 16 + 1 AS cluster_id FROM p",
    "cluster_sizes": f"WITH {_tree(2)}, {_greedy('a', 'p', 1, 2)} SELECT cluster_id, count(*) AS points FROM a GROUP BY cluster_id",
    "cluster_scan": f"WITH {_tree(2)}, {_greedy('a', 'p', 1, 2)} SELECT cluster_id, id AS point_id FROM a WHERE cluster_id = (SELECT cluster_id FROM a GROUP BY cluster_id ORDER BY count(*) DESC, cluster_id LIMIT 1)",
    "unwritten_leaders": f"WITH {_tree(2)}, {_greedy('a', 'q', 1, 2)} SELECT id AS node_id FROM l0 WHERE id NOT IN (SELECT cluster_id FROM a)",
    "topk_by_cluster": f"WITH {_tree(2)}, {_greedy('a', 'p', 1, 2)}, z AS (SELECT a.cluster_id, a.id AS point_id, {_dist('l0.d', 'p.d')} AS dist FROM a JOIN p ON p.id = a.id JOIN l0 ON l0.id = a.cluster_id) SELECT cluster_id, point_id, dist, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY dist, point_id) AS rank FROM z) WHERE rank <= 3",
    "index_knn_leaf_scan": _PRUNED + _RESULT,
    **dict.fromkeys(("index_knn_greedy", "stream_index_knn"), _GREEDY_FOUND),
    "index_knn_redundant_distinct": f"WITH {_tree(2)}, {_greedy('a', 'p', 3, 2)}, {_leaf_routes()}, {_search('a', 'r')}" + _RESULT,
    "index_knn_keep_empty": f"WITH {_tree(3)}, {_greedy('a', 'p', 1, 3)}, {_leaf_routes(1)}, {_search('a', 'r')} SELECT q.id AS query_id, coalesce(point_id, -1) AS point_id, coalesce(dist, -1e0) AS dist, CAST(coalesce(rank, 0) AS INT) AS rank FROM q LEFT JOIN found ON query_id = q.id",
    "hit_at_k": _SCORED + " SELECT query_id, CAST(i AS INT) AS i, hit FROM hit",
    "recall_at_k": _SCORED + " SELECT query_id, CAST(i AS INT) AS i, recall FROM rec",
    "score_line": _lines(_SCORED, 12),
    **dict.fromkeys(("job_batch_index", "job_stream_index"), _lines(_SCORED, K)),
    "job_batch_scan": _lines(_SCAN_FOUND + _SCORES, K),
    "reduction_prefix": f"WITH {_BASE} SELECT id AS point_id FROM p WHERE id < (SELECT n FROM n) // 3",
    **dict.fromkeys(("quantize_u8", "bvecs_round_trip"), _CODED),
    "truth_round_trip": f"WITH {_BASE}, {_nearest('x', 'q', 'p', K)} SELECT id AS query_id, CAST(rank AS INT) AS rank, target AS point_id FROM x",
    "dimension_check": "SELECT CAST(more AS INT) AS more, more > 0 AS refused FROM range(2) t(more)",
    "target_check": "SELECT CAST(attempt AS INT) AS attempt, attempt > 1 AS refused FROM range(1, 3) t(attempt)",
    "index_saved_nodes": f"WITH {_tree(3)} SELECT CAST(0 AS INT) AS level, id AS node_id, CAST(0 AS BIGINT) AS n_children FROM l0 UNION ALL SELECT 1, l1.id, (SELECT count(*) FROM e0 WHERE e0.target = l1.id) FROM l1 UNION ALL SELECT 2, l2.id, (SELECT count(*) FROM e1 WHERE e1.target = l2.id) FROM l2",
    "index_visits": f"WITH {_tree(3)} SELECT e0.id AS node_id FROM e0 JOIN e1 ON e1.id = e0.target",
    "vecs_round_trip": "SELECT vec_id AS point_id, CAST(len(embedding) AS BIGINT) AS dim, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS total FROM embeddings",
}
