"""Scoring of results against ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING = "#I/T"  # fixed value: what stands for a result that isn't there


def truth_of(exact: DataFrame) -> DataFrame:
    """(query_id, neighbours): ids nearest first, from (query_id, point_id, dist) of an exact scan."""
    lists = exact.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("dist", "point_id"))).alias("nn"))
    return lists.select("query_id", F.transform("nn", lambda x: x["point_id"]).alias("neighbours"))


def _ids(nn: Column, descending: bool) -> Column:
    """Ids by distance, ties by id in the given direction."""
    sign = -1 if descending else 1
    keyed = F.array_sort(F.transform(nn, lambda x: F.struct(x["dist"].alias("dist"), (x["point_id"] * sign).alias("key"))))
    return F.transform(keyed, lambda x: x["key"] * sign)


def _matches(ids: Column, truth: Column, i: Column) -> Column:
    return F.coalesce(F.try_element_at(ids, i) == F.try_element_at(truth, i), F.lit(False))


def score(results: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, hit_at, recall_at): arrays over i from 1 to the number of results.

    hit@i: share of the first i places that agree with the truth under either order of ties. recall@i: share of the first
    i true neighbours among the first i results, ties by descending id. Places beyond the truth are misses. ``results``:
    query_id, nn; queries without truth have null arrays. The truth is joined by hash, so neither side has to be small.
    """
    joined = results.join(truth.select("query_id", F.transform("neighbours", lambda x: x.cast("long")).alias("_truth")), "query_id", "left")
    nn = F.filter("nn", lambda x: x["point_id"].isNotNull())
    joined = joined.select("query_id", "_truth", _ids(nn, False).alias("_up"), _ids(nn, True).alias("_down"))
    places = F.when(F.size("_up") > 0, F.sequence(F.lit(1), F.size("_up"))).otherwise(F.array().cast("array<int>"))
    hits = F.transform(places, lambda i: F.when(_matches(F.col("_up"), F.col("_truth"), i) | _matches(F.col("_down"), F.col("_truth"), i), 1.0).otherwise(0.0))
    joined = joined.withColumn("_places", places).withColumn("_hits", hits)
    mean = F.transform("_places", lambda i: F.aggregate(F.slice("_hits", 1, i), F.lit(0.0), lambda a, v: a + v) / i)
    common = F.transform("_places", lambda i: F.size(F.array_intersect(F.slice("_down", 1, i), F.slice("_truth", 1, i))) / i)
    known = F.col("_truth").isNotNull()
    return joined.select("query_id", F.when(known, mean).alias("hit_at"), F.when(known, common).alias("recall_at"))


def formatted(values: Column, k: int) -> Column:
    """``%.2f`` of each value, filled up to k places, joined by semicolons."""
    texts = F.transform(values, lambda x: F.format_string("%.2f", x))
    return F.array_join(F.concat(texts, F.array_repeat(F.lit(MISSING), F.greatest(F.lit(0), F.lit(k) - F.size(values)))), ";")


def score_lines(scores: DataFrame, k: int, latency_ms: Column | None = None) -> DataFrame:
    """(value): query id, latency, hit@1..k and recall@1..k in one line."""
    latency = F.lit(0).cast("long") if latency_ms is None else latency_ms
    return scores.select(F.concat_ws(";", F.col("query_id").cast("string"), latency.cast("string"), formatted(F.coalesce("hit_at", F.array().cast("array<double>")), k), formatted(F.coalesce("recall_at", F.array().cast("array<double>")), k)).alias("value"))
