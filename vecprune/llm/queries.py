"""The queries of this folder's operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, linededup, mih, mixing, neardup, pagetext, secretscan, sharding, substring
from .common import table


def op1_crf_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mih.search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op3_tag_path_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagetext.extract(table(spark, sf_dir, "pages"))


def op4_consistent_hash_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op5_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents"))


def op6_hierarchical_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_fm_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_substrings(table(spark, sf_dir, "documents"))


def op9_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_secret_entropy_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan(table(spark, sf_dir, "documents"))


_ALL = (
    op1_crf_language_id,
    op2_multi_index_hashing,
    op3_tag_path_ratios,
    op4_consistent_hash_sharding,
    op5_fuzzy_line_dedup,
    op6_hierarchical_mixing,
    op7_benchmark_decontamination,
    op8_fm_index_dedup,
    op9_dart_minhash,
    op10_secret_entropy_scan,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
ORACLE_SQL: dict[str, str] = {"op7_benchmark_decontamination": decontam.SQL, "op8_fm_index_dedup": substring.SQL}
