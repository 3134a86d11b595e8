import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from vecprune.llm import decontam, langid, neardup
from vecprune.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "near-dedup", "decontamination", "mixing", "sharding"]
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.written(stage(spark, before, SF), "test")
        if name == "language ID":
            gone = {r["doc_id"] for r in langid.identify(before).where("lang_pred = 'und' or score < 0.25").collect()}
            assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()} - gone
            found = {r["doc_id"]: r["lang_pred"] for r in langid.identify(before).collect()}
            assert all(r["lang"] == found[r["doc_id"]] for r in after.collect())
        if name == "near-dedup":
            assert sorted(r["doc_id"] for r in after.collect()) == sorted({r["class_id"] for r in neardup.near_duplicates(before).collect()})
        if name == "decontamination":
            bad = {r["doc_id"] for r in decontam.decontaminate(before, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").collect()}
            assert bad and {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()} - bad
        if name == "mixing":
            assert {r["doc_id"] for r in after.collect()} <= {r["doc_id"] for r in before.collect()}
        if name == "sharding":
            sizes = [r["count"] for r in after.groupBy("shard").count().collect()]
            assert sum(sizes) == before.count() and max(sizes) - min(sizes) <= 1 and after.columns == [*columns, "shard", "slot"]
        else:
            assert after.columns == columns
        before = after
    assert corpus_pipeline.run(spark, SF).count() == before.count()


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_odd_rows(spark, stage):
    rows = [(1, None, None, None, None, "z"), (1, None, None, None, None, "z"), (2, "", "en", "src0", 0, "z"), (None, "some words in a text", "en", "src1", 20, None), (3, "w " * 50_000, "de", None, 100_000, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shingle string").withColumns({c: F.lit(c) for c in ("_id", "_key", "_row", "id", "doc", "key", "_epoch", "shard2")})
    out = stage(spark, docs, "/root/testdata/sf0.001")
    assert out.columns[: len(docs.columns)] == docs.columns and out.count() <= 10
    assert stage(spark, docs.where("doc_id > 99"), "/root/testdata/sf0.001").count() == 0


def test_queries():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 11)) and set(ORACLE_SQL) <= set(QUERIES)
