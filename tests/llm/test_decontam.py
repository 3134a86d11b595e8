import hashlib
import random
import re

import duckdb
import pytest

from vecprune.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items):
    grams = {}
    for i, t in items:
        w = words(t)
        k = min(13, len(w))
        for s in range(len(w) - k + 1 if w else 0):
            grams.setdefault(tuple(w[s : s + k]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for k in {len(g) for g in grams}:
            for s in range(len(w) - k + 1):
                if tuple(w[s : s + k]) in grams:
                    hit |= set(range(s, s + k))
                    found |= grams[tuple(w[s : s + k])]
        names = ",".join(sorted(str(i) for i in found if i is not None))
        out.append((d, len(w), len(hit), len(found - {None}), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def small():
    rng = random.Random(4)
    vocabulary = ["A", "b", "Ça", "ça", "d1", "É", "x"]
    text = lambda n: rng.choice([" ", ", ", "--"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 12, 13, 14, 30]))) for i in range(6)] + [(7, None), (8, "?!"), (None, "q r s"), (3, "zz yy")]
    docs = [(i, text(rng.randint(0, 60)) + rng.choice(["", " " + (items[2][1] or "")])) for i in range(40)] + [(50, None), (51, ""), (52, "q R s " * 3), (52, "q R s " * 3), (53, "w " * 30_000 + items[5][1])]
    return docs, items


@pytest.mark.parametrize("max_set", [300_000, 0])
def test_brute_force(spark, max_set):
    docs, items = small()
    d = spark.createDataFrame([(*r, "z") for r in docs], "doc_id long, text string, n_hit string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, decontam.decontaminate(d, b, max_set=max_set).collect()), key=str) == brute(docs, items)
    bad = {(r[0]) for r in brute(docs, items) if r[5]}
    kept = decontam.drop_contaminated(d, b, max_set=max_set)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {i for i, _ in docs} - bad


def test_spans_are_removed(spark):
    b = spark.createDataFrame([(1, "One two three")], "item_id long, text string")
    d = spark.createDataFrame([(1, "a one two three b"), (2, "c"), (3, None)], "doc_id long, text string")
    assert sorted(map(tuple, decontam.remove_spans(d, b).collect())) == [(1, "a b"), (2, "c"), (3, "")]


def test_sql(spark):
    c, sf = duckdb.connect(), "/root/testdata/sf0.01"
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = decontam.decontaminate(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert sorted(map(tuple, got.collect())) == sorted(c.execute(decontam.SQL).fetchall())


def test_empty(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.decontaminate(d, none).first()["n_hit"] == 0 and decontam.drop_contaminated(d, none).count() == 1
    assert decontam.decontaminate(d.where("doc_id = 2"), none).count() == 0
