import hashlib
import random

import duckdb
import numpy as np
import pytest

from vecprune.llm import substring

DOCS = "doc_id long, text string"


def brute(docs):
    """Expected rows of (doc_id, text), repeated rows in the given order."""
    seen, out = set(), []
    for d, t in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0)):
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - 19):
            w = tuple(words[s : s + 20])
            if w in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(w)
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((d, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=80):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(50)] + ["é", " x", "a b"]
    passages = [[rng.choice(words) for _ in range(rng.randint(15, 45))] for _ in range(6)]
    docs = []
    for i in range(n):
        w = [rng.choice(words[:5]) if rng.random() < 0.5 else rng.choice(words) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(w))
            w[at:at] = rng.choice(passages)
        docs.append((i, rng.choice([" ", "\n", "\t "]).join(w)))
    return docs


@pytest.mark.parametrize("hot", [2000, 3])
@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed, hot, monkeypatch):
    monkeypatch.setattr(substring, "HOT", hot)
    docs = corpus(seed)
    got = substring.dedup_substrings(spark.createDataFrame(docs, DOCS).repartition(5, "doc_id"))
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs)


def test_small_batches_and_shards(spark, monkeypatch):
    monkeypatch.setattr(substring, "SHARD_RUNS", 20)
    monkeypatch.setattr(substring, "BATCH_WORDS", 100)
    docs = corpus(5)
    assert sorted(map(tuple, substring.dedup_substrings(spark.createDataFrame(docs, DOCS)).collect()), key=str) == brute(docs)


def test_cases(spark):
    text = " ".join(f"t{i}" for i in range(25))
    docs = [(1, None), (2, ""), (3, text), (3, text), (None, text), (4, "same " * 5000), (5, " ".join(f"u{i}" for i in range(19))), (6, " ".join(f"u{i}" for i in range(19))), (7, " ".join(f"v{i}" for i in range(30_000)) + " " + text)]
    wide = spark.createDataFrame([(*r, "z") for r in docs], DOCS + ", spans string")
    assert sorted(map(tuple, substring.dedup_substrings(wide).collect()), key=str) == brute(docs)
    kept = {r["doc_id"]: r["text"] for r in substring.kept_text(wide.where("doc_id in (4, 5)")).collect()}
    assert kept == {4: " ".join(["same"] * 20), 5: docs[6][1]} or kept[4] == "same"
    assert substring.dedup_substrings(wide.where("doc_id > 99")).count() == 0


def test_fm_index_counts_and_places():
    rng = np.random.default_rng(3)
    text = np.concatenate([np.append(rng.integers(1, 4, size=n), 0) for n in (30, 1, 0, 50, 17)])
    index = substring.FMIndex(text, 4)
    for n in (1, 2, 5):
        for s in range(len(text) - n):
            pattern = text[s : s + n]
            if (pattern == 0).any():
                continue
            lo, hi = np.zeros(1, np.int64), np.full(1, len(text))
            for c in pattern[::-1]:
                lo, hi = index.extend(np.array([c]), lo, hi)
            places = [i for i in range(len(text) - n + 1) if (text[i : i + n] == pattern).all()]
            assert sorted(index.suffixes[lo[0] : hi[0]]) == places and index.first_of(lo, hi)[0] == places[0]


def test_sql(spark):
    c, sf = duckdb.connect(), "/root/testdata/sf0.01"
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = substring.dedup_substrings(spark.read.parquet(f"{sf}/documents.parquet"))
    assert sorted(map(tuple, got.collect())) == sorted(c.execute(substring.SQL).fetchall())


def test_many_copies_in_small_groups(spark, monkeypatch):
    monkeypatch.setattr(substring, "COPIES", 3)
    monkeypatch.setattr(substring, "SHARD_RUNS", 15)
    passages = [" ".join(f"p{k}.{i}" for i in range(40)) for k in range(3)]
    docs = [(i, f"{i} {passages[i % 3]} end {i}") for i in range(60)] + [(100 + i, passages[0]) for i in range(30)]
    got = substring.dedup_substrings(spark.createDataFrame(docs, DOCS).repartition(16))
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs)


def test_copies_are_decided_by_words():
    a, b = [f"a{i}".encode() for i in range(24)], [f"b{i}".encode() for i in range(30)]
    changed = [*a[:10], b"other", *a[11:]]
    unlike = [*a[:10], *b[10:20]]
    found = substring.earliest([a, b, a], [a, a[2:], changed, unlike, b, b[:20], [*b, b"b"]])
    assert found.tolist() == [0, 0, 3, 3, 1, 1, 3]
    assert substring.earliest([], [a]).tolist() == [0]
