import random
import re
from collections import Counter

import numpy as np
import pytest

from vecprune.llm import neardup

DOCS = "doc_id long, text string"


def shingle_counts(t):
    w = re.findall(r"\w+", (t or "").lower())
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute(docs):
    """Class of every id, all pairs compared."""
    ids = [d for d, _ in docs]
    up, sets = {d: d for d in ids}, {d: shingle_counts(t) for d, t in docs}
    texts = dict(docs)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            both, whole = sum((sets[a] & sets[b]).values()), sum((sets[a] | sets[b]).values())
            if texts[a] is not None and texts[a] == texts[b] or whole and both >= 0.8 * whole:
                lo, hi = sorted((find(a), find(b)))
                up[hi] = lo
    return {d: find(d) for d in ids}


def variants(seed, groups=20, most=8, length=150):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.randint(1, length))]
        for _ in range(rng.randint(1, most)):
            w = list(base)
            for _ in range(rng.randint(0, max(0, len(w) // 60))):
                w[rng.randrange(len(w))] = rng.choice(words)
            out.append(" ".join(w))
    rng.shuffle(out)
    return list(enumerate(out, 10))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_brute_force(spark, seed):
    docs = variants(seed)
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(spark.createDataFrame(docs, DOCS)).collect()}
    assert got == brute(docs)


def test_fixture(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == brute(rows)


def test_one_large_group_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 2000)
    docs = variants(5, groups=1, most=60, length=100) + [(900, "q r s t u v")]
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(spark.createDataFrame(docs, DOCS)).collect()}
    assert got == brute(docs)


def test_links_between_finds_all():
    docs = variants(8, groups=5)
    texts = [t for _, t in docs]
    x, y = neardup.links_between(neardup.sets_of(texts, neardup.Words()), np.arange(len(texts)), np.ones(len(texts), dtype=bool))
    up = list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in zip(x, y):
        up[max(find(a), find(b))] = min(find(a), find(b))
    want = brute(list(enumerate(texts)))
    assert [find(i) for i in range(len(texts))] == [want[i] for i in range(len(texts))]


def test_agreement_is_the_weighted_similarity():
    rng = random.Random(0)
    shared = " ".join(f"w{rng.randrange(10**6)}" for _ in range(300))
    pairs = [(shared + " " + " ".join(f"a{i}" for i in range(n)), shared + " " + " ".join(f"b{i}" for i in range(n))) for n in (20, 60, 150)] + [("x y " * 40, "x y " * 60)]
    for a, b in pairs:
        got = []
        for salt in range(12):
            doc, e, w = neardup.shingles([a, b], neardup.Words())
            sig = neardup.signatures(doc, neardup._mix(e + np.uint64(salt)) >> np.uint64(20), w, 2)
            got.append((sig[0] == sig[1]).mean())
            assert np.isfinite(sig).all()
        ca, cb = shingle_counts(a), shingle_counts(b)
        assert abs(np.mean(got) - sum((ca & cb).values()) / sum((ca | cb).values())) < 0.06


def test_cases(spark):
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    docs = [(1, None), (2, None), (3, ""), (4, ""), (5, "?!"), (6, "a b"), (7, "A, b!"), (8, long), (9, long + " end"), (10, "z " * 5000), (10, "z " * 5000), (None, "n o p"), (12, "n o p"), (13, "-")]
    wide = spark.createDataFrame([(*r, "q") for r in docs], DOCS + ", class_id string")
    out = neardup.near_duplicates(wide).collect()
    got = {r["doc_id"]: r["class_id"] for r in out}
    assert len(out) == len(docs) and got[1] == 1 and got[2] == 2 and got[3] == got[4] == 3 and got[5] == 5 and got[6] == got[7] == 6
    assert got[8] == got[9] == 8 and got[10] == 10 and got[12] == got[None] and got[13] == 13
    kept = neardup.keep_first(wide)
    assert kept.columns == wide.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] not in (None, 12)) == [1, 2, 3, 5, 6, 8, 10, 13] and kept.count() == 9
    assert neardup.near_duplicates(wide.where("doc_id > 99")).count() == 0


def test_no_row_is_lost(spark):
    """Null and repeated ids, and ids that equal the hash of a null: every text is in one class, each class keeps one row."""
    near = " ".join(f"n{i}" for i in range(40))
    rows = [(None, None), (None, None), (42, "a text of its own"), (9, "the first text"), (9, "another text"), (None, near), (None, near + " x"), (7, near + " y z"), (None, "no id here"), (None, "nor here"), (5, "same row"), (5, "same row")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], DOCS + ", n long")
    out = neardup.near_duplicates(docs).collect()
    classes = {}
    for r in out:
        classes.setdefault(r["class_id"], []).append(r)
    assert len(out) == len(rows) and len(classes) == 9
    assert all(sum(r["is_first"] for r in c) == 1 for c in classes.values())
    kept = neardup.keep_first(docs).collect()
    assert len(kept) == 9 and [r["text"] for r in kept].count(None) == 2
    assert {r["text"] for r in kept} == {t for _, t in rows} - {near, near + " x"}
    assert {r["doc_id"] for r in kept} == {None, 42, 9, 7, 5}


def test_sets_hold_the_weighted_similarity():
    for a, b in (("x y " * 40, "x y " * 60), (" ".join("abcdefghij"), " ".join("abcdefghik")), ("a b", "a  B!")):
        ca, cb = shingle_counts(a), shingle_counts(b)
        x, y = neardup.sets_of([a, b], neardup.Words())
        assert abs(neardup.similarity(x, y) - sum((ca & cb).values()) / sum((ca | cb).values())) < 1e-9
    assert [len(s) for s in neardup.sets_of(["", None, "a"], neardup.Words())] == [0, 0, 1]


def test_recall_by_edits(spark):
    """Against all pairs, by the number of words changed: linked from a weighted similarity of 0.8 on, and only then."""
    rng, docs = random.Random(4), []
    for g in range(60):
        base = [f"g{g}w{rng.randrange(10**6)}" for _ in range(200)]
        docs.append((2 * g, " ".join(base)))
        for i in rng.sample(range(200), g // 6):
            base[i] = f"new{rng.randrange(10**6)}"
        docs.append((2 * g + 1, " ".join(base)))
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(spark.createDataFrame(docs, DOCS)).collect()}
    want = brute(docs)
    assert got == want and got[1] == 0 and want[119] == 119
