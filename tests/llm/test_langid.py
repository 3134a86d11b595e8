import itertools

import numpy as np
from pyspark.sql import functions as F

from vecprune.llm import langid

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string"


def model(seed=0, labels=("a", "b", "c")):
    rng = np.random.default_rng(seed)
    m = langid.Model(list(labels), {"xy": 1})
    m.of_feature[:] = rng.normal(size=m.of_feature.shape)
    m.of_word[:] = rng.normal(size=m.of_word.shape)
    m.step[:] = rng.normal(size=m.step.shape)
    m.of_feature[0] = m.of_word[0] = 0  # what no feature weighs
    return m


def brute(m, words):
    """Label probabilities of each word, over all label sequences."""
    e, k = m.emissions(words), len(m.labels)
    out, whole = np.zeros((len(words), k)), 0.0
    for path in itertools.product(range(k), repeat=len(words)):
        w = np.exp(sum(e[i, y] for i, y in enumerate(path)) + sum(m.step[a, b] for a, b in zip(path, path[1:])))
        whole += w
        for i, y in enumerate(path):
            out[i, y] += w
    return out / whole


def test_forward_backward_is_exact_over_chunks():
    m, rng = model(), np.random.default_rng(1)
    docs = [["".join(rng.choice(list("xyzuv"), size=rng.integers(1, 6))) for _ in range(n)] for n in (7, 1, 0, 3, 6)]
    tagger = langid.Tagger(m)
    tagger.CHUNK = 3
    want = np.array([brute(m, d).sum(axis=0) if d else np.zeros(3) for d in docs])
    assert np.allclose(tagger.sums(docs), want, atol=1e-5)
    e = m.emissions(docs[0])
    got, _ = langid.marginals(e[:, None, :], m.step)
    assert np.allclose(got[:, 0], brute(m, docs[0]))


def test_store_of_words_is_bounded():
    tagger = langid.Tagger(model())
    want = tagger.sums([["ab", "cd"]])
    tagger.STORE = 3
    tagger.sums([["q", "r", "s", "t", "u"]])
    assert np.allclose(tagger.sums([["ab", "cd"]]), want, atol=1e-6)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    rows = docs.select("doc_id", "lang").collect()
    assert len(got) == len(rows)
    assert all(got[r["doc_id"]]["held_out"] == langid.crc_held_out(r["doc_id"]) for r in rows)
    held = [r for r in rows if got[r["doc_id"]]["held_out"]]
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) > 0.96


def test_switching_text_is_labelled_by_word(spark):
    rows = [(f"{x} " * 30, y) for y, x in (("aa", "baba dada gaga"), ("oo", "lolo momo nono"))] * 20
    m = langid.fit(rows)
    words = "baba dada gaga baba lolo momo nono lolo".split()
    got, _ = langid.marginals(m.emissions(words)[:, None, :], m.step)
    assert got[:, 0].argmax(axis=1).tolist() == [0] * 4 + [1] * 4


def test_cases(spark):
    rows = [(i, "the cat and the dog", "en") for i in range(30)] + [(100 + i, "der hund und die katze", "de") for i in range(30)]
    rows += [(200, None, "en"), (201, "", "de"), (202, "12 34 !?", None), (203, "x" * 100_000, "en"), (204, "the " * 30_000, None), (5, "the cat and the dog", "en"), (None, "und die katze", "de")]
    docs = spark.createDataFrame([(*r, "z") for r in rows], DOCS + ", lang_pred string")
    out = langid.identify(docs).collect()
    assert len(out) == len(rows)
    got = {r["doc_id"]: r for r in out}
    assert [got[i]["lang_pred"] for i in (200, 201, 202)] == ["und"] * 3 and got[201]["score"] == 0.0
    assert got[204]["lang_pred"] == "en" and got[204]["n_words"] == 30_000 and got[None]["lang_pred"] == "de" and not got[None]["held_out"]
    assert all(0 <= r["score"] <= 1 for r in out)
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and {200, 201, 202}.isdisjoint(r["doc_id"] for r in kept.collect())
    assert langid.identify(docs.where("doc_id < 0")).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs.where("lang is null")).collect()} == {"und"}


def test_unidentifiable_text_is_dropped(spark):
    rng = np.random.default_rng(3)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    noise = [" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), size=rng.integers(2, 10))) for _ in range(80)) for _ in range(5)]
    odd = [*noise, "\u043f\u0440\u0438\u0432\u0435\u0442 \u043c\u0438\u0440 \u0441\u0435\u0433\u043e\u0434\u043d\u044f " * 20]
    added = spark.createDataFrame([(-1 - i, x, None) for i, x in enumerate(odd)], DOCS)
    kept = {r["doc_id"] for r in langid.keep_identified(docs.union(added)).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_even_scores_are_not_identified():
    for k in (2, 4, 9):
        m = langid.Model([f"l{i}" for i in range(k)], {})
        assert langid.Tagger(m).identified([["abc", "def"]], 0.25) == [False]


def test_number_signs_are_no_letters(spark):
    assert langid.words_of("\u00bd \u00b2\u00b3 \u2167 7") == [] and langid.words_of("ab\u00bdcd, \u00c9t\u00e9 \u2167x") == ["ab", "cd", "\u00e9t\u00e9", "x"]
    rows = [(i, "the cat and the dog", "en") for i in range(30)] + [(99, "\u00bd \u00b2\u00b3", "en"), (98, "\u2167", None)]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[99] == got[98] == "und" and got[0] == "en"


def test_query_against_plain_forward_backward(spark):
    """Every word's probabilities by the textbook recursion in logarithms, over each whole text as one chain."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(langid.sample(docs.where(~langid.held_out(F.col("doc_id")))))
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    for r in docs.collect():
        words = "".join(c if c.isalpha() else " " for c in r["text"].lower()).split()
        words = [w[i : i + langid.PIECE] for w in words for i in range(0, len(w), langid.PIECE)]
        e = model.emissions(words)
        a, b = [e[0]], [np.zeros(len(model.labels))]
        for x in e[1:]:
            a.append(np.logaddexp.reduce(a[-1][:, None] + model.step, axis=0) + x)
        for x in e[:0:-1]:
            b.append(np.logaddexp.reduce(model.step + (x + b[-1])[None, :], axis=1))
        both = np.array(a) + np.array(b[::-1])
        mean = np.exp(both - np.logaddexp.reduce(both, axis=1, keepdims=True)).mean(axis=0)
        assert abs(got[r["doc_id"]]["score"] - mean.max()) < 1e-4 and got[r["doc_id"]]["lang_pred"] == model.labels[mean.argmax()]
