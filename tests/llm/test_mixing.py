from collections import defaultdict

import pytest
import xxhash  # noqa: F401

from vecprune.llm import mixing

DOCS = "doc_id long, text string, lang string, source string"


def corpus(spark, n=600):
    rows = []
    for i in range(n):
        s = 0 if i % 3 == 0 else i % 7
        rows.append((i, "w " * (i * 7 % 23), ["en", "de", None][i % 3], f"src{s}" if i % 11 else None))
    return rows, spark.createDataFrame(rows, DOCS)


def brute_budgets(leaves, weights, total, epochs):
    """Water filling in small steps of fractions, level by level."""

    def fill(budget, caps, w):
        got = {c: 0.0 for c in caps}
        while budget > 1e-9:
            live = [c for c in caps if caps[c] - got[c] > 1e-9]
            if not live:
                break
            whole = sum(w[c] for c in live)
            step = min(budget, min((caps[c] - got[c]) * whole / w[c] for c in live))
            for c in live:
                got[c] += step * w[c] / whole
            budget -= step
        return got

    out = {}

    def down(path, budget):
        if path in leaves:
            out[path] = budget
            return
        caps = defaultdict(float)
        for leaf, n in leaves.items():
            if leaf[: len(path)] == path:
                caps[leaf[len(path)]] += n * epochs
        for c, b in fill(budget, caps, {c: weights.get((*path, c), 1.0) for c in caps}).items():
            down((*path, c), b)

    down((), min(total, epochs * sum(leaves.values())))
    return out


@pytest.mark.parametrize("total", [0, 10, 1000, 3000, 10**6])
def test_budgets(total):
    leaves = {("a", "en", "x"): 100, ("a", "en", "y"): 900, ("a", "de", "x"): 50, ("b", "en", "z"): 2000, ("b", "fr", "z"): 3, ("c", "en", "q"): 0}
    weights = {("a",): 3.0, ("b",): 1.0, ("a", "de"): 5.0}
    got, want = mixing.budgets(leaves, weights, total, 2), brute_budgets(leaves, weights, total, 2)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) <= 3 for k in got)
    assert sum(got.values()) == min(total, 2 * sum(leaves.values()))


def test_unweighted_children_come_last():
    assert mixing.split(10, [("a", 0.0, 50), ("b", 1.0, 4)]) == {"a": 6, "b": 4}
    assert mixing.split(7, [("a", 1.0, 50), ("b", 1.0, 50), ("c", 1.0, 0)]) == {"a": 4, "b": 3, "c": 0}


@pytest.mark.parametrize("slice_rows", [1, 7, 2000])
@pytest.mark.parametrize("share", [0.3, 1.0, 1.7])
def test_prefixes_of_epochs(spark, share, slice_rows):
    rows, docs = corpus(spark)
    out = mixing.mix(docs, share=share, epochs=2, slice_rows=slice_rows).collect()
    tokens = {r[0]: len(r[1].split()) for r in rows}
    taken, whole = defaultdict(int), defaultdict(int)
    for r in rows:
        whole[r[2], r[3]] += tokens[r[0]]
    seen = set()
    for r in out:
        assert r["n_tokens"] == tokens[r["doc_id"]] and 0 <= r["n_taken"] <= r["n_tokens"] and (r["doc_id"], r["epoch"]) not in seen
        seen.add((r["doc_id"], r["epoch"]))
        taken[r["lang"], r["source"]] += r["n_taken"]
    assert sum(taken.values()) == min(int(share * sum(tokens.values())), 2 * sum(tokens.values()))
    cut = defaultdict(int)
    for r in out:
        cut[r["lang"], r["source"]] += r["n_taken"] < r["n_tokens"]
    assert max(cut.values(), default=0) <= 1
    for key, n in taken.items():
        epochs = {r["epoch"] for r in out if (r["lang"], r["source"]) == key}
        assert epochs == set(range(-(-n // whole[key]))) or n in (0, whole[key] * len(epochs))


def test_slices_do_not_matter(spark):
    _, docs = corpus(spark)
    a, b = (sorted(map(tuple, mixing.mix(docs, slice_rows=n).collect()), key=str) for n in (1, 2000))
    assert [r[:5] for r in a] == [r[:5] for r in b]


def test_large_trees_are_joined_not_broadcast(spark, monkeypatch):
    _, docs = corpus(spark)
    want = sorted(map(tuple, mixing.mix(docs, share=1.3, slice_rows=7).collect()), key=str)
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", 0)
    out = mixing.mix(docs, share=1.3, slice_rows=7)
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().optimizedPlan().toString() + out._jdf.queryExecution().sparkPlan().toString()
    assert sorted(map(tuple, out.collect()), key=str) == want


def test_many_leaves():
    leaves = {(f"d{i % 4}", f"l{i % 50}", f"s{i}"): i % 90 for i in range(60_000)}
    got = mixing.budgets(leaves, {("d0",): 3.0}, 10**6, 2)
    assert len(got) == 60_000 and sum(got.values()) == 10**6


def test_cases(spark):
    rows = [(1, None, None, None, "z"), (1, None, None, None, "z"), (2, "", "en", "src1", "z"), (None, "a b", "en", "x" * 50 + "9" * 30, "z"), (4, "w " * 100_000, "de", "src2", "z")]
    docs = spark.createDataFrame(rows, DOCS + ", domain string")
    out = mixing.mixed(docs, share=1.0, epochs=1)
    assert out.columns == docs.columns and out.count() == 5
    assert mixing.mix(docs, share=1.0, epochs=1).count() == 5
    assert mixing.mix(docs.where("doc_id > 9")).count() == 0 and mixing.mixed(docs.where("doc_id > 9")).count() == 0
