import random

import pytest

from vecprune.llm import linededup
from vecprune.llm.components import components

DOCS = "doc_id long, text string"


def shingles(line):
    return {line[i : i + 8] for i in range(max(1, len(line) - 7))}


def brute(docs):
    """(doc_id, lines, removed) with every pair of lines compared."""
    places = [(d, at, x.strip()) for d, t in sorted(docs, key=lambda r: r[0]) if t is not None for at, x in enumerate(t.split("\n"))]
    lines = sorted({x for _, _, x in places if x})
    up = {x: x for x in lines}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = {x: shingles(x) for x in lines}
    for i, x in enumerate(lines):
        for y in lines[:i]:
            if len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]):
                up[find(x)] = find(y)
    seen, gone = set(), {}
    for d, at, x in places:
        if x:
            if find(x) in seen:
                gone.setdefault(d, []).append(at)
            seen.add(find(x))
    return sorted((d, 0 if t is None else len(t.split("\n")), len(gone.get(d, [])), ",".join(map(str, gone.get(d, [])))) for d, t in docs)


def texts(seed, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 40))] for _ in range(25)]

    def line():
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2])):
            w[rng.randrange(len(w))] = rng.choice(words)
        return " " * rng.randint(0, 1) + " ".join(w)

    return [(i, "\n".join(line() if rng.random() < 0.9 else "" for _ in range(rng.randint(1, 8)))) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2, 5, 6])
def test_brute_force(spark, seed):
    docs = texts(seed)
    assert sorted(map(tuple, linededup.dedup_lines(spark.createDataFrame(docs, DOCS)).collect())) == brute(docs)


def test_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(linededup, "SMALL", 2)
    docs = texts(3, 40)
    assert sorted(map(tuple, linededup.dedup_lines(spark.createDataFrame(docs, DOCS)).collect())) == brute(docs)


def test_ends_of_long_words_count(spark):
    apart = ["order 1234567890 shipped", "order 1234567899 shipped", "the number is 5550000123456 today", "the number is 5550000987654 today"]
    near = ["a plain line of common words, and the last of them is longer: incomprehensibly", "a plain line of common words, and the last of them is longer: incomprehensible"]
    wide = ["\U0001f600" * 7 + "plain words after seven signs of four bytes", "\U0001f600" * 7 + "plain words after seven signs of four bytes!"]
    docs = list(enumerate(apart + near + wide))
    assert sorted(r["doc_id"] for r in linededup.dedup_lines(spark.createDataFrame(docs, DOCS)).where("n_removed > 0").collect()) == [5, 7]


def test_pairs_between_blocks(spark, monkeypatch):
    """Every pair of different components of a bucket once, whatever the blocks, and not only pairs with a component's head."""
    monkeypatch.setattr(linededup, "SMALL", 3)
    marks = ", ".join(f"w{w} long" for w in range(linededup.MARKS))
    rows = [(key, i, root, 20, 10, *[0] * linededup.MARKS) for key in (1, 2) for i in range(20) for root in [i % 4]]
    pairs = [tuple(sorted(p)) for p in linededup._between(spark.createDataFrame(rows, f"key long, id long, root long, n long, size long, {marks}")).collect()]
    assert sorted(pairs) == sorted(2 * [(i, j) for j in range(20) for i in range(j) if i % 4 != j % 4])


def test_pairs_of_least_common_bucket(spark, monkeypatch):
    """With once, a pair comes from one of its buckets, and pairs that share the second bucket only aren't lost."""
    monkeypatch.setattr(linededup, "SMALL", 3)
    marks = ", ".join(f"w{w} long" for w in range(linededup.MARKS))
    rows = [(key, i, i % 4, 20, 10, *[0] * linededup.MARKS) for key in (1, 2) for i in range(20) if key == 2 or i < 8]
    pairs = [tuple(sorted(p)) for p in linededup._between(spark.createDataFrame(rows, f"key long, id long, root long, n long, size long, {marks}"), True).collect()]
    assert sorted(pairs) == sorted((i, j) for j in range(20) for i in range(j) if i % 4 != j % 4)


def test_cases(spark):
    cjk = "".join(chr(0x4E00 + i) for i in range(60))
    rows = [(1, None), (2, ""), (3, "a b c\n\na b c\r"), (4, "x" * 100_000), (5, cjk), (6, cjk[:59] + "!"), (7, "only\there"), (7, "only\there"), (8, " ".join(f"w{i}" for i in range(20_000)))]
    docs = spark.createDataFrame([(*r, "q") for r in rows], DOCS + ", line string")
    out = sorted(map(tuple, linededup.dedup_lines(docs).collect()))
    assert out == [(1, 0, 0, ""), (2, 1, 0, ""), (3, 3, 1, "2"), (4, 1, 0, ""), (5, 1, 0, ""), (6, 1, 1, "0"), (7, 1, 0, ""), (7, 1, 1, "0"), (8, 1, 0, "")]
    kept = dict(map(tuple, linededup.kept_text(docs.where("doc_id in (3, 6)")).collect()))
    assert kept == {3: "a b c\n", 6: cjk[:59] + "!"}
    assert linededup.dedup_lines(docs.where("doc_id > 99")).count() == 0


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000 + i) for i in range(1, 300)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            lo, hi = sorted((find(a), find(b)))
            up[hi] = lo
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: find(x) for x in list(up)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_unlike_lines_stay(spark):
    """Lines whose words only begin alike stay; lines that differ in the last two letters don't."""
    rng = random.Random(9)
    heads = ["".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(10)]
    unlike = [" ".join(h + "".join(rng.choice("klmnop") for _ in range(9)) for h in heads) for _ in range(2)]
    long = " ".join("".join(rng.choice("abcdefghij") for _ in range(12)) for _ in range(12))
    out = linededup.dedup_lines(spark.createDataFrame(list(enumerate([*unlike, long, long[:-2] + "zz"])), DOCS))
    assert [r["n_removed"] for r in out.orderBy("doc_id").collect()] == [0, 0, 0, 1]


def test_rows_of_several_shingles(spark):
    """Signatures and marks see every shingle, in an eighth of the rows."""
    rng = random.Random(4)
    lines = ["".join(rng.choice("ab é一\U0001f600") for _ in range(n)).strip() + "." for n in [*range(40), 100, 1000]]
    table = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    rows = linededup._together(table).collect()
    alone = {r["id"]: set(r["x"]) for r in table.select("id", linededup._hashes(table["line"]).alias("x")).collect()}
    for i, line in enumerate(lines):
        mine = [r for r in rows if r["id"] == i]
        assert len(mine) == -(-max(1, len(line) - 7) // 8)
        assert {r[f"h{j}"] for r in mine for j in range(8)} == alone[i]
        assert len(alone[i]) == len(shingles(line))


def test_repeated_shingles_count_once(spark):
    """Lines that repeat themselves are compared, and marked, by their different shingles."""
    part = "a part of many words that comes again and again, "
    docs = list(enumerate([part * 4, part * 9, part * 2 + "and then it ends", "x" * 50, "x" * 5000]))
    assert sorted(map(tuple, linededup.dedup_lines(spark.createDataFrame(docs, DOCS)).collect())) == brute(docs)
    assert [r[0] for r in docs if len(shingles(r[1].strip())) < len(r[1]) / 2] == [0, 1, 3, 4]


def test_no_pair_is_compared_twice(spark, monkeypatch):
    """A pair that wasn't similar to an end of its bucket isn't compared again between components."""
    rng = random.Random(11)
    part = lambda: "".join(rng.choice("abcdefghijkl ") for _ in range(47))
    base = [part() for _ in range(17)]
    lines = [".".join(part() if j == i else x for j, x in enumerate(base)) + "." for i in range(17)]
    docs = list(enumerate(lines))
    seen, similar = [], linededup._similar

    def counted(pairs, texts):
        seen.extend(tuple(sorted(p)) for p in pairs.collect())
        return similar(pairs, texts)

    monkeypatch.setattr(linededup, "_similar", counted)
    assert sorted(map(tuple, linededup.dedup_lines(spark.createDataFrame(docs, DOCS)).collect())) == brute(docs)
    assert seen and len(seen) == len(set(seen))
