"""Fuzzy line dedup by MinHash, in DataFrame operations only.

A trimmed line's shingles are the ``SHINGLE`` characters from every position, in banding and in the exact comparison; a
shorter line is its own only shingle. They're cut from UTF-32, where a position is found at once. A signature is the least of the shingles' hashes under ``BANDS * ROWS``
permutations (a rotation by 0 to 48 bits and an exclusive-or with a seed), all made in one aggregation of the exploded
shingles, ``TOGETHER`` of them a row. Bands of ``ROWS`` make buckets. Every line of a bucket is compared with four of the bucket's lines (the first and
last by hash, and by a hash of that), by exact Jaccard similarity of the shingles' hashes; distributed union-find makes components. Buckets that
then hold several components are compared again: all pairs of different components that weren't compared before, in buckets
of more than ``SMALL`` lines by salted blocks of about as many. A bound from bit marks of the shingles
drops nearly all pairs that can't be similar before their shingles are compared.

Of every component, the first line by (doc_id, row, line number) stays and all others go. Blank lines always stay.

Defined cases: a null text has no lines; an empty text has one blank line; repeated documents are separate rows, of which
the first keeps its lines; null ids come first; ties don't arise; an empty table gives an empty result; other columns are
ignored. Lines are told apart by a 64-bit hash: among n different lines, some n * n / 2**65 are taken for equal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components

SHINGLE, BANDS, ROWS, LEAST, SMALL, MARKS, TOGETHER = 8, 10, 3, 0.8, 512, 32, 8
WIDE = 4 * SHINGLE
MAX_BROADCAST_IDS = 1_000_000


def _encoded(line: Column) -> Column:
    """A line in UTF-32, ``WIDE`` bytes a shingle."""
    return F.encode(line, "UTF-32")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once however often it's used and wherever the optimizer moves it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _hashes(line: Column) -> Column:
    """The shingles of a line, by 64-bit hashes, one for every position."""
    places = lambda e: F.sequence(F.lit(1), F.greatest(F.length(e) - (WIDE - 1), F.lit(1)), F.lit(4))
    return _once(_encoded(line), lambda e: F.transform(places(e), lambda i: F.xxhash64(F.substring(e, i, F.lit(WIDE)))))


def _trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r\x0b\x0c"))


def _lines(docs: DataFrame) -> DataFrame:
    """_row, doc_id, at, line, id of every line; id is null for blank lines."""
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_row"))
    lines = rows.select("_row", "doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return lines.withColumn("id", _once(_trimmed(F.col("line")), lambda x: F.when(x != "", F.xxhash64(x))))


def _seed(i: int) -> int:
    """Permutations of one hash function differ in their top bits, so that they pick from different parts of the hashes."""
    top = (i // 4) << 61
    low = (0x9E3779B97F4A7C15 * (i + 1)) % (1 << 61)
    value = top | low
    return value - (1 << 64) if value >= 1 << 63 else value


def _together(lines: DataFrame) -> DataFrame:
    """id, last (where the line's last shingle starts, in bytes) and h0, h1, ...: the hashes of ``TOGETHER`` shingles in a
    row. A line's last row is filled with its last shingle, which changes no minimum and no mark."""
    wide = lines.select("id", _encoded(_trimmed(F.col("line"))).alias("e")).withColumn("last", F.greatest(F.length("e") - WIDE, F.lit(0)))
    each = wide.select("id", "e", "last", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(4 * TOGETHER))).alias("i"))
    return each.selectExpr("id", "last", *[f"xxhash64(substring(e, least(i + {4 * j}, last) + 1, {WIDE})) AS h{j}" for j in range(TOGETHER)])


def _banded(lines: DataFrame) -> DataFrame:
    """(id, bands), the band keys of every distinct line. Copies of a line meet as one row of minima a task, not as texts."""
    each = _together(lines)
    turned = [f"shiftleft(h{j}, {16 * t}) | shiftrightunsigned(h{j}, {64 - 16 * t}) AS h{j}_{t}" for j in range(TOGETHER) for t in (1, 2, 3)]
    each = each.selectExpr("id", *[f"h{j} AS h{j}_0" for j in range(TOGETHER)], *turned)
    least = [", ".join(f"h{j}_{i % 4} ^ {_seed(i)}L" for j in range(TOGETHER)) for i in range(BANDS * ROWS)]
    signed = each.groupBy("id").agg(*[F.expr(f"min(least({x})) AS m{i}") for i, x in enumerate(least)])
    return signed.select("id", F.array(*[F.xxhash64(F.lit(b), *[f"m{b + BANDS * r}" for r in range(ROWS)]) for b in range(BANDS)]).alias("bands"))


def _marks(texts: DataFrame) -> DataFrame:
    """id, size (shingles, repeated ones too) and words w0, w1, ... with a bit for each shingle. ``texts`` has a row an id."""
    each = _together(texts.repartition("id"))
    words = [f"shiftrightunsigned(h{j}, 6) & {MARKS - 1} AS at{j}" for j in range(TOGETHER)]
    each = each.selectExpr("id", "last", *words, *[f"shiftleft(1L, cast(h{j} & 63 AS int)) AS bit{j}" for j in range(TOGETHER)])
    bits = [" | ".join(f"if(at{j} = {w}, bit{j}, 0L)" for j in range(TOGETHER)) for w in range(MARKS)]
    return each.groupBy("id").agg(F.expr("cast(max(last) / 4 + 1 AS long) AS size"), *[F.expr(f"bit_or({x}) AS w{w}") for w, x in enumerate(bits)])


def _near(words: int) -> Column:
    """Whether x and y may be similar, by ``words`` of their marks, w0 and on. Lines differ in as many shingles, at least,
    as in bits; at the least similarity that is a ninth of both lines' shingles at most, so no similar pair is missed."""
    return F.expr(" + ".join(f"bit_count(x.w{w} ^ y.w{w})" for w in range(words))) <= _most()


def _most() -> Column:
    """How many shingles similar lines x and y may differ in. Sizes that count repeated shingles only make it more."""
    return (F.col("x.size") + F.col("y.size")) * (1 - LEAST) / (1 + LEAST) + 1e-6


def _possible(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The pairs (a, b) of lines that may be similar."""
    one = pairs.alias("p").join(marks.alias("x"), F.col("p.a") == F.col("x.id"))
    return one.join(marks.alias("y"), F.col("p.b") == F.col("y.id")).where(_near(MARKS)).select("p.a", "p.b")


def _similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of similar lines. Of n shingles in common, the similarity is n in (both sizes less n). Repeated
    shingles are told apart only if a pair isn't similar with them; arrays are exploded so that each is made once."""
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("la")), "a").join(texts.select(F.col("id").alias("b"), F.col("line").alias("lb")), "b")
    sets = both.select("a", "b", F.explode(F.array(F.struct(_hashes(F.col("la")).alias("x"), _hashes(F.col("lb")).alias("y")))).alias("s"))
    counted = sets.select("a", "b", "s", F.explode(F.array(F.size(F.array_intersect("s.x", "s.y")))).alias("n"))
    alike = lambda x, y: F.col("n") >= LEAST * (F.size(x) + F.size(y) - F.col("n"))
    return counted.where(alike("s.x", "s.y") | alike(F.array_distinct("s.x"), F.array_distinct("s.y"))).select("a", "b")


def _between(members: DataFrame, once: bool = False) -> DataFrame:
    """Pairs (a, b) of different components of a bucket that may be similar. ``members``: key, id, root, n (lines of the
    bucket) and marks. Every pair of lines meets in one pair of blocks i <= j, in each of its common buckets or,
    with ``once``, in the least of them only. Half as many words as the marks have, each two laid over each other, drop most pairs in generated code; all words,
    in an array, are looped over for the rest."""
    half = MARKS // 2
    folded = [F.expr(f"w{w} | w{w + half} AS w{w}") for w in range(half)]
    keys = members.groupBy("id").agg(F.collect_set("key").alias("keys"))
    members = members.select("key", "id", "root", "n", "size", F.array(*[f"w{w}" for w in range(MARKS)]).alias("wide"), *folded)
    members = members.join(keys, "id") if once else members
    blocks = F.ceil(F.col("n") / SMALL).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    x = dealt.withColumn("i", F.col("own")).withColumn("j", F.explode(F.sequence("own", F.col("blocks") - 1))).alias("x")
    y = dealt.withColumn("j", F.col("own")).withColumn("i", F.explode(F.sequence(F.lit(0), "own"))).alias("y")
    same = (F.col("x.key") == F.col("y.key")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
    differ = (F.col("x.root") < F.col("y.root")) | ((F.col("x.root") > F.col("y.root")) & (F.col("x.i") < F.col("x.j")))
    here = F.array_min(F.array_intersect("x.keys", "y.keys")) == F.col("x.key") if once else F.lit(True)
    bits = F.aggregate(F.zip_with("x.wide", "y.wide", lambda v, w: F.bit_count(v.bitwiseXOR(w))), F.lit(0), lambda n, m: n + m)
    return x.join(y, same & differ & _near(half) & here & (bits <= _most())).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def line_components(lines: DataFrame) -> DataFrame:
    """(node, root) of the distinct lines, by hash, that have a similar one. ``lines``: id and line of lines that aren't blank."""
    keyed = _banded(lines).select(F.explode("bands").alias("key"), "id").repartition("key")
    shared = keyed.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
    members = written(keyed.join(shared.hint("shuffle_hash"), "key"), "line-buckets")
    ids = written(members.select("id").distinct(), "line-ids")
    ids = F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids
    texts = written(lines.join(ids, "id", "left_semi").groupBy("id").agg(_trimmed(F.first("line")).alias("line")), "line-texts")
    marks = written(_marks(texts), "line-marks")
    mixed_up = F.struct(F.xxhash64("id").alias("h"), "id")
    others = members.groupBy("key").agg(F.min(mixed_up).alias("lo"), F.max(mixed_up).alias("hi")).select("key", "lo", "hi")
    ends = members.join(others, "key").select("id", F.explode(F.array("least", "most", "lo.id", "hi.id")).alias("end")).where("id <> end")
    tried = ends.select(F.greatest("id", "end").alias("a"), F.least("id", "end").alias("b")).distinct()
    compared = written(_possible(tried, marks), "line-pairs")
    links = written(_similar(compared, texts), "line-links")
    roots = components(links)
    rooted = members.join(roots.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("key", "n")
    in_mixed = written(rooted.join(mixed, "key"), "line-mixed")
    pairs = _between(in_mixed.join(marks, "id"), True).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # Pairs that were compared and are still in different components aren't similar.
    pairs = written(pairs.join(compared, ["a", "b"], "left_anti"), "line-pairs")
    more = written(_similar(pairs, texts), "line-links")
    if more.isEmpty():
        return roots
    # Once is enough: every pair of lines that share a bucket is now in one component or has been compared.
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))


def _removed(lines: DataFrame) -> DataFrame:
    """(_row, at) of every line that goes."""
    places = lines.where(F.col("id").isNotNull()).select("_row", "doc_id", "at", "id")
    roots = line_components(lines.where(F.col("id").isNotNull()).select("id", "line")).withColumnRenamed("node", "id")
    roots = F.broadcast(roots) if roots.count() <= MAX_BROADCAST_IDS else roots
    rooted = places.join(roots, "id", "left").select("_row", "doc_id", "at", F.coalesce("root", "id").alias("root"))
    first = rooted.groupBy("root").agg(F.min(F.struct("doc_id", "_row", "at")).alias("f"), F.count("*").alias("n")).where("n > 1").select("root", F.col("f._row").alias("_first_row"), F.col("f.at").alias("_first_at"))
    return rooted.join(first, "root").where("_row <> _first_row OR at <> _first_at").select("_row", "at")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """One row per document row with lines: doc_id, n_lines, n_removed, removed (line numbers from 0, comma-joined)."""
    lines = written(_lines(docs), "lines")
    gone = _removed(lines).groupBy("_row").agg(F.sort_array(F.collect_list("at")).alias("gone"))
    out = lines.groupBy("_row", "doc_id").agg(F.count("*").alias("n_lines")).join(gone, "_row", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    found = out.select("doc_id", "n_lines", F.size("gone").cast("long").alias("n_removed"), F.array_join(F.col("gone").cast("array<string>"), ",").alias("removed"))
    none = docs.where(F.col("text").isNull()).select("doc_id", F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"), F.lit("").alias("removed"))
    return found.unionByName(none)


def kept_text(docs: DataFrame) -> DataFrame:
    """doc_id and text without the removed lines, a row per document row with a text."""
    lines = written(_lines(docs), "lines")
    marked = lines.select("_row", "doc_id", "at", "line").join(_removed(lines).withColumn("removed", F.lit(True)), ["_row", "at"], "left")
    kept = F.sort_array(F.collect_list(F.when(F.col("removed").isNull(), F.struct("at", "line"))))
    return marked.groupBy("_row", "doc_id").agg(kept.alias("kept")).select("doc_id", F.array_join(F.transform("kept", lambda x: x["line"]), "\n").alias("text"))
