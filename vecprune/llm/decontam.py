"""Benchmark decontamination by test n-grams, in DataFrame operations only.

Words are runs of ``WORD`` after lower-casing A-Z. A window is 13 consecutive words of an item; an item of 1 to 12 words is
one window. The hashes of all windows form a set that every task holds, if there are no more than ``max_set`` of them;
beyond that, the hashes of the documents' windows, without words, are joined with them by a shuffle. Every hit is verified
by its words.

Defined cases: null and empty texts have no words and no hits; a null item_id hits but isn't listed; repeated documents
each get their row; repeated items count once; an empty benchmark hits nothing; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SIZE = 13
MAX_BROADCAST_KEYS = 1_000_000


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def benchmark_windows(benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """Distinct (window_hash, length, window, item_id)."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    items = items.withColumn("length", F.least(F.size("w"), F.lit(size)))
    starts = items.select("item_id", "length", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("length") + 1)).alias("at"))
    window = F.slice("w", F.col("at"), F.col("length"))
    hashed = F.xxhash64(F.transform(window, lambda w: F.xxhash64(w)))
    return starts.select(hashed.alias("window_hash"), "length", F.array_join(window, " ").alias("window"), "item_id").distinct()


def hits(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, max_set: int = 300_000) -> DataFrame:
    """Per document row: doc_id, n_words, spans (array of start word and length, verified, by start), items (item_ids hit)."""
    windows = written(benchmark_windows(benchmark, size), "windows")
    lengths = sorted(r["length"] for r in windows.select("length").distinct().collect())  # at most ``size``
    small = windows.count() <= max_set
    base = docs.select("doc_id", words_of(F.col("text")).alias("_w"))
    if not small:  # what is joined needs the same ids in every job
        base = written(base.withColumn("_id", F.monotonically_increasing_id()), "document-words")
    else:
        base = base.withColumn("_id", F.monotonically_increasing_id())
    base = base.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))

    def spotted(length: int, known: list[int] | None) -> Column:
        """Places whose hash is a window's, with the hash; with ``known`` null, all places."""
        at = f"sequence(1, size(_h) - {length - 1})"
        if known is not None:
            at = f"filter({at}, i -> xxhash64(slice(_h, i, {length})) IN ({', '.join(f'{k}L' if k > -(2**63) else '(-9223372036854775807L - 1L)' for k in known)}))"
        found = F.transform(F.expr(at), lambda i: F.struct(i.alias("at"), F.lit(length).alias("length"), F.xxhash64(F.slice("_h", i, length)).alias("hash")))
        return F.when(F.size("_h") >= length, found)

    empty = F.array().cast("array<struct<at:int,length:int,hash:bigint>>")
    if small:
        sets = {n: [r["window_hash"] for r in windows.where(F.col("length") == n).select("window_hash").distinct().collect()] for n in lengths}
        spots = F.concat(*[F.coalesce(spotted(n, sets[n]), empty) for n in lengths]) if lengths else empty
    else:
        # Hashes alone are shuffled; only the places whose hash is a window's come back to the words.
        every = base.select("_id", F.explode(F.concat(*[F.coalesce(spotted(n, None), empty) for n in lengths])).alias("s"))
        hashes = windows.select(F.col("window_hash").alias("_known")).distinct()
        hit = every.join(hashes, F.col("s.hash") == F.col("_known"), "left_semi").groupBy("_id").agg(F.collect_list("s").alias("_spots"))
        base = base.join(hit, "_id", "left")
        spots = F.coalesce("_spots", empty)
    spots = F.transform(spots, lambda s: s.withField("window", F.array_join(F.slice("_w", s["at"], s["length"]), " ")))
    each = base.select("_id", "doc_id", F.size("_w").cast("long").alias("n_words"), F.explode_outer(spots).alias("_hit"))
    each = each.select("_id", "doc_id", "n_words", F.col("_hit.at").alias("_at"), F.col("_hit.length").alias("_n"), F.col("_hit.hash").alias("window_hash"), F.col("_hit.window").alias("window"))
    known = windows.select("window_hash", "window", F.col("item_id").alias("_item"), F.lit(True).alias("_true"))
    joined = each.join(F.broadcast(known) if small else known, ["window_hash", "window"], "left")
    span = F.when(F.col("_true"), F.struct((F.col("_at") - 1).alias("start"), F.col("_n").alias("length")))
    grouped = joined.groupBy("_id", "doc_id", "n_words").agg(F.sort_array(F.collect_set(span)).alias("spans"), F.collect_set("_item").alias("items"))
    return grouped.select("doc_id", "n_words", "spans", "items", F.col("_id").alias("row_id"))


def words_hit(spans: Column) -> Column:
    """How many words the spans cover together; ``spans`` are sorted by start."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def add(acc, s):
        end = F.greatest(acc["end"], s["start"] + s["length"])
        return F.struct(end.alias("end"), (acc["n"] + (end - F.greatest(acc["end"], s["start"]))).alias("n"))

    return F.aggregate(spans, start, add)["n"]


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = hits(docs, benchmark, **options).withColumn("n_hit", words_hit(F.col("spans")))
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the contaminated documents; rows of one doc_id and text are judged alike."""
    bad = written(decontaminate_keys(docs, benchmark, **options), "contaminated")
    bad = F.broadcast(bad) if bad.count() <= MAX_BROADCAST_KEYS else bad
    keyed = docs.select(F.struct("*").alias("doc"), F.xxhash64("doc_id", "text").alias("_key"))
    return keyed.join(bad, "_key", "left_anti").select("doc.*")


def decontaminate_keys(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text")
    return decontaminate(keyed, benchmark, **options).where("contaminated").select(F.col("doc_id").alias("_key")).distinct()


def remove_spans(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per document row: doc_id and ``kept``, its normalised words outside every hit, joined by one space."""
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text")
    found = hits(keyed, benchmark, **options).where(F.size("spans") > 0).groupBy("doc_id").agg(F.first("spans").alias("_spans"))
    joined = docs.select("doc_id", words_of(F.col("text")).alias("_w"), F.xxhash64("doc_id", "text").alias("_key")).join(found.withColumnRenamed("doc_id", "_key"), "_key", "left")
    kept = F.when(F.col("_spans").isNull(), F.col("_w")).otherwise(F.filter("_w", lambda w, i: ~F.exists("_spans", lambda s: (s["start"] <= i) & (i < s["start"] + s["length"]))))
    return joined.select("doc_id", F.array_join(kept, " ").alias("kept"))


#: DuckDB SQL for decontaminate() over documents and benchmark.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
n AS (SELECT item_id, w, least(13, len(w)) AS k FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM n)),
x AS (SELECT doc_id, p, k, array_to_string(w[p:p + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM g) WHERE len(w) >= k)),
h AS (SELECT x.doc_id, x.p, x.k, g.item_id FROM x JOIN g ON x.g = g.g AND x.k = g.k),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS items_sha256 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), FALSE) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)
"""
