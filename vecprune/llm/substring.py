"""Substring dedup: compressed FM-index per shard, searched backward for the matching statistics of streamed documents.

A window is ``WINDOW`` consecutive words of one document. A window is a repeat if its word sequence also starts earlier.
Windows are routed so that equal ones meet: each has an anchor, the least hash among its ``GRAM``-word grams, and a run is
a stretch of windows that share theirs (35 words at most). Runs of words are dealt to shards, where an FM-index (the
Burrows-Wheeler transform in a wavelet matrix with packed bits and block counts) is searched backward:

* The first run of each content, if its anchor has several contents, is dealt by anchor. A shard's text is its runs in
  document order; every window is searched from its last word on, as long as the match occurs elsewhere. Matches of
  ``WINDOW`` words are reported if the least text position in their interval is before the window.
* The other runs of a content (copies, by 128 bits of hash) are dealt by content, ``COPIES`` of them together with the first
  run, which is the text there. A copy is searched as a whole, and reported if the match lies in an earlier run.

Copies of one content within a batch of documents are compared with the batch's first one word by word, before any shuffle,
so that a content which a third of all documents hold comes to the tasks as one row a batch. So hashes only choose what is
compared: no word is removed unless words are equal. Anchors with over ``HOT`` contents (a common passage in many
surroundings) have their windows dealt one by one, by their own hash, again with one row a batch.

Defined cases: null and empty texts have no words; texts of under ``WINDOW`` words keep all of them; a null doc_id comes
before all others; rows of one doc_id are told apart by their place in the table; repeated rows repeat the first of them;
long texts are processed whole; an empty table gives an empty result; other columns are ignored. Rows get their numbers once,
in a table in the shared folder, so that losing or gaining executors between jobs changes nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stage import discard
from .common import written

WINDOW, GRAM, HOT, COPIES = 20, 5, 2000, 1000
SHARD_RUNS = 40_000
BATCH_WORDS = 500_000
RUN, HOT_RUN, FIRST, COPY = range(4)  # kinds of runs: by anchor, by window, and a content's first and its copies
_U = np.uint64
_B = _U(0x9E3779B97F4A7C15)
_B_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_INTERVALS = "_row long, start int, stop int"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def split_words(text: str | None) -> list[bytes]:
    """Words of any characters but space and U+0009 to U+000D."""
    return text.encode().split() if text else []


class Hashes(dict):
    """Hashes of words; forgets them all when there are too many."""

    MOST = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class Powers:
    """Powers of the base and of its inverse, as many as a batch needs."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def need(self, n: int) -> None:
        if n > len(self.up):
            self.up = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, _B)]))
            self.down = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, _B_INVERSE)]))


def runs(flat: np.ndarray, size: np.ndarray, powers: Powers) -> tuple[np.ndarray, ...]:
    """(document, start in it, windows, anchor, content) of the runs of documents of ``size`` words with hashes ``flat``."""
    n = len(flat)
    if n < WINDOW:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(size)), size)
    begin = np.cumsum(size) - size
    left = np.repeat(begin + size, size) - np.arange(n)
    powers.need(n + 1)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(flat * powers.up[:n], dtype=np.uint64)])
    grams = n - GRAM + 1
    value = _mix((prefix[GRAM:] - prefix[:grams]) * powers.down[:grams])
    place = np.arange(grams)
    width, span = 1, WINDOW - GRAM + 1
    while width < span:  # the least gram, the leftmost of equal ones, of ever wider spans
        step = min(width, span - width)
        a, b = value[:-step], value[step:]
        right = b < a
        value = np.where(right, b, a)
        place = np.where(right, place[step:], place[:-step])
        width += step
    valid = left[: len(place)] >= WINDOW
    new = valid.copy()
    new[1:] &= (place[1:] != place[:-1]) | (doc[1 : len(place)] != doc[: len(place) - 1])
    start = np.flatnonzero(new)
    count = np.add.reduceat(valid, start, dtype=np.int64) if len(start) else np.zeros(0, np.int64)
    stop = start + count + WINDOW - 1
    content = _mix((prefix[stop] - prefix[start]) * powers.down[start] + count.astype(np.uint64) * _U(0xD6E8FEB86659FD93))
    return doc[start], start - begin[doc[start]], count, value[start], content


def joined(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of documents, joined where they meet."""
    if not len(doc):
        return doc, start, stop
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    shift = doc * np.int64(1 << 40)
    reach = np.maximum.accumulate(stop + shift)
    new = np.ones(len(doc), dtype=bool)
    new[1:] = start[1:] + shift[1:] > reach[:-1]
    at = np.flatnonzero(new)
    last = np.concatenate([at[1:], [len(doc)]]) - 1
    return doc[at], start[at], reach[last] - shift[at]


def _batches(batches: Iterator[pa.RecordBatch], most: int = BATCH_WORDS) -> Iterator[tuple[list, list, list]]:
    """(doc_id, _row, words) of documents in order, about ``most`` words at a time, at least one document."""
    rows, size = [], 0
    for batch in batches:
        for d, r, t in zip(batch.column("doc_id").to_pylist(), batch.column("_row").to_pylist(), batch.column("text")):
            words = split_words(t.as_py())
            rows.append((d, r, words))
            size += len(words)
            if size >= most:
                rows.sort(key=lambda x: x[:2])
                yield tuple(map(list, zip(*rows)))
                rows, size = [], 0
    if rows:
        rows.sort(key=lambda x: x[:2])
        yield tuple(map(list, zip(*rows)))


def _runs_of(docs: DataFrame) -> DataFrame:
    """Runs that are the first of their content in their batch, and (where ``content`` is null) intervals of those equal to it."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, powers = Hashes(), Powers()
        for doc_ids, rows, words in _batches(batches):
            size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
            flat = np.fromiter((hashes[w] for ws in words for w in ws), dtype=np.uint64, count=int(size.sum()))
            doc, start, count, anchor, content = runs(flat, size, powers)
            first, same = np.zeros(len(doc), dtype=bool), np.zeros(len(doc), dtype=bool)
            if len(doc):
                _, lead, group = np.unique(_mix(anchor) ^ content, return_index=True, return_inverse=True)
                first[lead] = True
                ends = start + count + WINDOW - 1
                copies = np.flatnonzero(~first)
                at = [x[i].tolist() for i in (copies, lead[group[copies]]) for x in (doc, start, ends)]
                same[copies] = [words[a][b:c] == words[d][e:f] for a, b, c, d, e, f in zip(*at)]
            ids, places = np.array(doc_ids, dtype=np.int64), np.array(rows, dtype=np.int64)
            d, s, e = joined(doc[same], start[same], (start + count + WINDOW - 1)[same])
            key = _mix(d.astype(np.uint64) * _B + _U(1)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([anchor[first].view(np.int64), key])),
                    pa.array(np.concatenate([content[first].view(np.int64), np.zeros(len(d), np.int64)]), mask=np.concatenate([np.zeros(int(first.sum()), bool), np.ones(len(d), bool)])),
                    pa.array(np.concatenate([ids[doc[first]], ids[d]])),
                    pa.array(np.concatenate([places[doc[first]], places[d]])),
                    pa.array(np.concatenate([start[first], s]).astype(np.int32)),
                    pa.array(np.concatenate([(start + count + WINDOW - 1)[first], e]).astype(np.int32)),
                ],
                names=["anchor", "content", "doc_id", "_row", "start", "stop"],
            )

    return docs.mapInArrow(kernel, "anchor long, content long, doc_id long, _row long, start int, stop int")


class WaveletMatrix:
    """Rank over a sequence of small integers: one packed bit vector a bit of the alphabet, with counts by 64 bits."""

    def __init__(self, text: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        pad = -(len(text) + 1) % 64 + 1
        for level in range(self.levels - 1, -1, -1):
            bit = ((text >> level) & 1).astype(bool)
            packed = np.packbits(np.concatenate([bit, np.zeros(pad, bool)]), bitorder="little").view(np.uint64)
            ones = np.bitwise_count(packed).astype(np.int64)
            self.words.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(ones)[:-1]]))
            self.zeros.append(len(text) - int(bit.sum()))
            text = np.concatenate([text[~bit], text[bit]])
        self.base = self.down(np.arange(symbols), np.zeros(symbols, np.int64))

    def down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the first ``at`` places lead at the last level, for each symbol."""
        for i in range(self.levels):
            block, rest = at >> 6, (at & 63).astype(np.uint64)
            ones = self.counts[i][block] + np.bitwise_count(self.words[i][block] & ((_U(1) << rest) - _U(1))).astype(np.int64)
            at = np.where((symbol >> (self.levels - 1 - i)) & 1, self.zeros[i] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.down(symbol, at) - self.base[symbol]


class FMIndex:
    """Compressed full-text index over sequences of symbols from 1; 0 ends each sequence."""

    def __init__(self, text: np.ndarray, symbols: int):
        n = len(text)
        ends = text == 0
        rank = np.where(ends, np.cumsum(ends) - 1, text + int(ends.sum()))  # ends differ, in text order
        step = 1
        while True:
            key = rank * np.int64(n + symbols + 2) + np.concatenate([rank[step:], np.full(min(step, n), -1)])[:n] + 1
            order = np.argsort(key, kind="stable")
            fresh = np.ones(n, dtype=np.int64)
            fresh[1:] = key[order[1:]] != key[order[:-1]]
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.cumsum(fresh) - 1
            if fresh.all():
                break
            step *= 2
        self.suffixes = order
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.bwt = WaveletMatrix(text[order - 1], symbols)

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the matches with a symbol more at their front."""
        return self.starts[symbol] + self.bwt.rank(symbol, lo), self.starts[symbol] + self.bwt.rank(symbol, hi)

    def first_of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The least text position in each interval; intervals are equal or disjoint."""
        some, back = np.unique(lo, return_inverse=True)
        ends = np.zeros(len(some), dtype=np.int64)
        ends[back] = hi
        cuts = np.stack([some, ends], axis=1).ravel()
        least = np.minimum.reduceat(np.append(self.suffixes, len(self.suffixes)), cuts)[::2]
        return least[back]


def _indexed(sequences: list[list[bytes]]) -> tuple[FMIndex, np.ndarray, np.ndarray, np.ndarray, dict[bytes, int]]:
    """Index, text, sizes and begins of sequences, and the symbols of their words."""
    size = np.fromiter(map(len, sequences), dtype=np.int64, count=len(sequences))
    ids: dict[bytes, int] = {}
    text = np.zeros(int(size.sum()) + len(size), dtype=np.int64)
    begin = np.cumsum(size + 1) - size - 1
    flat = np.fromiter((ids.setdefault(w, len(ids) + 1) for ws in sequences for w in ws), dtype=np.int64, count=int(size.sum()))
    text[np.arange(len(flat)) + np.repeat(np.arange(len(size)), size)] = flat
    return FMIndex(text, len(ids) + 1), text, size, begin, ids


def repeats(sequences: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, start) of the windows that also start earlier; sequences are in document order."""
    index, text, size, begin, _ = _indexed(sequences)
    windows = np.maximum(size - WINDOW + 1, 0)
    which = np.repeat(np.arange(len(size)), windows)
    start = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = begin[which] + start
    lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(text))
    active = np.arange(len(at))
    for back in range(WINDOW - 1, -1, -1):
        lo[active], hi[active] = index.extend(text[at[active] + back], lo[active], hi[active])
        active = active[hi[active] - lo[active] > 1]
        if not len(active):
            break
    active = active[index.first_of(lo[active], hi[active]) < at[active]] if len(active) else active
    return which[active], start[active]


def earliest(sequences: list[list[bytes]], patterns: list[list[bytes]]) -> np.ndarray:
    """The number of the first sequence that holds each whole pattern, beyond all numbers if none does."""
    out = np.full(len(patterns), len(sequences), dtype=np.int64)
    if not sequences or not patterns:
        return out
    index, text, _, begin, ids = _indexed(sequences)
    size = np.fromiter(map(len, patterns), dtype=np.int64, count=len(patterns))
    flat = np.fromiter((ids.get(w, 0) for ws in patterns for w in ws), dtype=np.int64, count=int(size.sum()))
    end = np.cumsum(size)
    lo, hi = np.zeros(len(size), np.int64), np.full(len(size), len(text))
    hi[np.unique(np.repeat(np.arange(len(size)), size)[flat == 0])] = 0  # words that the text doesn't have
    live = hi > lo
    for back in range(1, int(size.max()) + 1):
        some = np.flatnonzero(live & (size >= back))
        lo[some], hi[some] = index.extend(flat[end[some] - back], lo[some], hi[some])
        live[some] = hi[some] > lo[some]
    some = np.flatnonzero(live & (size > 0))
    for length in np.unique(size[some]):  # intervals of different lengths may nest
        of = some[size[some] == length]
        out[of] = np.searchsorted(begin, index.first_of(lo[of], hi[of]), side="right") - 1
    return out


def _search(segments: DataFrame) -> DataFrame:
    """Intervals of repeated windows, by shard. ``segments``: copies, shard, kind, doc_id, _row, start, words."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "_row", "start"], kind="stable")
        row, at = pdf["_row"].to_numpy(), pdf["start"].to_numpy().astype(np.int64)
        if pdf["copies"].iloc[0]:
            copy = pdf["kind"].to_numpy() == COPY
            text = ~copy & ~pdf.duplicated(["kind", "_row", "start"]).to_numpy()  # a content's groups may share a shard
            alike, patterns = pd.factorize(pdf["words"][copy])
            patterns = [w.split() for w in patterns]
            found = earliest([w.split() for w in pdf["words"][text]], patterns)[alike] < np.cumsum(text)[copy]
            which = np.flatnonzero(copy)[found]
            start = np.zeros(len(which), np.int64)
            size = np.fromiter(map(len, patterns), dtype=np.int64, count=len(patterns))[alike[found]]
        else:
            which, start = repeats([w.split() for w in pdf["words"]])
            size = np.full(len(which), WINDOW)
        rows, code = np.unique(row[which], return_inverse=True) if len(which) else (row[:0], which)
        d, s, e = joined(code, at[which] + start, at[which] + start + size)
        return pd.DataFrame({"_row": rows[d] if len(d) else row[:0], "start": s.astype(np.int32), "stop": e.astype(np.int32)})

    return segments.groupBy("copies", "shard").applyInPandas(kernel, _INTERVALS)


def _segments(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted runs' words, with the key that deals them to shards. ``wanted``: _row and runs of a document."""
    schema = "kind int, key long, doc_id long, _row long, start int, stop int, words binary"
    types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    names = ["kind", "key", "doc_id", "_row", "start", "stop", "words"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

        for batch in batches:
            seen: set[bytes] = set()
            rows: list[tuple] = []
            order = sorted(zip(batch.column("doc_id").to_pylist(), batch.column("_row").to_pylist(), range(batch.num_rows)))
            for doc_id, row, i in order:
                words = split_words(batch.column("text")[i].as_py())
                for run in sorted(batch.column("runs")[i].as_py(), key=lambda r: r["start"]):
                    s, e = run["start"], run["stop"]
                    if run["kind"] != HOT_RUN:
                        rows.append((run["kind"], run["key"], doc_id, row, s, e, b" ".join(words[s:e])))
                    else:
                        for at in range(s, e - WINDOW + 1):
                            window = b" ".join(words[at : at + WINDOW])
                            if window in seen:
                                rows.append((RUN, None, doc_id, row, at, at + WINDOW, None))
                            else:
                                seen.add(window)
                                rows.append((RUN, xxhash.xxh3_64_intdigest(window) - (1 << 63), doc_id, row, at, at + WINDOW, window))
                    if len(rows) >= 20_000:
                        yield out(rows)
                        rows = []
            yield out(rows)

    return docs.join(wanted, "_row").select("doc_id", "_row", "text", "runs").mapInArrow(kernel, schema)


def intervals(docs: DataFrame) -> DataFrame:
    """(_row, start, stop): stretches of words covered by repeated windows. ``docs``: doc_id, _row, text."""
    spark = docs.sparkSession
    # By anchor and content, so that an anchor of very many contents is in many tasks; rows of known intervals have an anchor of their own.
    alike = Window.partitionBy("anchor", "content")
    ranked = _runs_of(docs).withColumns({"n": F.row_number().over(alike.orderBy("doc_id", "_row", "start")), "of": F.count("*").over(alike)})
    ranked = written(ranked, "runs")
    known = written(ranked.where("content IS NULL").select("_row", "start", "stop"), "known")
    runs_ = ranked.where("content IS NOT NULL")
    firsts = runs_.where("n = 1")
    several = firsts.groupBy("anchor").agg(F.count("*").alias("contents")).where("contents > 1")
    kind = F.when(F.col("contents") > HOT, HOT_RUN).otherwise(RUN)
    group = F.expr(f"(n - 2) div {COPIES}")
    entries = [
        firsts.join(several, "anchor").select("_row", "start", "stop", kind.alias("kind"), F.col("anchor").alias("key")),
        firsts.where("of > 1").withColumn("_group", F.explode(F.expr(f"sequence(0L, (of - 2) div {COPIES})"))).select("_row", "start", "stop", F.lit(FIRST).alias("kind"), F.xxhash64("content", "_group").alias("key")),
        runs_.where("n > 1").select("_row", "start", "stop", F.lit(COPY).alias("kind"), F.xxhash64("content", group).alias("key")),
    ]
    every = entries[0].union(entries[1]).union(entries[2])
    wanted = written(every.groupBy("_row").agg(F.collect_list(F.struct("kind", "key", "start", "stop")).alias("runs")), "wanted-runs")
    discard(ranked)
    segments = written(_segments(docs, wanted).withColumn("copies", F.col("kind") >= FIRST), "segments")
    discard(wanted)
    known = known.union(segments.where("words IS NULL").select("_row", "start", "stop"))
    dealt = segments.where("words IS NOT NULL")
    counts = {r["copies"]: r["count"] for r in dealt.groupBy("copies").count().collect()}
    shards = {c: max(-(-n // SHARD_RUNS), int(spark.conf.get("spark.sql.shuffle.partitions")) if n > SHARD_RUNS else 1) for c, n in counts.items()}
    number = F.pmod(F.xxhash64("key"), F.when(F.col("copies"), shards.get(True, 1)).otherwise(shards.get(False, 1))).cast("int")
    return known.union(_search(dealt.select("copies", number.alias("shard"), "kind", "doc_id", "_row", "start", "words")))


def _numbered(docs: DataFrame) -> DataFrame:
    least = F.lit(-(2**63))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), least).alias("doc_id"), "text", F.monotonically_increasing_id().alias("_row"))


def _covered(spans: list[dict] | None, n: int) -> np.ndarray:
    gone = np.zeros(n + 1, dtype=np.int64)
    for s in spans or ():
        gone[s["start"]] += 1
        gone[s["stop"]] -= 1
    return np.cumsum(gone)[:n] > 0


def _with_spans(docs: DataFrame) -> DataFrame:
    rows = written(_numbered(docs), "numbered")
    spans = written(intervals(rows).groupBy("_row").agg(F.collect_list(F.struct("start", "stop")).alias("spans")), "spans")
    return rows.join(spans, "_row", "left").select("doc_id", "text", "spans")


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """One row per document row: doc_id, n_words, n_removed, kept_sha256."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, digests = [], [], []
            for text, spans in zip(batch.column("text"), batch.column("spans")):
                words = split_words(text.as_py())
                gone = _covered(spans.as_py(), len(words)) if spans.is_valid else np.zeros(len(words), dtype=bool)
                kept = [w for w, g in zip(words, gone.tolist()) if not g] if gone.any() else words
                sizes.append(len(words))
                removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    out = _with_spans(docs).mapInArrow(kernel, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(-(2**63))))


def kept_text(docs: DataFrame) -> DataFrame:
    """doc_id and the kept words, joined by one space."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column("text"), batch.column("spans")):
                words = split_words(text.as_py())
                gone = _covered(spans.as_py(), len(words))
                texts.append(b" ".join(w for w, g in zip(words, gone.tolist()) if not g).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    out = _with_spans(docs).mapInArrow(kernel, "doc_id long, text string")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(-(2**63))))


#: DuckDB SQL for dedup_substrings() over documents.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS n FROM g) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS q FROM r),
k AS (SELECT d.doc_id, t.i, w[t.i] AS x FROM d, unnest(range(1, len(w) + 1)) AS t(i)),
z AS (SELECT k.doc_id, sha256(string_agg(x, ' ' ORDER BY i)) AS h, count(*) AS n FROM k LEFT JOIN c ON k.doc_id = c.doc_id AND k.i = c.q WHERE c.q IS NULL GROUP BY k.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(h, sha256('')) AS kept_sha256
FROM d LEFT JOIN z USING (doc_id)
"""
