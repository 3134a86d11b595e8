"""Near-duplicate documents by DartMinHash over weighted five-word shingles.

A document is a weighted set: its shingles of five words (all its words if it has fewer), each weighing as often as it
occurs. Darts are thrown, by hashes alone, into every element's region: weight on one axis, time on the other. A dart
counts if it lies below the element's weight; it belongs to one of ``K`` coordinates, which keeps its earliest dart. Only
darts up to a time that leaves few coordinates empty are made, so their number follows K and not the document's length;
documents with an empty coordinate get twice the time. Two sets agree in a coordinate with the probability of their
weighted Jaccard similarity.

Equal texts (by MD5) are one text first. ``BANDS`` bands of ``ROWS`` coordinates make the buckets. Every text of a bucket is
compared with the bucket's first and last, exactly; components of what passes become classes. Buckets that then hold more than
one class are compared in full between those classes: members outside the bucket's largest class with all members, in
blocks of a bounded number of bytes; only links leave a block. What is compared are sets of 32-bit hashes, one for
each occurrence of a shingle, so that texts are read once and the similarity of sets is the weighted one.
Links at a similarity of 0.8 or more; a pair at 0.8 shares no bucket with probability 2 in 10,000.

Defined cases: rows are told apart by their place, not by doc_id, so no row is lost to a null or repeated doc_id. Null texts
are each a class of their own; texts without a word are in a class only with equal texts. A class is named by its smallest
doc_id; if that names another class already, or all its doc_ids are null, by a number below -2**62. The first row of a class
is that of its smallest doc_id (nulls last), and any one of repeated rows. An empty table gives an empty result; long texts are
taken whole; other columns are ignored, and ``keep_first`` keeps them all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components

K, ROWS, BANDS = 64, 4, 16
SHINGLE, LEAST = 5, 0.8
BLOCK_BYTES = 1 << 20
PART_CHARS, PART_DOCS = 500_000, 2000
WORD = re.compile(r"\w+")
_U = np.uint64
_FACTOR = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit value of each 64-bit value."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Words(dict):
    """Hashes of words; forgets them all when there are too many."""

    MOST = 100_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(texts: list[str | None], words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, element, weight) of all texts; elements are 44-bit hashes, sorted within their document."""
    lists = [WORD.findall(t.lower()) if t else [] for t in texts]
    size = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    flat = np.fromiter((words[w] for ws in lists for w in ws), dtype=np.uint64, count=int(size.sum()))
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(lists)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(flat))  # words from here to the document's end
    h = np.zeros(len(flat), dtype=np.uint64)
    padded = np.concatenate([flat, np.zeros(SHINGLE, dtype=np.uint64)])
    for j in range(SHINGLE):
        h += np.where(left > j, padded[j : j + len(flat)] * _FACTOR[j], _U(j + 1))
    first = np.zeros(len(flat), dtype=bool)
    first[(np.cumsum(size) - size)[size > 0]] = True
    use = (left >= SHINGLE) | first & (left < SHINGLE)
    key = (doc[use].astype(np.uint64) << _U(44)) | (_mix(h[use]) >> _U(20))
    key, weight = np.unique(key, return_counts=True)
    return (key >> _U(44)).astype(np.int64), key & _U((1 << 44) - 1), weight


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int) -> np.ndarray:
    """(n_docs, K) earliest times; documents without elements keep infinity."""
    sig = np.full((n_docs, K), np.inf)
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    limit = np.where(total > 0, K * (np.log(K) + 3) / np.maximum(total, 1e-12), 0.0)
    todo = total > 0
    while todo.any():
        part = todo[doc]
        _throw(doc[part], element[part], weight[part].astype(float), limit, sig.reshape(-1))
        todo &= np.isinf(sig).any(axis=1)
        limit[todo] *= 2
    return sig


def _throw(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, limit: np.ndarray, sig: np.ndarray) -> None:
    """Darts of all regions up to each document's time limit. Strips of weight: [0, 1), [1, 2), [2, 4), [4, 8) and so on."""
    low, width, strip = 0.0, 1.0, 0
    while len(element):
        base = _mix(element * _FACTOR[0] + _U((strip + 1) * 0xD6E8FEB86659FD93 % (1 << 64)))
        d, w, b, time, i = doc, weight, base, np.zeros(len(base)), 0
        while len(b):
            i += 1
            h = _mix(b + _U(i * 0xBF58476D1CE4E5B9 % (1 << 64)))
            time = time - np.log(((h >> _U(11)).astype(float) + 1) * 2.0**-53) / width
            on = time <= limit[d]
            d, w, b, time, h = d[on], w[on], b[on], time[on], h[on]
            g = _mix(h ^ _FACTOR[2])
            hit = low + width * ((g >> _U(40)).astype(float) * 2.0**-24) < w
            np.minimum.at(sig, d[hit] * K + (g[hit] & _U(K - 1)).astype(np.int64), time[hit])
        low, width, strip = (1.0, 1.0, 1) if strip == 0 else (low + width, low + width, strip + 1)
        on = weight > low
        doc, element, weight = doc[on], element[on], weight[on]


def bands_of(sig: np.ndarray) -> np.ndarray:
    """(documents, BANDS) bucket keys, the band's number mixed in."""
    bits = np.ascontiguousarray(sig).view(np.uint64).reshape(len(sig), BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _FACTOR[4], bits.shape[:2]).copy()
    for r in range(ROWS):
        out = _mix(out ^ bits[:, :, r]) * _FACTOR[1]
    return out.view(np.int64)


def sets_of(texts: list[str | None], words: Words) -> list[np.ndarray]:
    """Each text's sorted set of 32-bit hashes of (shingle, occurrence)."""
    doc, element, weight = shingles(texts, words)
    heavy = np.flatnonzero(weight > 1)
    again = np.concatenate([np.arange(1, n) for n in weight[heavy]]) if len(heavy) else np.zeros(0, np.int64)
    doc = np.concatenate([doc, np.repeat(doc[heavy], weight[heavy] - 1)])
    element = np.concatenate([element, _mix(np.repeat(element[heavy], weight[heavy] - 1) + again.astype(np.uint64) * _FACTOR[1])])
    key = np.unique((doc.astype(np.uint64) << _U(32)) | (_mix(element * _FACTOR[0]) >> _U(32)))
    cuts = np.searchsorted(key, np.arange(1, len(texts)).astype(np.uint64) << _U(32))
    return np.split((key & _U(0xFFFFFFFF)).astype(np.uint32), cuts)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; 0 if one is empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if both else 0.0


def _parts(column: pa.Array) -> Iterator[list[str | None]]:
    """The texts, some at a time: at least one, and a bounded number of documents and characters."""
    part, size = [], 0
    for text in column:
        part.append(text.as_py())
        size += len(part[-1] or "")
        if size >= PART_CHARS or len(part) >= PART_DOCS:
            yield part
            part, size = [], 0
    if part:
        yield part


def copy_of(text: Column) -> Column:
    """What is the same for equal texts; null for null."""
    return F.unhex(F.md5(text.cast("binary")))


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, _row, copy and bands of every row; bands is null where there are no words, copy is the row's own for null texts."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            bands: list[np.ndarray | None] = []
            for part in _parts(batch.column("text")):
                own = {t: i for i, t in enumerate(dict.fromkeys(part))}  # repeated texts are signed once
                doc, element, weight = shingles(list(own), words)
                keys = bands_of(signatures(doc, element, weight, len(own)))
                some = np.bincount(doc, minlength=len(own)) > 0
                bands += [keys[own[t]] if some[own[t]] else None for t in part]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "_row", "copy")), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "_row", "copy", "bands"])

    own = F.concat(F.lit("row ").cast("binary"), F.col("_row").cast("string").cast("binary"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("_row"))
    return rows.select("doc_id", "_row", F.coalesce(copy_of(F.col("text")), own).alias("copy"), "text").mapInArrow(kernel, "doc_id long, _row long, copy binary, bands array<long>")


def _sets(texts: DataFrame) -> DataFrame:
    """node and set (32-bit hashes as bytes) of node, text."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            at = 0
            for part in _parts(batch.column("text")):
                sets = [s.tobytes() for s in sets_of(part, words)]
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(at, len(part)), pa.array(sets, pa.binary())], names=["node", "set"])
                at += len(part)

    return texts.select("node", "text").mapInArrow(kernel, "node long, set binary")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough. Many pairs may share their b; such keys are split by Spark."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b").select("a", "b", "sa", "sb")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(*(map(lambda v: np.frombuffer(v.as_buffer(), dtype=np.uint32), batch.column(c)) for c in ("sa", "sb")))
            keep = [min(len(x), len(y)) >= LEAST * max(len(x), len(y)) and similarity(x, y) >= LEAST for x, y in pairs]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(kernel, "a long, b long")


def links_between(sets: list[np.ndarray], roots: np.ndarray, few: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places that link different classes, at most one for each merging of two; the first place is of ``few``.

    One set is compared with all others at once.
    """
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    some = np.flatnonzero(sizes)
    kinds, code = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    _, label = np.unique(roots, return_inverse=True)
    own, xs, ys = np.zeros(len(kinds), dtype=bool), [], []
    for x in np.flatnonzero(few & (sizes > 0)):
        others = label[some] != label[x]
        if not others.any():
            continue
        part = code[ends[x] - sizes[x] : ends[x]]
        own[part] = True
        both = np.add.reduceat(own[code], (ends - sizes)[some], dtype=np.int64)
        own[part] = False
        found = some[others & (both >= LEAST * (sizes[some] + sizes[x] - both))]
        for other in np.unique(label[found]):
            xs.append(x)
            ys.append(found[label[found] == other][0])
            label[label == other] = label[x]
    return np.array(xs, dtype=np.int64), np.array(ys, dtype=np.int64)


def _between(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between different classes of a bucket. ``members``: key, node, root.

    Every pair of classes has a member outside of the bucket's largest class, so those (the few) meet all members, in blocks
    of about ``BLOCK_BYTES``: a member of the largest class goes to each block of the few, which is mostly one.
    """
    sized = members.join(sets.select("node", F.octet_length("set").cast("long").alias("size")), "node")
    of_class = sized.groupBy("key", "root").agg(F.sum("size").alias("size"))
    of_key = of_class.groupBy("key").agg(F.sum("size").alias("all"), F.max(F.struct("size", "root")).alias("most"))
    blocks = [F.greatest(F.lit(1), F.ceil(b / BLOCK_BYTES)).cast("int") for b in (F.col("all") - F.col("most.size"), F.col("all"))]
    of_key = written(of_key.select("key", F.col("most.root").alias("main"), blocks[0].alias("rows"), blocks[1].alias("cols")), "buckets-to-compare")
    dealt = members.join(of_key, "key").withColumn("few", F.col("root") != F.col("main"))
    dealt = dealt.select("key", "node", "root", "few", "rows", "cols", F.pmod(F.xxhash64("node"), F.col("rows")).cast("int").alias("row"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("cols")).cast("int").alias("col"))
    down = dealt.select("key", "node", "root", F.lit(False).alias("few"), F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), "col")
    across = dealt.where("few").select("key", "node", "root", F.lit(True).alias("few"), "row", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("col"))

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        few, nodes = pdf["few"].to_numpy(dtype=bool), pdf["node"].to_numpy()
        if not few.any():
            return pd.DataFrame({"a": nodes[:0], "b": nodes[:0]})
        x, y = links_between([np.frombuffer(s, dtype=np.uint32) for s in pdf["set"]], pdf["root"].to_numpy(), few)
        return pd.DataFrame({"a": nodes[x], "b": nodes[y]})

    return down.union(across).join(sets, "node").groupBy("key", "row", "col").applyInPandas(kernel, "a long, b long")


def _roots(copies: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, root) of the texts of ``copies`` (node, copy, bands) that are linked to another."""
    keys = copies.where(F.col("bands").isNotNull()).select(F.explode("bands").alias("key"), "node")
    buckets = keys.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most")
    members = written(keys.join(buckets, "key"), "buckets")
    wanted = copies.select("node", "copy").join(members.select("node").distinct(), "node", "left_semi")
    texts = docs.where(F.col("text").isNotNull()).select(copy_of(F.col("text")).alias("copy"), "text").groupBy("copy").agg(F.first("text").alias("text"))
    sets = written(_sets(texts.join(wanted, "copy")), "sets")
    ends = members.select("node", F.explode(F.array("least", "most")).alias("end")).where("node <> end")
    pairs = ends.select(F.greatest("node", "end").alias("a"), F.least("node", "end").alias("b")).distinct()
    links = written(_verified(pairs, sets), "links")
    roots = components(links)
    rooted = members.select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    more = written(_between(written(rooted.join(mixed, "key"), "mixed-buckets"), sets), "more-links")
    return roots if more.isEmpty() else components(links.union(more))


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every row (doc_id, _row, copy) and every class's texts: copy, class_id, and the class's first row as doc_id, _row, copy, n."""
    signed = written(_signed(docs), "signatures")
    rows = signed.groupBy("copy", "doc_id").agg(F.min("_row").alias("_row"), F.count("*").alias("n"), F.first("bands").alias("bands"))
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row", "copy", "n")
    copies = rows.groupBy("copy").agg(F.min(first).alias("lo"), F.first("bands").alias("bands"))
    copies = written(copies.withColumn("node", F.monotonically_increasing_id()), "distinct-texts")
    roots = _roots(copies, docs)
    of_text = written(copies.select("copy", "lo", "node").join(roots, "node", "left").select("copy", "lo", F.coalesce("root", "node").alias("root")), "roots")
    best = of_text.groupBy("root").agg(F.min("lo").alias("lo"))
    owner = best.where("lo.doc_id IS NOT NULL").groupBy(F.col("lo.doc_id").alias("name")).agg(F.min("root").alias("root"), F.lit(True).alias("owns"))
    named = best.join(owner, "root", "left").select("root", "lo", F.when(F.col("owns"), F.col("name")).otherwise(F.col("root") - F.lit(2**63 - 1)).alias("class_id"))
    return signed.select("doc_id", "_row", "copy"), of_text.select("copy", "root").join(named, "root").select("copy", "class_id", "lo")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document row: doc_id, class_id, and whether it's the one that stands for its class."""
    rows, classes = _classes(docs)
    return rows.join(classes, "copy").select("doc_id", "class_id", (F.col("_row") == F.col("lo._row")).alias("is_first"))


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class, all columns kept."""
    _, classes = _classes(docs)
    chosen = written(classes.select("lo.copy", "lo.doc_id", "lo.n").distinct(), "first-rows")
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), copy_of(F.col("text")).alias("copy"))

    def held(of: DataFrame) -> DataFrame:
        right = of.select(F.col("copy").alias("c"), F.col("doc_id").alias("d"))
        return rows.where(F.col("copy").isNotNull()).join(right, (F.col("copy") == F.col("c")) & F.col("doc_id").eqNullSafe(F.col("d")), "left_semi")

    out = held(chosen.where("n = 1")).select("doc.*").union(docs.where(F.col("text").isNull()))
    repeated = chosen.where("n > 1")
    if not repeated.isEmpty():  # rows that agree in doc_id and text: any one of them
        out = out.union(held(repeated).groupBy("copy").agg(F.first("doc").alias("doc")).select("doc.*"))
    return out
