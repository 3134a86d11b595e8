"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes.

Fitting, on a bounded sample: iterative quantisation learns rotations of the centred vectors whose signs are the code's
bits, one rotation for as many bits as the vectors have dimensions; and the sample's pairs tell, for each distance, the
Hamming radius within which ``HOLD`` of the pairs that near lie.

Searching: queries are dealt into chunks of bounded size; each chunk goes to every task, and the rows stream past it, so that
rows are never shuffled or copied. A task takes its rows in blocks, and a block has one index per code substring. A query
probes, in every index, all substrings within the pigeonhole radius; every code within the Hamming radius r has a substring
within r // m of the query's, so all of them are found. Those within r are ranked by the exact distance of the original
vectors in double precision. The radius starts at that of the sample's near pairs and then widens to what the k-th best
distance so far asks for, over all blocks of the task; without k neighbours it goes on to the whole code length. Each task
gives k rows a query, which one shuffle by query merges.

How much is probed depends on the vectors: where neighbours' codes differ in few bits, a few buckets; where vectors have no
structure (neighbours at two thirds of the typical distance), neighbours' codes differ in a third of their bits, and no
probing within that radius leaves out much. ``probed`` of an index counts it.

Defined cases: vectors that are null, zero, or with null or non-finite components take no part; vectors of different
dimensions are searched apart, each among its own, as there's no distance between them; ties go to the smaller id; repeated
vectors are different candidates; fewer candidates than k give fewer rows; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

FIT_ROWS, HOLD = 3000, 0.97
LEAST_BITS, SUB = 128, 16
BLOCK_ROWS, CHUNK_BYTES = 25_000, 16 << 20


class Codes:
    """Learned rotations, and the radius table."""

    def __init__(self, sample: np.ndarray, bits: int = LEAST_BITS, rounds: int = 30, seed: int = 3):
        rng, dim = np.random.default_rng(seed), sample.shape[1]
        self.mean = sample.mean(axis=0)
        x = sample - self.mean
        self.rotations = []
        for _ in range(-(-bits // dim)):
            r = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
            for _ in range(rounds):  # iterative quantisation: the rotation that is nearest to its own signs
                u, _, v = np.linalg.svd(np.where(x @ r >= 0, 1.0, -1.0).T @ x)
                r = (u @ v).T
            self.rotations.append(r)
        self.bits = len(self.rotations) * dim
        self.bits += -self.bits % SUB
        self._radii(sample[: min(len(sample), 2000)])

    def code(self, x: np.ndarray) -> np.ndarray:
        """Codes as 16-bit numbers, one substring each."""
        signs = np.concatenate([(x - self.mean) @ r >= 0 for r in self.rotations], axis=1)
        signs = np.pad(signs, ((0, 0), (0, self.bits - signs.shape[1])))
        return np.packbits(signs, axis=1).view(np.uint16)

    def _radii(self, x: np.ndarray) -> None:
        codes, far, near = self.code(x), [], []
        for i in range(0, len(x), 250):
            d = _distances(x[i : i + 250], x)
            h = np.bitwise_count(codes[i : i + 250, None, :] ^ codes[None, :, :]).sum(axis=2, dtype=np.int64)
            apart = np.arange(i, i + len(d))[:, None] != np.arange(len(x))[None, :]
            far.append(d[apart])
            near.append(h[apart])
        d, h = (np.concatenate(v) if v else np.zeros(0) for v in (far, near))
        if len(d) < 50:
            self.edges, self.radius = np.array([np.inf]), np.array([self.bits])
            return
        order = np.argsort(d, kind="stable")
        d, h = d[order], h[order]
        cuts = np.unique(np.append(np.geomspace(100, len(d), 2 + int(np.log(len(d) / 100 + 1) / np.log(1.25))), len(d)).astype(int).clip(1, len(d)))
        self.edges, radius, at = [], [], 0
        for c in cuts:
            self.edges.append(d[c - 1])
            radius.append(int(np.ceil(np.quantile(h[at:c], HOLD))) + 1)
            at = c
        self.edges = np.array(self.edges)
        self.radius = np.maximum.accumulate(np.array(radius))
        self.edges[-1] = np.inf

    def radius_for(self, distance: float) -> int:
        return int(self.radius[min(np.searchsorted(self.edges, distance), len(self.radius) - 1)])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0))


class Index:
    """One index per substring over a block of rows, in compressed form."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, codes: Codes):
        self.ids, self.x, self.codes = ids, x, codes
        self.words = codes.code(x)
        self.m, self.probed, self.last = self.words.shape[1], 0, 0
        self.rows = [np.argsort(self.words[:, j], kind="stable") for j in range(self.m)]
        self.ends = [np.concatenate([[0], np.cumsum(np.bincount(self.words[:, j], minlength=1 << SUB))]) for j in range(self.m)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every row whose code is within ``radius``, by pigeonhole: of m substrings, one is within radius // m, and if
        only radius % m + 1 of them are probed that far, the others need one less."""
        base, rest = divmod(min(radius, self.m * SUB), self.m)
        seen = np.zeros(len(self.ids), dtype=bool)
        for j in range(self.m):
            reach = min(SUB, base if j <= rest else base - 1)
            if reach < 0:
                continue
            keys = ball(reach) ^ code[j]
            at, n = self.ends[j][keys], self.ends[j][keys.astype(np.int64) + 1] - self.ends[j][keys]
            at, n = at[n > 0], n[n > 0]
            seen[self.rows[j][np.arange(n.sum()) + np.repeat(at - np.cumsum(n) + n, n)]] = True
        found = np.flatnonzero(seen)
        self.last = len(found)
        return found[np.bitwise_count(self.words[found] ^ code).sum(axis=1, dtype=np.int64) <= radius]

    def nearest(self, query: np.ndarray, own: int, k: int, known: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k nearest found, without the row ``own``, together with those ``known`` from other blocks."""
        code = self.codes.code(query[None])[0]
        radius = int(self.codes.radius[0])
        while True:
            found = self.within(code, radius)
            found = found[self.ids[found] != own]
            diff = self.x[found] - query
            ids, d = self.ids[found], np.sqrt((diff * diff).sum(axis=1))
            if known:
                ids, d = np.concatenate([known[0], ids]), np.concatenate([known[1], d])
            if len(d) > k:  # all that tie with the k-th stay, then the smaller ids
                best = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
                best = best[np.lexsort((ids[best], d[best]))][:k]
            else:
                best = np.lexsort((ids, d))
            asked = self.codes.radius_for(d[best[-1]]) if len(best) >= k else min(self.codes.bits, radius + self.codes.bits // 16)
            if asked <= radius:
                self.probed += self.last
                return ids[best], d[best]
            radius = asked


_BALLS: dict[int, np.ndarray] = {}


def ball(reach: int) -> np.ndarray:
    """The substrings with at most ``reach`` bits set."""
    if reach not in _BALLS:
        _BALLS[reach] = np.flatnonzero(np.bitwise_count(np.arange(1 << SUB)) <= reach).astype(np.uint16)
    return _BALLS[reach]


def usable(vectors: DataFrame) -> DataFrame:
    v = F.col("v")
    fine = F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))) & F.exists(v, lambda c: c != 0)
    return vectors.where(fine)


def search(vectors: DataFrame, is_query, k: int = 10, block_rows: int = BLOCK_ROWS, chunk_bytes: int = CHUNK_BYTES, fit_rows: int = FIT_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest. ``vectors`` has vec_id and embedding; ``is_query`` is a condition on id."""
    base = usable(vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")))
    out = vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    for dim in sorted(r["dim"] for r in base.select(F.size("v").alias("dim")).distinct().collect()):  # one row a dimension
        out = out.union(_of_dimension(base.where(F.size("v") == dim), dim, is_query, k, block_rows, chunk_bytes, fit_rows))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _of_dimension(base: DataFrame, dim: int, is_query, k: int, block_rows: int, chunk_bytes: int, fit_rows: int) -> DataFrame:
    """The k nearest that each task finds for each query: query_id, vec_id, score. ``base``: id and v, all of one dimension."""
    spark = base.sparkSession
    chosen = base.orderBy(F.xxhash64("id"), "id").limit(fit_rows).select("v").toArrow()
    codes = Codes(_matrix(chosen.column("v").combine_chunks(), dim))
    asked = written(base.where(is_query), "queries")
    chunks = max(1, -(-asked.count() * (8 * dim + 8) // chunk_bytes))
    found = spark.createDataFrame([], "query_id long, vec_id long, score double")
    for chunk in range(chunks):
        part = asked.where(F.pmod(F.xxhash64("id"), F.lit(chunks)) == chunk).toArrow()
        if not part.num_rows:
            continue
        held = spark.sparkContext.broadcast((part.column("id").to_numpy(), _matrix(part.column("v").combine_chunks(), dim)))

        def kernel(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            owns, queries = held.value
            best: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(owns)
            for ids, x in _blocks(batches, dim, block_rows):
                index = Index(ids, x, codes)
                for i, own in enumerate(owns):
                    best[i] = index.nearest(queries[i], own, k, best[i])
            some = [(np.full(len(b[0]), own), *b) for own, b in zip(owns, best) if b is not None]
            if some:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([s[i] for s in some])) for i in range(3)], names=["query_id", "vec_id", "score"])

        found = found.union(base.mapInArrow(kernel, "query_id long, vec_id long, score double"))
    return found


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _blocks(batches: Iterator[pa.RecordBatch], dim: int, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of the batches, about ``rows`` rows at a time."""
    held, n = [], 0
    for batch in batches:
        held.append((batch.column("id").to_numpy(), _matrix(batch.column("v"), dim)))
        n += batch.num_rows
        if n >= rows:
            yield np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            held, n = [], 0
    if n:
        yield np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])


def brute(ids: np.ndarray, x: np.ndarray, query_ids: Iterator[int], k: int = 10) -> dict[int, list[int]]:
    """The exact nearest, for measuring recall on small tables."""
    at = {int(i): r for r, i in enumerate(ids)}
    out = {}
    for q in query_ids:
        d = np.sqrt(((x - x[at[int(q)]]) ** 2).sum(axis=1))
        order = np.lexsort((ids, d))
        out[int(q)] = [int(ids[r]) for r in order if ids[r] != q][:k]
    return out
