"""Consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

The ring has 2**14 cells; every shard owns the cells up to each of its virtual nodes. A key's cell comes from its hash.
Every shard has a bound: the row count divided by the shards, so that bounds differ by one at most and sum to the row
count. A shard takes the keys of its own cells in ring order up to its bound; the rest continue clockwise to the next
virtual node of a shard that isn't full, round by round, until all have a place. Keys move only if they overflow.

What the driver handles is one count per cell, whatever the size of the input. Ranks inside a cell come from windows
over (cell, sub-cell), and there are enough sub-cells for ``rows_per_group`` rows in each.

Defined cases: a null key takes its place from the tie columns, so null keys spread over the ring; null texts have size 1 and no checksum; repeated rows are ranked in any order
and get different slots; an empty table gives an empty result; other columns are kept as they are, but columns named
``shard`` or ``slot`` are replaced.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL_BITS = 14
CELLS = 1 << CELL_BITS


def ring(n_shards: int, vnodes: int, seed: int) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, by cell. A node whose cell is taken goes to the next free one."""
    if not 1 <= n_shards * vnodes <= CELLS:
        raise ValueError(f"the ring has room for {CELLS} virtual nodes")
    at: dict[int, int] = {}
    for shard in range(n_shards):
        for v in range(vnodes):
            cell = int(hashlib.sha256(f"{seed}/{shard}/{v}".encode()).hexdigest()[:12], 16) % CELLS
            while cell in at:
                cell = (cell + 1) % CELLS
            at[cell] = shard
    return sorted(at.items())


def place(counts: dict[int, int], n_shards: int, vnodes: int, seed: int) -> list[tuple[int, int, int, int, int]]:
    """Segments (cell, first rank, end rank, shard, slot of the first rank) for the rows counted in each cell."""
    nodes = ring(n_shards, vnodes, seed)
    cells = [c for c, _ in nodes]
    total = sum(counts.values())
    room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    used = [0] * n_shards
    waiting = [(cell, 0, n, bisect_left(cells, cell) % len(nodes)) for cell, n in sorted(counts.items()) if n]
    out = []
    while waiting:
        after, following = {}, None  # the next node clockwise of a shard that isn't full
        for i in list(range(len(nodes) - 1, -1, -1)) * 2:
            if room[nodes[i][1]]:
                following = i
            after[i] = following
        overflow = []
        for cell, lo, n, node in waiting:
            node = after[node]
            shard = nodes[node][1]
            take = min(n, room[shard])
            if take:
                out.append((cell, lo, lo + take, shard, used[shard]))
                room[shard] -= take
                used[shard] += take
            if n > take:
                overflow.append((cell, lo + take, n - take, node))
        waiting = overflow
    return out


def assign_shards(docs: DataFrame, key: Column, tie: list[Column] | None = None, n_shards: int = 16, vnodes: int = 128, seed: int = 17, rows_per_group: int = 20_000) -> DataFrame:
    """``docs`` with ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 in each shard); counts differ by one at most."""
    spark = docs.sparkSession
    h = F.when(key.isNull(), F.xxhash64(F.lit(seed), *(tie or []))).otherwise(F.xxhash64(key))
    hashed = docs.select(F.struct("*").alias("_row"), h.alias("_h"), *[t.alias(f"_t{i}") for i, t in enumerate(tie or [])])
    hashed = hashed.withColumn("_cell", F.shiftrightunsigned("_h", 64 - CELL_BITS).cast("int"))
    cells = {r["_cell"]: r["n"] for r in docs.select(F.shiftrightunsigned(h, 64 - CELL_BITS).cast("int").alias("_cell")).groupBy("_cell").agg(F.count("*").alias("n")).collect()}
    # Sub-cells are the hash's next bits, so rows have the same order in a cell however many there are.
    bits = min(20, max(0, sum(cells.values()) // (CELLS * rows_per_group)).bit_length())
    sub_of = lambda x: F.shiftrightunsigned(x, 64 - CELL_BITS - bits).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    hashed = hashed.withColumn("_sub", sub_of(F.col("_h")))
    in_cell = F.row_number().over(Window.partitionBy("_cell", "_sub").orderBy("_h", *[f"_t{i}" for i in range(len(tie or []))])) - 1
    ranked = hashed.withColumn("_rank", in_cell.cast("long"))
    if bits:
        subs = docs.select(h.alias("_h")).select(F.shiftrightunsigned("_h", 64 - CELL_BITS).cast("int").alias("_cell"), sub_of(F.col("_h")).alias("_sub")).groupBy("_cell", "_sub").agg(F.count("*").alias("_n"))
        before = F.coalesce(F.sum("_n").over(Window.partitionBy("_cell").orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        subs = subs.select("_cell", "_sub", before.alias("_before"))
        ranked = ranked.join(subs, ["_cell", "_sub"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    segments = place(cells, n_shards, vnodes, seed)  # at most one a cell and one a full shard and round
    lookup = spark.createDataFrame(segments or [(0, 0, 0, 0, 0)], "_cell int, _lo long, _hi long, shard int, _base long")
    placed = ranked.join(F.broadcast(lookup), "_cell").where("_rank >= _lo AND _rank < _hi")
    kept = [F.col("_row")[c].alias(c) for c in docs.columns if c not in ("shard", "slot")]
    return placed.select(*kept, "shard", (F.col("_base") + F.col("_rank") - F.col("_lo")).alias("slot"))


def shard_documents(docs: DataFrame, n_shards: int = 16, **options) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law (``rows``), shard, slot, grown_shard (null under this law)."""
    narrow = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
    placed = assign_shards(narrow, F.col("doc_id"), [F.col("doc_id"), F.col("text_crc32"), F.col("size")], n_shards, **options)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
