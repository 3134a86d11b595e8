"""Mixing sources to target weights by hierarchical budgets.

The tree is domain, language, source. A token budget starts at the root; every node splits its budget among its children
by weight. A child can't take more than its tokens times the epochs allowed; what it leaves goes to its siblings by weight,
and only what a whole family can't take goes to the family's own siblings. Every leaf then takes the first tokens of its
seeded epochs: whole epochs, and of the last one a prefix in that epoch's order (a hash of seed, epoch and id).

The prefix needs no sort of a leaf: tokens are summed per (leaf, slice of the hash), running sums over slices find the
slice in which the budget ends, and only that slice's documents are put in order. The driver sees one row per leaf.

Defined cases: null domain, language or source is a leaf named by the empty string; null and empty texts have no tokens
and come along in every epoch that is reached before the budget ends; ties in the order go by id, then tokens; repeated
rows are separate documents; an empty table gives an empty result; in ``mix`` other columns are ignored, ``mixed`` keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = ("domain", "lang", "source")
# Targets of the registered query: weights of paths; children without one weigh 1.
WEIGHTS = {("d0",): 4.0, ("d1",): 3.0, ("d2",): 2.0, ("d3",): 1.0, **{(d, lang): w for d in ("d0", "d1", "d2", "d3") for lang, w in (("en", 4.0), ("de", 2.0), ("fr", 2.0), ("es", 2.0))}}
DOMAINS, EPOCHS, SHARE, SEED = 4, 2, 0.8, 23
#: Tables of a row a leaf are broadcast up to this size, and joined by shuffle beyond.
BROADCAST_BYTES = 64 << 20


def domain_of(source: Column) -> Column:
    """The corpus names no domains: sources are dealt to them by their number."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"(\d{1,9})$", 1)
    return F.concat(F.lit("d"), (F.when(number != "", number.cast("int")).otherwise(F.lit(0)) % DOMAINS).cast("string"))


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def split(budget: int, children: list[tuple[str, float, int]]) -> dict[str, int]:
    """Whole shares of ``budget`` for (name, weight, most): by weight, shortages to the others, fractions to the largest rests."""
    out = {name: 0 for name, _, _ in children}
    budget = min(budget, sum(most for _, _, most in children))
    open_ = sorted((c for c in children if c[2] > 0 and c[1] > 0), key=lambda c: c[0])
    if not open_ and budget:  # only children without weight can take what is left
        open_ = sorted(((n, 1.0, m) for n, _, m in children if m > 0), key=lambda c: c[0])
    while open_ and budget:
        whole = sum(w for _, w, _ in open_)
        full = [(n, w, m) for n, w, m in open_ if budget * w / whole >= m]
        if not full:
            exact = {n: budget * w / whole for n, w, _ in open_}
            for n in exact:
                out[n] = int(exact[n])
            for n in sorted(exact, key=lambda n: (int(exact[n]) - exact[n], n))[: budget - sum(int(x) for x in exact.values())]:
                out[n] += 1
            return out
        for n, _, m in full:
            out[n] = m
            budget -= m
        filled = {n for n, _, _ in full}
        open_ = [c for c in open_ if c[0] not in filled]
        if not open_ and budget:
            rest = [(n, 1.0, m) for n, _, m in children if m > 0 and not out[n]]
            open_ = sorted(rest, key=lambda c: c[0])
    return out


def budgets(leaves: dict[tuple[str, ...], int], weights: dict[tuple[str, ...], float], total: int, epochs: int) -> dict[tuple[str, ...], int]:
    """Token budget of every leaf. ``leaves``: tokens by path."""
    out: dict[tuple[str, ...], int] = {}
    most: dict[tuple[str, ...], dict[str, int]] = {}
    for leaf, n in leaves.items():
        for i, name in enumerate(leaf):
            family = most.setdefault(leaf[:i], {})
            family[name] = family.get(name, 0) + n * epochs

    def down(path: tuple[str, ...], budget: int) -> None:
        if path in leaves:
            out[path] = budget
            return
        for name, share in split(budget, [(n, weights.get((*path, n), 1.0), m) for n, m in most[path].items()]).items():
            down((*path, name), share)

    if leaves:
        down((), min(total, epochs * sum(leaves.values())))
    return out


def selected(docs: DataFrame, weights: dict = WEIGHTS, total: int | None = None, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED, slice_rows: int = 2000) -> DataFrame:
    """``docs`` (_id, _domain, lang, source, _tokens and others) with _epoch and _taken, a row for every epoch that takes some of it."""
    spark = docs.sparkSession
    names = [f"_leaf{i}" for i in range(len(LEVELS))]
    leaf = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in zip(("_domain", "lang", "source"), names)]
    keyed = docs.select("*", *leaf)
    stats = keyed.groupBy(*names).agg(F.sum("_tokens").alias("t"), F.count("*").alias("n")).collect()
    tokens = {tuple(r[n] for n in names): r["t"] for r in stats}
    budget = budgets(tokens, weights, int(share * sum(tokens.values())) if total is None else total, epochs)
    bits = min(30, max(0, max((r["n"] for r in stats), default=1) // slice_rows).bit_length())
    plan = [(*p, b // t if t else epochs, b % t if t else 0) for p, b in budget.items() for t in [tokens[p]]]
    table = spark.createDataFrame(plan or [("", "", "", 0, 0)], ", ".join(f"{n} string" for n in names) + ", _whole long, _rest long")
    size = sum(len(name.encode()) for p in budget for name in p) + 64 * len(budget)
    each_leaf = F.broadcast if size <= BROADCAST_BYTES else lambda t: t.hint("merge")  # whose skewed partitions are split
    rows = keyed.join(each_leaf(table), names)
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("_whole"), F.col("_id")), 1)
    rows = rows.withColumn("_h", h).withColumn("_slice", F.shiftright("_h", 63 - bits).cast("int"))
    at = [*names, "_slice"]
    before = F.coalesce(F.sum("_t").over(Window.partitionBy(*names).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slices = rows.where("_rest > 0").groupBy(*at, "_rest").agg(F.sum("_tokens").alias("_t")).withColumn("_before", before)
    ends = slices.where("_before < _rest").groupBy(*names).agg(F.max(F.struct("_slice", "_before")).alias("_end"))
    ends = ends.select(*names, F.col("_end._slice").alias("_cut"), F.col("_end._before").alias("_before"))
    full = rows.where("_whole > 0").withColumn("_epoch", F.explode(F.expr("sequence(0, _whole - 1)"))).withColumn("_taken", F.col("_tokens"))
    cut = rows.where("_rest > 0").join(each_leaf(ends), names)  # one row a leaf, like the budgets
    inside = cut.where("_slice < _cut").withColumn("_epoch", F.col("_whole")).withColumn("_taken", F.col("_tokens"))
    start = F.col("_before") + F.coalesce(F.sum("_tokens").over(Window.partitionBy(*at).orderBy("_h", "_id", "_tokens").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = cut.where("_slice = _cut").withColumn("_start", start).where("_start < _rest").withColumn("_epoch", F.col("_whole")).withColumn("_taken", F.least("_tokens", F.col("_rest") - F.col("_start")))
    keep = [*docs.columns, "_epoch", "_taken"]
    return full.select(*keep).unionByName(inside.select(*keep)).unionByName(edge.select(*keep))


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, domain, lang, source, epoch, n_tokens, n_taken of all that is taken; n_taken is less only where a leaf's budget ends."""
    narrow = docs.select(F.col("doc_id").alias("_id"), "lang", "source", domain_of(F.col("source")).alias("_domain"), tokens_of(F.col("text")).alias("_tokens"))
    out = selected(narrow, **options)
    return out.select(F.col("_id").alias("doc_id"), F.col("_domain").alias("domain"), "lang", "source", F.col("_epoch").alias("epoch"), F.col("_tokens").alias("n_tokens"), F.col("_taken").alias("n_taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as mixed: a row for each epoch that takes a document, whole; all columns stay."""
    wide = docs.select(F.struct("*").alias("_doc"), "lang", "source", F.col("doc_id").alias("_id"), domain_of(F.col("source")).alias("_domain"), tokens_of(F.col("text")).alias("_tokens"))
    return selected(wide, **options).select("_doc.*")
