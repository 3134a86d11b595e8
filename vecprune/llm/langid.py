"""Language identification by a linear-chain conditional random field over words.

A word is a run of letters, lower-cased, cut into pieces of ``PIECE`` letters at most. Its features are prefixes and
suffixes of 1 to 3 letters, letter 2-grams and 3-grams, and its entry in a lexicon of each language's frequent words. The
field has a weight for each (feature, language) and each (language, next language). Forward-backward gives every word its
language probabilities; a document gets the language with the largest mean, which is its score.

Fitting: at most ``FIT_DOCS`` documents of each language, and ``FIT_CHARS`` characters of each, chosen by a hash of their
id. Segments of different documents are strung together, so that transitions are learned from text that switches.
Everything else covers whole texts: chains are cut in chunks for speed, and the messages between chunks are exact.

The language of a text can't be told if its best mean probability is hardly above an even share (``MARGIN``), or if too few
of its words' letter 3-grams occur in the fit sample: fewer than ``LEAST_KNOWN`` of the median share of one half's documents
in the other half.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is every text if there's nothing to learn
from; ties go to the language that sorts first; repeated documents each get their row; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE, BITS = 24, 17
WORD = re.compile(r"[^\W\d_]{1,%d}" % PIECE)
FIT_DOCS, FIT_CHARS, LEXICON = 500, 1500, 400
MARGIN, LEAST_KNOWN = 0.1, 0.6
PART_CHARS, PART_DOCS = 400_000, 1000
UND = "und"
_SALT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], dtype=np.uint64)


def words_of(text: str | None) -> list[str]:
    """Runs of letters. ``WORD`` lets number signs such as a half through; they part words too."""
    words = WORD.findall(text.lower()) if text else []
    if words and not "".join(words).isalpha():
        words = "".join(c if c.isalpha() else " " for c in " ".join(words)).split()
    return words


def _slot(values: np.ndarray, kind: int) -> np.ndarray:
    """Weight rows of packed letters; row 0 is for no feature."""
    h = (values + np.uint64(kind + 1)) * _SALT[kind]
    h ^= h >> np.uint64(29)
    h *= _SALT[(kind + 3) % 8]
    return ((h >> np.uint64(64 - BITS)) | np.uint64(1)).astype(np.int32)


def features(words: list[str]) -> np.ndarray:
    """Weight rows of each word's affixes and n-grams, 0 where there are fewer."""
    letters = np.array(words, dtype=f"U{PIECE}").view(np.uint32).reshape(len(words), PIECE).astype(np.uint64)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    shift, row = np.uint64(21), np.arange(len(words))
    two = (letters[:, :-1] << shift) | letters[:, 1:]
    three = (two[:, :-1] << shift) | letters[:, 2:]
    out = []
    for n, grams in ((1, letters), (2, two), (3, three)):
        out.append(np.where(size >= n, _slot(grams[:, 0], n), 0)[:, None])
        out.append(np.where(size >= n, _slot(grams[row, np.maximum(size - n, 0)], n + 3), 0)[:, None])
    widest = int(size.max(initial=1))
    for n, grams in ((2, two), (3, three)):
        k = max(1, widest - n + 1)
        out.append(np.where(np.arange(k)[None, :] + n <= size[:, None], _slot(grams[:, :k], 0 if n == 2 else 7), 0))
    return np.concatenate(out, axis=1)


def known_shares(words: list[str], seen: np.ndarray) -> np.ndarray:
    """Per word, the share of its 3-grams that were seen; of all its features if it's shorter."""
    slots = features(words)
    three = slots[:, -max(1, max(map(len, words)) - 2) :]
    n, n3 = (slots > 0).sum(axis=1), (three > 0).sum(axis=1)
    return np.where(n3 > 0, seen[three].sum(axis=1) / np.maximum(n3, 1), seen[slots].sum(axis=1) / np.maximum(n, 1))


def _seen(docs: list[list[str]]) -> np.ndarray:
    out, words = np.zeros(1 << BITS, dtype=bool), sorted(set(chain.from_iterable(docs)))
    for i in range(0, len(words), 20_000):
        out[features(words[i : i + 20_000])] = True
    out[0] = False
    return out


class Model:
    """Weights of the field. ``labels`` are sorted; ``lexicon`` maps a word to its row in ``of_word``."""

    def __init__(self, labels: list[str], lexicon: dict[str, int]):
        self.labels, self.lexicon = labels, lexicon
        n = len(labels)
        self.of_feature = np.zeros((1 << BITS, n), dtype=np.float32)
        self.of_word = np.zeros((len(lexicon) + 1, n), dtype=np.float32)
        self.step = np.zeros((n, n), dtype=np.float64)
        self.seen, self.least_known = np.zeros(1 << BITS, dtype=bool), 0.0

    def emissions(self, words: list[str]) -> np.ndarray:
        rows = np.fromiter((self.lexicon.get(w, 0) for w in words), dtype=np.int64, count=len(words))
        slots = features(words)
        out = self.of_word[rows].astype(np.float64)
        for j in range(slots.shape[1]):
            out += self.of_feature[slots[:, j]]
        return out


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(x.sum(axis=-1, keepdims=True), 1e-300)


def marginals(emissions: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over chains of one length: emissions (time, chain, label) -> label and pair probabilities."""
    e = np.exp(emissions - emissions.max(axis=2, keepdims=True))
    t = np.exp(step)
    a = np.empty_like(e)
    a[0] = _scaled(e[0])
    for i in range(1, len(e)):
        a[i] = _scaled((a[i - 1] @ t) * e[i])
    b = np.ones_like(e)
    pairs = np.zeros_like(step)
    for i in range(len(e) - 2, -1, -1):
        ahead = e[i + 1] * b[i + 1]
        joint = a[i][:, :, None] * t[None] * ahead[:, None, :]
        pairs += (joint / np.maximum(joint.sum(axis=(1, 2), keepdims=True), 1e-300)).sum(axis=0)
        b[i] = _scaled(ahead @ t.T)
    return _scaled(a * b), pairs


def fit(rows: list[tuple[str, str]], seed: int = 11, epochs: int = 4, length: int = 40, rate: float = 0.25) -> Model | None:
    """The field fitted to (text, language) rows by stochastic gradient, with step sizes by Adagrad."""
    rows = [(words_of(t), y) for t, y in sorted(rows)]
    rows = [(w, y) for w, y in rows if w]
    if not rows:
        return None
    labels = sorted({y for _, y in rows})
    rng, index = np.random.default_rng(seed), {y: i for i, y in enumerate(labels)}
    lexicon: dict[str, int] = {}
    for y in labels:
        counts: dict[str, int] = {}
        for w in chain.from_iterable(w for w, z in rows if z == y):
            counts[w] = counts.get(w, 0) + 1
        for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            lexicon.setdefault(w, len(lexicon) + 1)
    model = Model(labels, lexicon)
    halves = [[w for w, _ in rows[i::2]] for i in (0, 1)]
    seen = [_seen(h) for h in halves]
    model.seen = seen[0] | seen[1]
    if halves[1]:
        model.least_known = LEAST_KNOWN * float(np.median([known_shares(w, seen[1 - i]).mean() for i in (0, 1) for w in halves[i]]))
    pieces = []
    for w, y in rows:
        at = 0
        while at < len(w):
            n = int(rng.integers(4, length + 1))
            pieces.append((w[at : at + n], index[y]))
            at += n
    grams = [np.full_like(x, 1e-2) for x in (model.of_feature, model.of_word, model.step)]
    for _ in range(epochs):
        order = rng.permutation(len(pieces))
        words = list(chain.from_iterable(pieces[i][0] for i in order))
        truth = np.concatenate([np.full(len(pieces[i][0]), pieces[i][1]) for i in order])
        whole = len(words) // length * length
        if not whole:  # a tiny sample: once more of the same
            words, truth = words * length, np.tile(truth, length)
            whole = len(words) // length * length
        block = length * 200
        for at in range(0, whole, block):
            part, want = words[at : min(at + block, whole)], truth[at : min(at + block, whole)]
            n = len(part) // length
            unique, which = np.unique(np.array(part, dtype=object).astype(f"U{PIECE}"), return_inverse=True)
            unique = unique.tolist()
            e = model.emissions(unique)[which].reshape(n, length, -1).transpose(1, 0, 2)
            got, pairs = marginals(e, model.step)
            gold = np.eye(len(labels))[want.reshape(n, length).T]
            delta = (gold - got).transpose(1, 0, 2).reshape(n * length, -1)
            by_word = np.zeros((len(unique), len(labels)))
            np.add.at(by_word, which, delta)
            seen = np.zeros_like(model.step)
            np.add.at(seen, (want.reshape(n, length)[:, :-1].ravel(), want.reshape(n, length)[:, 1:].ravel()), 1)
            slots = features(unique)
            g = np.zeros(model.of_feature.shape)
            for j in range(slots.shape[1]):
                np.add.at(g, slots[:, j], by_word)
            g[0] = 0
            gw = np.zeros(model.of_word.shape)
            np.add.at(gw, [lexicon.get(w, 0) for w in unique], by_word)
            gw[0] = 0
            for x, grad, acc in ((model.of_feature, g / n, grams[0]), (model.of_word, gw / n, grams[1]), (model.step, (seen - pairs) / n, grams[2])):
                acc += grad * grad
                x += rate * grad / np.sqrt(acc)
    return model


class Tagger:
    """Language probabilities of documents, with a bounded store of words' emissions."""

    CHUNK, STORE = 64, 100_000

    def __init__(self, model: Model):
        self.model, self.ids, self.table = model, {}, np.zeros((0, len(model.labels)), dtype=np.float32)
        self.shares = np.zeros(0, dtype=np.float32)

    def _rows(self, words: list[str]) -> np.ndarray:
        """The place of every word in the store."""
        new = list({w for w in words if w not in self.ids})
        if len(self.ids) + len(new) > self.STORE:
            self.ids, self.table, self.shares, new = {}, self.table[:0], self.shares[:0], list(set(words))
        if new:
            e = np.concatenate([self.model.emissions(new[i : i + 20_000]) for i in range(0, len(new), 20_000)])
            e = np.exp(e - e.max(axis=1, keepdims=True)).astype(np.float32)
            self.ids.update(zip(new, range(len(self.ids), len(self.ids) + len(new))))
            self.table = np.concatenate([self.table, e])
            known = [known_shares(new[i : i + 20_000], self.model.seen) for i in range(0, len(new), 20_000)]
            self.shares = np.concatenate([self.shares, *known]).astype(np.float32)
        return np.fromiter(map(self.ids.__getitem__, words), dtype=np.int64, count=len(words))

    def known(self, docs: list[list[str]]) -> np.ndarray:
        """Per document, the mean share of its words' 3-grams that occur in the fit sample."""
        rows = self._rows(list(chain.from_iterable(docs)))
        shares = self.shares[rows].astype(np.float64)
        sizes = np.fromiter(map(len, docs), dtype=np.int64, count=len(docs))
        return np.bincount(np.repeat(np.arange(len(docs)), sizes), weights=shares, minlength=len(docs)) / np.maximum(sizes, 1)

    def named(self, docs: list[list[str]], least: float = 0.0) -> list[str | None]:
        """Each document's language, or null if it can't be told at a score of ``least`` or more."""
        k = len(self.model.labels)
        least = max(least, 1 / k + MARGIN * (1 - 1 / k)) - 1e-6
        total, known = self.sums(docs), self.known(docs)
        fine = [bool(w) and bool(total[r].max() >= least * len(w)) and bool(known[r] >= self.model.least_known) for r, w in enumerate(docs)]
        return [self.model.labels[total[r].argmax()] if ok else None for r, ok in enumerate(fine)]

    def identified(self, docs: list[list[str]], least: float = 0.0) -> list[bool]:
        return [lang is not None for lang in self.named(docs, least)]

    def sums(self, docs: list[list[str]]) -> np.ndarray:
        """Per document, the sum of its words' language probabilities. Chains are cut in chunks that go side by side."""
        k, size, step = len(self.model.labels), self.CHUNK, np.exp(self.model.step)
        lengths = np.fromiter(map(len, docs), dtype=np.int64, count=len(docs))
        chunks = -(-lengths // size)
        first = np.concatenate([[0], np.cumsum(chunks)])
        n = int(first[-1])
        if not n:
            return np.zeros((len(docs), k))
        word_at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        chunk, at = np.repeat(first[:-1], lengths) + word_at // size, word_at % size
        e = np.ones((size, n, k))
        rows = self._rows(list(chain.from_iterable(docs)))
        e[at, chunk] = self.table[rows]
        full = np.zeros((size, n), dtype=bool)
        full[at, chunk] = True
        starts = np.zeros(n, dtype=bool)
        starts[first[:-1][chunks > 0]] = True
        long = np.flatnonzero(chunks > 1)
        enter, leave = np.full((n, k), 1.0 / k), np.ones((n, k))  # what the chunk before says, what the chunk after says
        if len(long):
            inside = np.zeros(n, dtype=bool)
            for d in long:
                inside[first[d] : first[d + 1]] = True
            which = np.flatnonzero(inside)
            # The product of each chunk's factors, from the label before it to the label of its last word.
            prod = np.broadcast_to(np.eye(k), (len(which), k, k)).copy()
            for i in range(size):
                f = full[i, which]
                prod[f] = (prod[f] @ step) * e[i, which[f]][:, None, :]
                prod[f] /= prod[f].sum(axis=(1, 2), keepdims=True)
            spot = np.full(n, -1)
            spot[which] = np.arange(len(which))
            for j in range(int(chunks.max()) - 1):
                d = long[chunks[long] > j + 1]
                c = first[d] + j
                if j == 0:
                    v = self._first(e[:, c], step)
                else:
                    v = _scaled(np.einsum("nk,nkl->nl", enter[c], prod[spot[c]]))
                enter[c + 1] = v
            for j in range(int(chunks.max()) - 1):
                d = long[chunks[long] > j + 1]
                c = first[d + 1] - 1 - j
                leave[c - 1] = _scaled(np.einsum("nkl,nl->nk", prod[spot[c]], leave[c]))
        a = np.empty_like(e)
        a[0] = _scaled(np.where(starts[:, None], e[0], (enter @ step) * e[0]))
        for i in range(1, size):
            a[i] = np.where(full[i][:, None], _scaled((a[i - 1] @ step) * e[i]), a[i - 1])
        total, b = np.zeros((n, k)), leave
        for i in range(size - 1, -1, -1):
            f = full[i][:, None]
            total += np.where(f, _scaled(a[i] * b), 0.0)
            if i:
                b = np.where(f, _scaled((e[i] * b) @ step.T), b)
        out = np.zeros((len(docs), k))
        has = np.flatnonzero(chunks > 0)
        out[has] = np.add.reduceat(total, first[:-1][has], axis=0)
        return out

    @staticmethod
    def _first(e: np.ndarray, step: np.ndarray) -> np.ndarray:
        """Forward message at the end of full first chunks."""
        v = _scaled(e[0])
        for i in range(1, len(e)):
            v = _scaled((v @ step) * e[i])
        return v


def sample(labelled: DataFrame, docs_of_each: int = FIT_DOCS, chars: int = FIT_CHARS) -> list[tuple[str, str]]:
    """A bounded sample of (text, language), about as many documents of each language, chosen by a hash of doc_id."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    share = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) / 1e6
    keep = F.lit(False)
    for lang, n in sorted(counts.items()):
        keep = F.when(F.col("lang") == lang, share < 1.2 * docs_of_each / n).otherwise(keep)
    middle = F.greatest(F.lit(1), F.floor((F.length("text") - chars) / 2)).cast("int")
    chosen = rows.where(keep).select(F.substring("text", middle, F.lit(chars)).alias("text"), "lang")
    most = 2 * docs_of_each * len(counts)
    return [(r["text"], r["lang"]) for r in chosen.orderBy(F.xxhash64("text"), "text", "lang").limit(most).collect()]


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, n_words of each row's whole text."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model) if model else None
        for batch in batches:
            langs, scores, sizes = [], [], []
            for part in _parts(batch.column("text"), len(model.labels) if model else 1):
                words = [words_of(t) for t in part]
                sizes += map(len, words)
                if not tagger:
                    langs += [UND] * len(words)
                    scores += [0.0] * len(words)
                    continue
                total = tagger.sums(words)
                best = total.argmax(axis=1)
                langs += [model.labels[i] if w else UND for i, w in zip(best, words)]
                scores += [min(1.0, float(total[r, i]) / len(w)) if w else 0.0 for r, (i, w) in enumerate(zip(best, words))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(sizes, pa.int64())], names=["doc_id", "lang_pred", "score", "n_words"])

    doc_id = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(kernel, f"doc_id {doc_id}, lang_pred string, score double, n_words long")


def _parts(texts: pa.Array, labels: int) -> Iterator[list[str | None]]:
    """The texts, some at a time: at least one, and as many documents and characters as take bounded memory at so many labels."""
    part, size, share = [], 0, max(1, labels / 4)
    for t in texts:
        t = t.as_py()
        part.append(t)
        size += len(t or "")
        if size * share >= PART_CHARS or len(part) * share >= PART_DOCS:
            yield part
            part, size = [], 0
    if part:
        yield part


def held_out(doc_id) -> "F.Column":
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, n_words. Learned from the rows that aren't held out."""
    model = fit(sample(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "n_words")


def crc_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def keep_identified(docs: DataFrame, least: float = 0.25) -> DataFrame:
    """``docs`` without the documents whose language can't be told: ``und``, a score under ``least`` or hardly above an even
    share of the languages, or letters unlike those of the fit sample. ``lang`` becomes the identified language; all other
    columns stay as they are, and only the text goes through Python."""
    model = fit(sample(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")))

    def named(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tagger = Tagger(model) if model else None
        for texts in columns:
            out: list[str | None] = []
            for part in _parts(texts, len(model.labels) if model else 1):
                out += tagger.named([words_of(t) for t in part], least) if tagger else [None] * len(part)
            yield pa.array(out, pa.string())

    # Non-deterministic, so that the optimizer doesn't run it in the filter and again for the column.
    lang = F.arrow_udf(named, "string").asNondeterministic()
    found = docs.select(F.struct("*").alias("doc"), lang(F.col("text")).alias("found")).where(F.col("found").isNotNull())
    return found.select(*[F.col("found").cast(docs.schema[c].dataType).alias(c) if c == "lang" else F.col("doc")[c].alias(c) for c in docs.columns])
