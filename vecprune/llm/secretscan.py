"""Secret scans: three base patterns, and sliding-window Shannon entropy over candidate strings.

A candidate is a maximal run of a class's characters, at least a window long. Over it slides a window; the entropy of the
characters in it comes from counts that change by one character in and one out at every step. Windows at or over the
class's threshold are joined into spans. A span is suppressed if it lies in a base span, or if an allow-list rule holds
for the candidate (UUIDs, names in a path, runs of words, integrity hashes with a named algorithm, placeholders).
The allow-list never touches base spans.

Defined cases: null and empty texts have no spans; long texts and long candidates are scanned whole, in linear time;
repeated documents each get their row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# The base patterns and the shortest lengths of what they catch.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run that is shorter fails as a whole, so this equals matching runs and dropping
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
KINDS = ("assign", "access", "hex", "entropy")

#: Per class: its characters, window, and least bits per character of a window.
CLASSES = (
    ("hex", re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{20,}(?![0-9A-Fa-f])"), 20, 2.9),
    ("base64", re.compile(r"[A-Za-z0-9+/_=-]{24,}"), 24, 3.9),
)
ALLOWED = tuple(
    re.compile(p)
    for p in (
        r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}",  # UUID
        r"(?:[A-Za-z]{1,20}[/_=+-]){2,}[A-Za-z]{0,20}[0-9]{0,4}",  # words joined by path or name characters
        r"[0-9]+|[A-Za-z]+",  # one class only: a number or a word
        r"(?:sha(?:1|256|384|512)|md5)[-=:_][A-Za-z0-9+/=]+",  # integrity hash
    )
)
# A placeholder takes its piece of a run, up to the next / or =, or itself if it's filler; the rest of the run is scanned.
PLACEHOLDER, FILLER, PIECE = re.compile(r"(?i:example|placeholder|dummy|changeme)"), re.compile(r"[xX]{6,}|0{8,}"), re.compile(r"[^/=]+")


def entropy_windows(run: str, window: int, least: float) -> list[tuple[int, int]]:
    """Spans of the windows of ``run`` with ``least`` bits a character or more, joined where they touch."""
    log = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    counts: dict[str, int] = {}
    total, spans = 0.0, []
    for i, c in enumerate(run):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += log[n + 1] - log[n] if n < window else 0.0
        if i >= window:
            out = run[i - window]
            m = counts[out]
            counts[out] = m - 1
            total += log[m - 1] - (log[m] if m <= window else log[window])
        if i >= window - 1 and log[window] / window - total / window >= least - 1e-9:
            if spans and spans[-1][1] >= i - window + 1:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((i - window + 1, i + 1))
    return spans


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, by start, then kind as listed."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= ASSIGN_LEAST]
    found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    found.sort(key=lambda s: (s[0], s[2]))
    return [(s, e, KINDS[k]) for s, e, k in found]


def placeholders(run: str) -> list[tuple[int, int]]:
    """The parts of a run that placeholders take, in order."""
    out: list[tuple[int, int]] = []
    for p in PIECE.finditer(run):
        if PLACEHOLDER.search(p.group()):
            out.append(p.span())
        else:
            out += [(p.start() + f.start(), p.start() + f.end()) for f in FILLER.finditer(p.group())]
    return out


def entropy_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans that the entropy of windows adds to the base ones."""
    found: list[tuple[int, int]] = []
    for _, pattern, window, least in CLASSES:
        for m in pattern.finditer(text):
            run = m.group()
            if any(a.fullmatch(run) for a in ALLOWED):
                continue
            at = 0
            for end, after in [*placeholders(run), (len(run), len(run))]:
                rest = run[at:end]
                if not any(a.fullmatch(rest) for a in ALLOWED):
                    found += [(m.start() + at + s, m.start() + at + e) for s, e in entropy_windows(rest, window, least)]
                at = after
    joined: list[tuple[int, int]] = []
    for s, e in sorted(found):
        if joined and s <= joined[-1][1]:
            joined[-1] = (joined[-1][0], max(e, joined[-1][1]))
        else:
            joined.append((s, e))
    inside = [(s, e) for s, e, _ in base]
    return [(s, e, "entropy") for s, e in joined if not any(bs <= s and e <= be for bs, be in inside)]


def scan_text(text: str | None) -> tuple[list, list]:
    """Base spans and all spans of a text, both by start, then kind as listed."""
    if not text:
        return [], []
    base = base_spans(text)
    every = sorted(base + entropy_spans(text, base), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return base, every


def _line(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds: dict[str, list[int]] = {k: [] for k in KINDS}
            digests, lines = [], []
            for text in batch.column("text"):
                base, every = scan_text(text.as_py())
                for k in KINDS:
                    kinds[k].append(sum(s[2] == k for s in every) if every else 0)
                digests.append(hashlib.sha256(_line(base).encode()).hexdigest())
                lines.append(_line(every))
            longs = {k: pa.array(v, pa.int64()) for k, v in kinds.items()}
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), longs["assign"], longs["access"], longs["hex"], pa.array(digests, pa.string()), pa.array(lines, pa.string()), longs["entropy"]],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"],
            )

    doc_id = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(kernel, f"doc_id {doc_id}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long")


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of a secret replaced by ``mark``; all columns stay."""

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for s, e, _ in scan_text(text)[1]:
            if s >= at:
                out += [text[at:s], mark]
            at = max(at, e)
        return "".join([*out, text[at:]])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "text", pa.array([clean(t.as_py()) for t in batch.column(at)], pa.string()))

    return docs.mapInArrow(kernel, docs.schema)
