"""Main text of web pages by tag-path ratios.

A page is read as a sequence of text nodes, each under a root-to-leaf tag path (tags with their class and id). Per path:
the length of its text and its punctuation, each against the number of its nodes and the share of text in links. The
ratios are smoothed over the order in which paths first appear and fused by product; paths at or over a threshold are
content. What a page declares is one more factor of the product: ``DECLARED_PRIOR`` in a main or article element,
``NAMED_PRIOR`` where a class or id names notices, adverts, comments and the like, and 0 in elements that never hold main text
(scripts, styles, menus, headers, footers, sidebars, forms). So a list of links in an article goes by its ratios, and so do
paragraphs outside of one.

Defined cases: null, empty and text-free html give an empty text; broken markup is read as far as it goes: an unclosed
element ends with its parent, an unfinished tag ends the page, an unclosed script or comment runs to the end; long pages
are read whole in linear time; repeated pages each get their row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from math import log1p

import pyarrow as pa
from pyspark.sql import DataFrame

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:[\"'][^>]*+)?(?:>|\Z)", re.S)
RAW = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for t in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript")}
ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|itemprop)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。、，؟]")
SPACE = re.compile(r"\s+")

# Elements of HTML by their role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
EXCLUDED = set("head script style noscript template nav aside footer form button select option textarea iframe object embed svg canvas audio video map dialog menu title datalist xmp noembed noframes".split())
BLOCK = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
CLOSES_P = BLOCK - set("body html tbody td tfoot th thead tr caption".split())
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = set("ul ol dl table select article section div main aside nav body".split())
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|adbox|banner|promo\w*|sponsor\w*|nav|navbar|navigation|menu\w*|breadcrumb\w*|sidebar|side|footer|masthead|topbar|cookie\w*|consent|gdpr|notice|notices|alert|popup|modal|overlay|newsletter|subscri\w*|signup|login|share|sharing|social|related|recommend\w*|comment|comments|commentlist|respond|reply|replies|disqus|discussion|widget|toolbar|pagination|pager|skip|legal|copyright|hidden|popular|trending|tags|meta-nav)(?:$|[\s_-])",
    re.I,
)
# Factors of a path's ratios: in an element that declares the article, and in one with a telling name. Least share of the mean.
DECLARED_PRIOR, NAMED_PRIOR, SHARE = 12.0, 0.1, 0.25
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())


def _names(attrs: str) -> list[tuple[str, str]]:
    return [(n.lower(), a or b or c) for n, a, b, c in ATTR.findall(attrs)] if attrs else []


def _prior(tag: str, names: list[tuple[str, str]], in_article: bool) -> float:
    """What an element says about its content: 0 for what is never main text, less than 1 for a telling name."""
    if tag in EXCLUDED or tag == "header" and not in_article:
        return 0.0
    out = 1.0
    for name, value in names:
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value.lower() in ROLES:
            return 0.0
        if name in ("class", "id") and tag not in ("html", "body", "main", "article") and NAMED.search(value):
            out = NAMED_PRIOR
    return out


class Node:
    __slots__ = ("path", "text", "block", "link", "prior")

    def __init__(self, path: int, text: str, block: int, link: bool, prior: float):
        self.path, self.text, self.block, self.link, self.prior = path, text, block, link, prior


class _Open:
    """The open elements: tag, path, prior, whether in an article, whether in a link. Each step takes constant time, shared
    among the elements that it closes. A path is a number for (parent's path, tag with class and id)."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, float, bool, bool]] = [("", 0, 1.0, False, False)]
        self.at: dict[str, list[int]] = {}
        self.scopes: list[int] = [0]
        self.paths: dict[tuple[int, str], int] = {}

    def push(self, tag: str, attrs: str) -> None:
        _, path, prior, article, link = self.stack[-1]
        names = _names(attrs)
        label = tag + "".join(f".{v}" if n == "class" else f"#{v}" for n, v in names if n in ("class", "id"))
        path = self.paths.setdefault((path, label), len(self.paths) + 1)
        declared = tag in ("article", "main")
        prior *= _prior(tag, names, article) * (DECLARED_PRIOR if declared and not article else 1.0)
        self.at.setdefault(tag, []).append(len(self.stack))
        if tag in SCOPES:
            self.scopes.append(len(self.stack))
        self.stack.append((tag, path, prior, article or declared, link or tag == "a"))

    def cut(self, place: int) -> None:
        """Close the element at ``place`` and all in it."""
        for tag, *_ in self.stack[place:]:
            self.at[tag].pop()
            if tag in SCOPES:
                self.scopes.pop()
        del self.stack[place:]

    def last(self, tags: set[str] | tuple[str, ...]) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def close(self, tag: str) -> None:
        if self.at.get(tag):
            self.cut(self.at[tag][-1])

    def make_room(self, tag: str) -> None:
        """Close what can't hold ``tag``, as far as the innermost scope."""
        if tag in CLOSES_P and self.last(("p",)) > self.scopes[-1]:
            self.close("p")
        while tag in SELF_CLOSING and self.last(SELF_CLOSING[tag]) > self.scopes[-1]:
            self.cut(self.last(SELF_CLOSING[tag]))


def text_nodes(html: str) -> list[Node]:
    """The page's text nodes in order; ``block`` numbers the block that each belongs to."""
    out: list[Node] = []
    held = _Open()
    at, block, size = 0, 0, len(html)

    def add(raw: str) -> None:
        if raw and not raw.isspace():
            _, path, prior, _, link = held.stack[-1]
            out.append(Node(path, raw, block, link, prior))
        elif raw and out and out[-1].block == block and not out[-1].text[-1:].isspace():
            out[-1].text += " "

    while at < size:
        cut = html.find("<", at)
        if cut < 0:
            add(html[at:])
            break
        m = TOKEN.match(html, cut)
        if not m:  # a bare "<"
            nxt = html.find("<", cut + 1)
            nxt = size if nxt < 0 else nxt
            add(html[at:nxt])
            at = nxt
            continue
        if cut > at:
            add(html[at:cut])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        tag, attrs = m[2].lower(), m[3]
        if tag in BLOCK:
            block += 1
        if m[1]:
            held.close(tag)
        elif tag == "br":
            if out and out[-1].block == block:
                out[-1].text += " "
        elif tag not in VOID:
            held.make_room(tag)
            if tag in RAW:
                end = RAW[tag].search(html, at)
                at = end.end() if end else size
            else:
                held.push(tag, attrs)
    return out


def path_scores(nodes: list[Node], spread: int = 1) -> dict[int, float]:
    """Fused score of every path: geometric mean of the smoothed ratios of text length and of punctuation to nodes, lowered by
    the share of text in links, times the prior of its elements.

    The ratios are on a log scale, so that one huge node doesn't put every heading below the threshold.
    """
    stats: dict[int, list[float]] = {}
    for n in nodes:
        s = stats.setdefault(n.path, [0, 0, 0, 0, n.prior])
        length = len(n.text)
        s[0] += length
        s[1] += len(PUNCTUATION.findall(n.text))
        s[2] += 1
        s[3] += length if n.link else 0
    paths = list(stats)
    length = [log1p(s[0] / s[2]) for s in stats.values()]
    marks = [log1p((s[1] + 0.5) / s[2]) for s in stats.values()]
    plain = [(1 - 0.9 * s[3] / s[0]) * s[4] for s in stats.values()]

    def smooth(x: list[float]) -> list[float]:
        out = []
        for i in range(len(x)):
            around = range(max(0, i - spread), min(len(x), i + spread + 1))
            out.append(sum(2.0 ** -abs(i - j) * x[j] for j in around) / sum(2.0 ** -abs(i - j) for j in around))
        return out

    fused = [(a * b) ** 0.5 * c for a, b, c in zip(smooth(length), smooth(marks), plain)]
    return dict(zip(paths, fused))


def content_nodes(nodes: list[Node], share: float = SHARE) -> list[Node]:
    """The nodes whose path scores ``share`` of the mean score of the page's text at least."""
    nodes = [n for n in nodes if n.prior]
    if not nodes:
        return []
    scores = path_scores(nodes)
    least = share * sum(scores[n.path] * len(n.text) for n in nodes) / sum(len(n.text) for n in nodes)
    return [n for n in nodes if scores[n.path] >= least]


def main_text(html: str | None, share: float = SHARE) -> str:
    """Blocks of the main text, joined by an empty line."""
    if not html:
        return ""
    blocks: list[list[str]] = []
    last = None
    for n in content_nodes(text_nodes(html), share):
        if n.block != last:
            blocks.append([])
            last = n.block
        blocks[-1].append(n.text)
    texts = (SPACE.sub(" ", unescape("".join(b))).strip() for b in blocks)
    return "\n\n".join(t for t in texts if t)


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.select("page_id", "url", "html").mapInArrow(kernel, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
