import html
import math
import re
import time
from html.parser import HTMLParser

from vecprune.llm import pagetext
from vecprune.llm.pagetext import main_text

LONG = "A sentence, that says something; and more of it. " * 5


def test_fixture_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    got = {r["page_id"]: r for r in pagetext.extract(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        article = r["html"].partition("<article>")[2].partition("</article>")[0]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", " ", b))).strip() for b in re.split("<p>|</p>|</h1>", article)]
        assert got[r["page_id"]]["text"] == "\n\n".join(b for b in blocks if b)
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])


def test_declared_article():
    page = f"""<html><head><title>t</title><style>p{{}}</style></head><body><header>Site</header><nav><a href=x>Menu</a></nav>
    <div class="cookie-notice">We use cookies</div><main><article><header><h1>Title &amp; more</h1></header><p>One <b>bold</b>
    word &#233;&nbsp;x.<p>{LONG}<div class="ad">Buy</div><script>var a = "<p>no</p>";</script><ul><li>First.<li>Second.</ul>
    <section id="comments"><p>{LONG} reader</p></section></article></main><aside>Side</aside><form><label>Name</label></form><footer>&copy; me</footer></body></html>"""
    assert main_text(page) == f"Title & more\n\nOne bold word é x.\n\n{LONG.strip()}\n\nFirst.\n\nSecond."


def test_undeclared_page_by_ratios():
    links = "".join(f"<li><a href='/{i}'>Link {i}</a></li>" for i in range(20))
    page = f"<body><div><ul>{links}</ul></div><div class=content><p>{LONG}</p><p>Short one.</p><p>{LONG}</p></div><div><span>Home</span></div></body>"
    text = main_text(page)
    assert LONG.strip() in text and "Short one." in text and "Link 3" not in text


def test_cases(spark):
    for empty in (None, "", "   ", "<html></html>", "<!-- only", "<script>x", "<p"):
        assert main_text(empty) == ""
    assert main_text("plain text, no tags.") == "plain text, no tags."
    assert main_text("<article><p>a < b and c > d") == "a < b and c > d"
    assert main_text('<article><p title="x > y">a</p><p class=\'q"\'>b</p></article>') == "a\n\nb"
    assert main_text("<article><p>x" + "<b>" * 5000 + "y") == "xy"
    big = "<article>" + f"<p>{LONG}</p>" * 4000 + "</article>"
    assert len(main_text(big)) == 4000 * (len(LONG) - 1) + 3999 * 2
    assert len(main_text("<article><p>a" + '<p x="' * 300)) >= 1
    pages = spark.createDataFrame([(1, "u", None, "z"), (1, "u", None, "z"), (None, None, "<p>Hi.</p>", None)], "page_id long, url string, html string, text string")
    assert sorted(map(tuple, pagetext.extract(pages).collect()), key=str) == [(1, "u", "", 0)] * 2 + [(None, None, "Hi.", 3)]
    assert pagetext.extract(pages.where("page_id = 5")).count() == 0


def test_ratios_decide_inside_an_article():
    """Without any telling name: a list of links in the article goes, and so does text outside of the article."""
    links = "".join(f"<li><a href='/{i}'>Link {i}</a></li>" for i in range(9))
    page = f"<body><div><p>Outside of it, some words; more.</p></div><article><h1>A heading of the page</h1><p>{LONG}</p><div><ul>{links}</ul></div><p>{LONG}</p></article></body>"
    assert main_text(page) == f"A heading of the page\n\n{LONG.strip()}\n\n{LONG.strip()}"


def test_stripped_fixture_pages():
    """Fixture pages with plain elements in the place of articles and without classes: every block of the article is found."""
    import pyarrow.parquet as pq

    for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist():
        article = r["html"].partition("<article>")[2].partition("</article>")[0]
        want = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", " ", b))).strip() for b in re.split("<p>|</p>|</h1>", article)]
        plain = re.sub(r' class="[^"]*"', "", r["html"].replace("<article>", "<div>").replace("</article>", "</div>"))
        got = main_text(plain).split("\n\n")
        assert {b for b in want if b} <= set(got)
        assert sum(map(len, got)) < 1.2 * sum(map(len, want)) + 200


class Plain(HTMLParser):
    """(path, text, share in links) of the text nodes of well-formed pages, by another parser and with whole paths."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.open, self.found = [], []

    def handle_starttag(self, tag, attrs):
        self.open.append((tag, tuple(v for k, v in attrs if k in ("class", "id"))))

    def handle_endtag(self, tag):
        assert self.open.pop()[0] == tag

    def handle_data(self, data):
        if data.strip():
            self.found.append((tuple(self.open), data))


def test_scores_against_plain_formulas():
    page = f"<body><div class=x><p>{LONG}</p><p>Two, words.</p><ul><li><a>One</a></li><li><a>Two links here</a></li></ul></div><div class=promo><p>{LONG[:40]}</p></div><article><h1>Head</h1><p>{LONG}</p></article></body>"
    parser = Plain()
    parser.feed(page)
    paths = list(dict.fromkeys(p for p, _ in parser.found))
    texts = {p: [t for q, t in parser.found if q == p] for p in paths}
    ratio = [math.log1p(sum(map(len, texts[p])) / len(texts[p])) for p in paths]
    marks = [math.log1p((sum(c in ".,;:!?" for t in texts[p] for c in t) + 0.5) / len(texts[p])) for p in paths]
    prior = [(12.0 if any(t == "article" for t, _ in p) else 1.0) * (0.1 if ("div", ("promo",)) in p else 1.0) * (0.1 if any(t == "a" for t, _ in p) else 1.0) for p in paths]

    def smooth(x, i):
        w = {j: 1.0 if j == i else 0.5 for j in (i - 1, i, i + 1) if 0 <= j < len(x)}
        return sum(x[j] * w[j] for j in w) / sum(w.values())

    want = [math.sqrt(smooth(ratio, i) * smooth(marks, i)) * prior[i] for i in range(len(paths))]
    nodes = pagetext.text_nodes(page)
    scores = pagetext.path_scores(nodes)
    assert [n.text for n in nodes] == [t for _, t in parser.found]
    assert all(abs(scores[n.path] - want[paths.index(p)]) < 1e-9 for n, (p, _) in zip(nodes, parser.found))


def test_time_grows_with_the_page():
    def took(n):
        began = time.process_time()
        for page in ("<div>" * n + "x" + "</b>" * n, "<p><body>" + "<address>" * n + "y.", "<ul>" + "<li><b>z " * n, "<div class=a>" * n + "deep"):
            main_text(page)
        return time.process_time() - began

    assert took(50_000) < 25 * took(5_000) + 1
