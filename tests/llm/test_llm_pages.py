"""Main text of pages and archives of captures."""

import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tallytree.llm import html_blocks, warc_index

from conftest import rows

TREE = html_blocks.trained()
ARTICLE = "<p>" + "Long enough words make a paragraph of an article. " * 4 + "</p>"


def text_of(page):
    return html_blocks.main_text(page, TREE)


@pytest.mark.parametrize("page, want", [
    ("", ""), ("no markup but plain words that go on for a while and have no links at all in them", "no markup but plain words that go on for a while and have no links at all in them"),
    ("<html><head><title>T</title></head><body><article><h1>A &amp; B</h1><p>x<b>y</b>z<br>next&nbsp;line</p></article></body></html>", "A & B xyz next line"),
    ("<article><p>one<p>two</article><footer>&copy; me</footer>", "one two"),
    ("<nav><a href=/x>Home</a></nav><main><p>text &#233;&#x41;</p></main>", "text éA"),
    ("<article><p>a</p><div class='ad'>buy</div><aside>note</aside><form>f <input></form><p>b</p></article>", "a b"),
    ("<article><p>a</p><script>if (a < b) { x('</p>') }</script><style>p{}</style><!-- c --><p>b</article>", "a b"),
    ("<article><p>body</p></article><section id='comments'><p>" + "Nice text indeed, reader comment. " * 9 + "</p></section>", "body"),
    ("<header><p>site</p></header><article><header><h1>Title</h1></header><p>body</p></article>", "Title body"),
    ("<div class='cookie-notice'><p>" + "We value your privacy and use cookies for things. " * 5 + "</p></div>" + ARTICLE, ARTICLE[3:-4].strip()),
    ("<ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul>" + ARTICLE, ARTICLE[3:-4].strip()),
    ("<article><p title='a > b'>kept</p><textarea><p>raw</textarea><p>end", "kept end"),
    ("<article>5 < 6 and <unclosed", "5 < 6 and"),
])
def test_main_text(page, want):
    assert text_of(page) == want


@pytest.mark.parametrize("before", [
    "<select><option>A<option>B</select>", "<form><select><optgroup label=x><option>A<optgroup label=y><option>B</select></form>",
    "<input list=l><datalist id=l><option value=A><option value=B></datalist>", "<div><select><option>A<option>B</div>", "<option>A<option>B",
    "<button>Go", "<div><button>Go</div><button>Stop</button>", "<button>Go<button>Stop</button>", "<div><object data=x><param name=y></div>",
    "<video src=x>", "<audio src=x><canvas>", "<svg><path d='M0'/>", "<svg><g><svg><text>s</text></svg><text>t</text></g></svg>",
])
def test_silent_elements_end(before):
    for article in (f"<article>{ARTICLE}</article>", f"<div>{ARTICLE}</div>"):
        assert text_of(f"<html><head><title>T</title></head><body>{before}{article}</body></html>") == ARTICLE[3:-4].strip()


@pytest.mark.parametrize("wrapper", [
    "<div class='layout no-sidebar'>", "<div id='page-with-nav'>", "<div class='has-cookie-banner'>", "<div class='layout sidebar'>",
    "<form id='aspnetForm'>", "<div class='widget'><form>", "<main><form>",
])
def test_wrappers_are_not_chrome(wrapper):
    menu, note = "<nav><a href=/>Home</a></nav>", "<div class='site-footer'><p>" + "Words at the end of the page. " * 9 + "</p></div>"
    for article in (f"<article>{ARTICLE}</article>", f"<main>{ARTICLE}</main>", f"<div><h1>Head</h1>{ARTICLE}</div>"):
        want = ("Head " if "Head" in article else "") + ARTICLE[3:-4].strip()
        if wrapper != "<main><form>" or "Head" not in article:
            assert text_of(f"<body>{wrapper}{menu}{article}{note}</body>") == want


def test_sections_of_an_article_are_text():
    sections = "".join(f"<section id='{x}'><p>{x[:3]} one</p></section>" for x in ("discussion", "related-work", "legal"))
    ads = "<div class='ad-box'><p>buy</p></div><div class='related-posts'><p>more</p></div>"
    assert text_of(f"<article><p>a</p>{sections}{ads}<p>b</p></article>") == "a dis one rel one leg one b"


def test_articles_below_remarks_are_not_text():
    remarks = "<section id='comments'><article><p>" + "Nice text indeed. " * 9 + "</p></article></section>"
    cards = "<aside><article><p>card</p></article></aside><div class='related'><article><h1>x</h1><p>card</p></article></div>"
    assert text_of(f"<article><p>body</p></article>{remarks}{cards}") == "body"


def test_silent_elements_stay_silent():
    assert text_of("<article><p>a</p><button><div>x</div><p>y</p></button><select><option>A<option>B</select><p>b</p></article>") == "a b"
    assert text_of("<head><title>T</title><meta name=x><p>" + ARTICLE) == ARTICLE[3:-4].strip()


def test_tree_learns_its_table():
    import numpy as np

    table = np.array(html_blocks.LABELLED, dtype=float)
    assert len(table) < 200 and ((TREE.score(table[:, :-1]) >= 0.5) == table[:, -1]).mean() > 0.97


def test_extract_keeps_rows(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "w", "<main>" + "x &lt; " * 50_000 + "</main>"), (3, "w", "<main>a</main>")], "page_id LONG, url STRING, html STRING").selectExpr("*", "'old' AS text")
    out = html_blocks.extract(pages)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert rows(out.selectExpr("page_id", "url", "n_chars")) == [(1, "u", 0), (2, None, 0), (3, "w", 1), (3, "w", 199_999)]
    assert html_blocks.extract(pages.limit(0)).count() == 0


def test_given_pages_give_their_articles(spark):
    import html as h
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for row in html_blocks.extract(pages).join(pages.select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", row.html, re.S)[1]
        spaced = re.sub(r"<(?!/?b>)[^>]*>", " ", article).replace("<b>", "").replace("</b>", "")
        assert row.text == " ".join(h.unescape(spaced).split()) and row.n_chars == len(row.text)


# Archives

def test_loser_tree_merges():
    r = random.Random(0)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted((r.randrange(50),) for _ in range(r.randrange(20))) for _ in range(k)]
        assert list(warc_index.LoserTree([iter(x) for x in runs])) == sorted(x for run in runs for x in run)


@pytest.mark.parametrize("url, key", [
    ("http://WWW.Example.com/A?b=2&a=1#top", "com,example)/a?a=1&b=2"), ("https://x.org:8080", "org,x:8080)/"), (None, ""), ("http://[bad", "http://[bad"),
])
def test_url_key(url, key):
    assert warc_index.url_key(url) == key


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


PAGES = [(1, "http://b.com/x", "same"), (2, "http://a.com/", "other\r\n\r\nWARC/1.1\r\n\r\nend\r\n\r\n"), (3, "http://a.com/", None), (4, None, ""), (5, "u\r\nX: y", "same"),
         (6, "http://a.com/z", "\r\n\r\n"), (7, "http://a.com/", "é\x01☃ " * 30_000), (8, "http://b.com/x", "same"), (8, "http://b.com/x", "same")]


def test_archives_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id LONG, url STRING, html STRING").repartition(3)
    path = str(tmp_path / "warc")
    out = warc_index.capture_history(pages, path).collect()
    assert len(out) == len(PAGES)
    for r in out:
        text = next(h for i, _, h in PAGES if i == r.page_id)
        assert (r.payload_bytes, r.payload_digest) == (len((text or "").encode()), digest(text))
        last = max(i for i, _, h in PAGES if (h or "") == (text or ""))
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == last else ("revisit", last))
    order = [(r.url_key, r.captured, r.page_id) for r in sorted(out, key=lambda r: (r.slice, r.slot))]
    assert order == sorted(order) and len({(r.slice, r.slot) for r in out}) == len(out)
    # Each place in an archive file holds the record that the index says.
    import gzip
    data = {r.file: gzip.decompress(open(r.file.removeprefix("file:"), "rb").read()) for r in out}
    for r in out:
        assert data[r.file][r.start:].startswith(f"WARC/1.1\r\nWARC-Type: {r.record_type}\r\nWARC-Record-ID: <urn:capture:{r.page_id}>".encode())


def test_small_payloads_are_responses(spark):
    pages = spark.createDataFrame([(1, "a", "xx"), (2, "b", "xx"), (None, "c", "yyyy"), (4, "d", "yyyy")], "page_id LONG, url STRING, html STRING")
    assert rows(warc_index.typed(pages, least=3), "page_id", "record_type", "refers_to") == [
        (1, "response", None), (2, "response", None), (4, "response", None), (None, "revisit", 4)]
    assert warc_index.capture_history(pages.limit(0)).count() == 0


def test_damaged_archive_raises():
    with pytest.raises(ValueError):
        list(warc_index.parsed(b"garbage\r\n\r\n"))
