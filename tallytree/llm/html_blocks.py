"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into blocks at block-level tags. The measures of a block are its words, the share of
them inside links, the same of the blocks before and after it, and what its enclosing elements
say about themselves. A decision tree, grown on the small table of labelled blocks below, tells text from the rest.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)""",
    re.DOTALL,
)
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_WORDS = re.compile(r"[a-z]+")

#: Elements whose content is never text.
SILENT = frozenset("script style noscript template iframe svg math object embed canvas audio video head title textarea select optgroup option datalist button".split())
#: Of these, the content is raw: nothing but their own end tag ends them.
RAW = frozenset("script style textarea title noscript iframe template".split())
#: Of these, those that lie in one another.
NESTED = frozenset("svg math object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: What elements are by their tag, and by words of their class, id or role.
CHROME_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
TEXT_TAGS = frozenset("article main".split())
CHROME_WORDS = frozenset((
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu "
    "menubar breadcrumb breadcrumbs sidebar aside footer masthead topbar toolbar comment comments respond reply replies disqus "
    "discussion cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations widget pagination pager copyright legal disclaimer search form "
    "complementary contentinfo alert").split())
#: Words that a name may hold beside those; any other word makes it the name of something else (no-sidebar, related-work).
PLAIN_WORDS = frozenset((
    "site page main global primary secondary inner outer top bottom left right header head box block container wrapper wrap section "
    "area bar list item items link links post posts article articles story stories button buttons icons title content body "
    "text form count us more and the of").split())
#: What also names a section of an article.
SECTION_WORDS = frozenset("discussion legal notice notices alert disclaimer copyright".split())
#: Chrome whatever lies in it: remarks, and cards of other articles.
REMARK_WORDS = frozenset("comment comments respond reply replies disqus discussion".split())
CARD_WORDS = frozenset("related recommended recommendations".split())
CARD_TAGS = frozenset("nav footer aside menu dialog".split())
TEXT_WORDS = frozenset("article articlebody main content post entry story body text".split())


@dataclass
class Block:
    text: str
    words: int
    linked: int
    chrome: bool
    inside: bool
    heading: bool


class Element:
    """An open tag; ``holds`` names what starts inside it, which is known when the page has been read."""

    __slots__ = ("tag", "parent", "silent", "names", "words", "firm", "holds", "chrome", "inside", "article")

    def __init__(self, tag: str, attributes: str, parent: Element | None, silent: int):
        self.tag, self.parent, self.silent, self.holds = tag, parent, silent, set()
        tokens = [frozenset(_WORDS.findall(t)) for m in _NAMES.finditer(attributes) for t in (m[1] or m[2] or m[3] or "").lower().split()]
        self.names = frozenset().union(*tokens)
        named = tag not in TEXT_TAGS and tag not in ("body", "html")
        self.words = frozenset().union(*(t & CHROME_WORDS for t in tokens if t <= CHROME_WORDS | PLAIN_WORDS)) if named else frozenset()
        own = 2 if self.words & REMARK_WORDS else int(tag in CARD_TAGS or bool(self.words & CARD_WORDS))
        #: 1 where articles are cards, 2 where they are remarks.
        self.firm = max(own, parent.firm if parent else 0)
        if not silent and tag in ("article", "main", "h1", "p"):
            e, bound = parent, 2 if tag == "main" else 1
            while e and e.firm < bound and tag not in e.holds:
                e.holds.add(tag)
                e = e.parent

    def judge(self) -> None:
        """Whether it is chrome and whether text; parents come first."""
        up = self.parent
        chrome, inside, self.article = (up.chrome, up.inside, up.article or up.tag == "article") if up else (False, False, False)
        words = self.words - SECTION_WORDS if inside else self.words
        own = self.tag in CHROME_TAGS or (self.tag == "header" and not inside) or bool(words)
        if own and not self.article:
            titled = {"h1", "p"} <= self.holds and self.tag != "header" and not inside
            own = not (self.holds & TEXT_TAGS or titled)
        text = (self.tag in TEXT_TAGS or "articlebody" in self.names or self.names & TEXT_WORDS == {"article"}
                or "main" in self.names)
        self.chrome = chrome or own
        self.inside = (inside or text) and not self.chrome


def _left_open(page: str, tag: str, at: int) -> bool:
    """Whether a silent element that starts before ``at`` has no end tag of its own; a head need not have one."""
    if tag == "head":
        return True
    follows = _SAME[tag].search(page, at)
    return not follows or not follows[1]


#: The next tag of the name, or the next end tag where elements lie in one another.
_SAME = {t: re.compile(rf"<(/){'' if t in NESTED else '?'}{t}(?![a-z0-9:-])", re.IGNORECASE) for t in SILENT}


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order; character references are decoded and white space is folded.

    A silent element ends with its own end tag, with that of an element around it, or where an article, main or body starts;
    one that is left open ends at the next block at the latest.
    """
    out: list[Block] = []
    parts: list[tuple[str, bool]] = []
    stack: list[Element] = []  # silent: 1, 2 if left open, also from outside
    met: list[Element] = []
    owners: list[Element | None] = []
    links = 0
    unended: set[str] = set()  # tags with no end tag in the rest of the page
    heading = False
    at = 0

    def flush() -> None:
        nonlocal heading
        if parts:
            whole = " ".join(html.unescape("".join(t for t, _ in parts)).split())
            if whole:
                linked = sum(len(html.unescape(t).split()) for t, in_link in parts if in_link)
                out.append(Block(whole, whole.count(" ") + 1, linked, False, False, heading))
                owners.append(stack[-1] if stack else None)
            parts.clear()

    def start(name: str, attributes: str, silent: int) -> None:
        stack.append(Element(name, attributes, stack[-1] if stack else None, silent))
        met.append(stack[-1])

    def close(name: str) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k].tag == name:
                del stack[k:]
                break

    n = len(page)
    while at < n:
        token = _TOKEN.search(page, at)
        text = page[at : token.start()] if token else page[at:]
        if stack and stack[-1].tag == "head" and text.strip():
            stack.pop()
        silent = stack[-1].silent if stack else 0
        if text and not silent:
            parts.append((text, links > 0))
        if not token:
            break
        at = token.end()
        tag = token[2] or token[5]
        if not tag:
            if token[0].startswith("<![CDATA[") and not silent:
                parts.append((html.escape(token[0][9:].removesuffix("]]>")), links > 0))
            continue
        tag = tag.lower()
        closing, attributes = token[1] or token[4], token[3] or token[6] or ""
        if tag in RAW and not closing and not attributes.endswith("/"):
            # Raw content goes at once.
            end = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else n
            if tag not in INLINE:
                flush()
            continue
        if tag in SILENT:
            flush()
            if closing:
                close(tag)
            elif tag not in VOID and not attributes.endswith("/"):
                if tag in ("option", "optgroup"):
                    while stack and stack[-1].tag in ("option", tag):
                        stack.pop()
                    own = 1 if any(e.tag in ("select", "datalist") for e in stack) else 2
                else:
                    if tag not in NESTED:
                        close(tag)
                    own = 2 if tag in unended or _left_open(page, tag, at) else 1
                    if own == 2 and tag in NESTED:
                        unended.add(tag)
                start(tag, "", max(stack[-1].silent if stack else 0, own))
            continue
        if tag in INLINE:
            if tag == "a":
                links = 0 if closing else 1
            continue
        flush()
        if tag in VOID:
            continue
        if closing:
            close(tag)
            heading = False
            links = 0
            continue
        if silent:
            ends = 1 if tag in TEXT_TAGS or tag == "body" else 2
            first = next((k for k, e in enumerate(stack) if e.silent >= ends), len(stack))
            del stack[first:]
        if tag == "p" and stack and stack[-1].tag == "p":
            stack.pop()
        if tag in ("li", "td", "th", "tr", "dt", "dd") and stack and stack[-1].tag == tag:
            stack.pop()
        heading = tag in ("h1", "h2", "h3", "h4", "h5", "h6")
        start(tag, attributes, stack[-1].silent if stack else 0)
    flush()
    for element in met:
        element.judge()
    for block, element in zip(out, owners):
        if element:
            block.chrome, block.inside = element.chrome, element.inside
    return out


FEATURES = ("words", "link_density", "words_before", "density_before", "words_after", "density_after", "chrome", "inside", "heading", "page_marks_text")


def measures(found: list[Block]) -> np.ndarray:
    words = np.array([b.words for b in found], dtype=float)
    density = np.array([b.linked / b.words for b in found], dtype=float)
    before = lambda x: np.concatenate(([0.0], x[:-1]))
    after = lambda x: np.concatenate((x[1:], [0.0]))
    flags = [np.array([getattr(b, k) for b in found], dtype=float) for k in ("chrome", "inside", "heading")]
    marked = np.full(len(found), float(any(b.inside for b in found)))
    return np.stack([words, density, before(words), before(density), after(words), after(density), *flags, marked], axis=1)


#: Labelled blocks: the measures in the order of FEATURES, then 1 for text and 0 for the rest.
LABELLED = (
    # inside an article or main element
    (60, 0.00, 8, 0.0, 45, 0.0, 0, 1, 0, 1, 1), (8, 0.00, 0, 0.0, 60, 0.0, 0, 1, 1, 1, 1), (2, 0.00, 60, 0.0, 40, 0.0, 0, 1, 0, 1, 1),
    (1, 0.00, 90, 0.0, 0, 0.0, 0, 1, 0, 1, 1), (25, 0.30, 30, 0.0, 50, 0.1, 0, 1, 0, 1, 1), (120, 0.10, 2, 1.0, 3, 1.0, 0, 1, 0, 1, 1),
    (3, 1.00, 40, 0.0, 70, 0.0, 0, 1, 0, 1, 1), (5, 0.00, 12, 0.0, 14, 0.0, 0, 1, 1, 1, 1), (400, 0.02, 10, 0.0, 5, 0.5, 0, 1, 0, 1, 1),
    (7, 0.60, 20, 0.2, 30, 0.0, 0, 1, 0, 1, 1), (15, 0.00, 2, 1.0, 2, 0.0, 0, 1, 0, 1, 1), (30, 0.90, 30, 0.0, 30, 0.0, 0, 1, 0, 1, 1),
    # chrome by its element or name, whatever it holds
    (1, 1.00, 1, 1.0, 1, 1.0, 1, 0, 0, 1, 0), (2, 1.00, 0, 0.0, 2, 1.0, 1, 0, 0, 1, 0), (9, 0.00, 1, 1.0, 8, 0.0, 1, 0, 0, 1, 0),
    (80, 0.00, 20, 0.0, 60, 0.0, 1, 0, 0, 1, 0), (45, 0.05, 50, 0.0, 12, 0.3, 1, 0, 0, 0, 0), (6, 0.20, 90, 0.0, 0, 0.0, 1, 0, 0, 1, 0),
    (150, 0.00, 100, 0.0, 90, 0.0, 1, 0, 0, 0, 0), (4, 0.00, 50, 0.0, 2, 1.0, 1, 0, 1, 1, 0), (20, 0.50, 20, 0.5, 20, 0.5, 1, 0, 0, 0, 0),
    (12, 0.00, 3, 1.0, 40, 0.0, 1, 0, 0, 0, 0), (3, 0.00, 2, 1.0, 70, 0.0, 1, 0, 1, 0, 0), (35, 0.00, 70, 0.0, 80, 0.0, 1, 0, 0, 1, 0),
    (60, 0.00, 40, 0.0, 70, 0.0, 1, 0, 0, 0, 0), (22, 0.00, 30, 0.0, 45, 0.0, 1, 0, 0, 0, 0), (8, 0.00, 60, 0.0, 90, 0.0, 1, 0, 0, 0, 0),
    (130, 0.00, 8, 0.0, 200, 0.0, 1, 0, 0, 1, 0), (300, 0.00, 90, 0.0, 40, 0.0, 1, 0, 0, 0, 0), (14, 0.00, 70, 0.0, 30, 0.0, 1, 0, 0, 1, 0),
    (18, 0.00, 55, 0.0, 65, 0.0, 1, 0, 1, 0, 0), (70, 0.10, 25, 0.0, 33, 0.0, 1, 0, 0, 0, 0), (40, 0.00, 35, 0.0, 110, 0.0, 1, 0, 0, 1, 0),
    (160, 0.00, 12, 0.0, 28, 0.0, 1, 0, 0, 0, 0), (28, 0.00, 200, 0.0, 60, 0.0, 1, 0, 0, 1, 0), (5, 0.00, 45, 0.0, 50, 0.0, 1, 0, 0, 0, 0),
    (90, 0.00, 50, 0.0, 4, 0.0, 1, 0, 0, 0, 0), (17, 0.00, 40, 0.0, 0, 0.0, 1, 0, 0, 0, 0), (55, 0.00, 60, 0.0, 15, 0.0, 1, 0, 0, 1, 0),
    # outside the article of a page that marks one
    (50, 0.00, 40, 0.0, 70, 0.0, 0, 0, 0, 1, 0), (30, 0.00, 55, 0.0, 35, 0.0, 0, 0, 0, 1, 0), (12, 0.00, 60, 0.0, 80, 0.0, 0, 0, 0, 1, 0),
    (200, 0.00, 5, 0.0, 30, 0.0, 0, 0, 0, 1, 0), (20, 0.00, 90, 0.0, 0, 0.0, 0, 0, 0, 1, 0), (9, 0.00, 30, 0.0, 45, 0.0, 0, 0, 1, 1, 0),
    (70, 0.00, 70, 0.0, 5, 0.0, 0, 0, 0, 1, 0), (3, 0.00, 45, 0.0, 50, 0.0, 0, 0, 0, 1, 0), (16, 0.00, 25, 0.0, 28, 0.0, 0, 0, 0, 1, 0),
    (40, 0.00, 3, 1.0, 9, 0.0, 0, 0, 0, 1, 0), (5, 1.00, 5, 1.0, 5, 1.0, 0, 0, 0, 1, 0), (10, 0.00, 100, 0.0, 2, 1.0, 0, 0, 0, 1, 0),
    (90, 0.02, 60, 0.0, 60, 0.0, 0, 0, 0, 1, 0), (4, 0.00, 0, 0.0, 6, 0.0, 0, 0, 1, 1, 0), (2, 0.00, 80, 0.0, 4, 0.2, 0, 0, 0, 1, 0),
    # pages without marks: long blocks with few links, and short ones between such
    (60, 0.00, 10, 0.0, 50, 0.0, 0, 0, 0, 0, 1), (25, 0.05, 60, 0.0, 40, 0.0, 0, 0, 0, 0, 1), (18, 0.00, 4, 1.0, 70, 0.0, 0, 0, 0, 0, 1),
    (12, 0.00, 45, 0.0, 60, 0.0, 0, 0, 0, 0, 1), (8, 0.00, 30, 0.0, 35, 0.1, 0, 0, 0, 0, 1), (6, 0.00, 3, 1.0, 60, 0.0, 0, 0, 1, 0, 1),
    (3, 0.00, 50, 0.0, 45, 0.0, 0, 0, 0, 0, 1), (7, 0.00, 40, 0.0, 40, 0.0, 0, 0, 1, 0, 1), (200, 0.10, 5, 1.0, 3, 1.0, 0, 0, 0, 0, 1),
    (35, 0.20, 20, 0.0, 5, 1.0, 0, 0, 0, 0, 1), (5, 0.00, 2, 1.0, 55, 0.0, 0, 0, 1, 0, 1), (15, 0.00, 60, 0.0, 0, 0.0, 0, 0, 0, 0, 1),
    (3, 1.00, 3, 1.0, 3, 1.0, 0, 0, 0, 0, 0), (6, 0.80, 40, 0.0, 5, 1.0, 0, 0, 0, 0, 0), (30, 0.90, 10, 1.0, 12, 0.9, 0, 0, 0, 0, 0),
    (4, 0.00, 2, 1.0, 3, 1.0, 0, 0, 0, 0, 0), (5, 0.40, 4, 0.5, 3, 0.3, 0, 0, 0, 0, 0), (12, 0.75, 50, 0.0, 60, 0.0, 0, 0, 0, 0, 0),
    (2, 0.00, 1, 1.0, 2, 0.0, 0, 0, 0, 0, 0), (9, 0.50, 6, 0.6, 8, 0.5, 0, 0, 0, 0, 0), (50, 0.70, 3, 1.0, 4, 1.0, 0, 0, 0, 0, 0),
    (3, 0.00, 3, 0.0, 2, 0.0, 0, 0, 1, 0, 0), (1, 1.00, 60, 0.0, 1, 1.0, 0, 0, 0, 0, 0), (6, 0.00, 5, 1.0, 4, 0.0, 0, 0, 0, 0, 0),
)


class Tree:
    """A binary decision tree by Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 1):
        self.feature, self.value = -1, float(y.mean()) if len(y) else 0.0
        if depth == 0 or len(set(y.tolist())) < 2:
            return
        best = (1e-12, -1, 0.0)
        gini = lambda part: len(part) * (1 - part.mean() ** 2 - (1 - part.mean()) ** 2)
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for cut in (values[1:] + values[:-1]) / 2:
                low = x[:, f] < cut
                if min(low.sum(), (~low).sum()) >= least:
                    gain = gini(y) - gini(y[low]) - gini(y[~low])
                    if gain > best[0] + 1e-12:
                        best = (gain, f, float(cut))
        if best[1] < 0:
            return
        _, self.feature, self.cut = best
        low = x[:, self.feature] < self.cut
        self.low, self.high = Tree(x[low], y[low], depth - 1, least), Tree(x[~low], y[~low], depth - 1, least)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.value)
        out, low = np.empty(len(x)), x[:, self.feature] < self.cut
        out[low], out[~low] = self.low.score(x[low]), self.high.score(x[~low])
        return out


def trained(table=LABELLED) -> Tree:
    rows = np.array(table, dtype=float)
    return Tree(rows[:, :-1], rows[:, -1])


def main_text(page: str, tree: Tree) -> str:
    found = blocks(page)
    if not found:
        return ""
    keep = tree.score(measures(found)) >= 0.5
    return " ".join(b.text for b, k in zip(found, keep) if k)


def extract(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """``pages`` without the html, with ``text`` (empty if there is none) and ``n_chars``.

    A null or empty page has no text. Rows stay independent: repeated rows give repeated results. Columns of
    ``pages`` named text or n_chars are replaced.
    """
    tree = trained()
    kept = [c for c in pages.columns if c not in (html_column, "text", "n_chars")]

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [main_text(p, tree) if p else "" for p in part.column(len(kept)).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(len(kept))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    [*kept, "text", "n_chars"])

    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept)
    return pages.select(*kept, html_column).mapInArrow(work, (schema + ", " if kept else "") + "text string, n_chars long")
