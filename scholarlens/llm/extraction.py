"""Main text of web pages from flat text blocks.

A page is cut into flat blocks at block-level tags. Each block is described by its own words and
link density, those of its neighbours, and where it stands; a decision tree, trained on the
blocks of a few labelled pages, tells the article from the rest.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarlens.llm.common import free_name, text_of

SILENT = {"script", "style", "noscript", "template", "head", "title", "svg", "iframe", "select",
          "textarea", "button", "object"}
#: Silent elements that hold phrases or drawings; if one is not closed, a page goes on after it.
SOFT = {"button", "svg", "noscript", "select", "object"}
SOFT_END = re.compile(r"</(button|svg|noscript|select|object)(?=[\s/>])", re.IGNORECASE)
#: Tags that lie in none of these elements, closed or not.
SECTIONING = {"article", "main", "section", "nav", "aside", "header", "footer"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "wbr"}
INLINE = {"a", "b", "i", "u", "s", "em", "strong", "span", "small", "sub", "sup", "code", "font",
          "mark", "abbr", "cite", "q", "time", "br", "wbr", "img", "kbd", "var", "del", "ins", "label"}
FRAME = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset"}
MAIN = {"article", "main"}
FRAME_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|sidebar|menu|nav\w*|breadcrumbs?|"
    r"cookies?|consent|notice|popup|modal|newsletter|subscribe|comments?|replies|respond|share|"
    r"social|related|footer|header|login|search)(?:$|[\s_-])", re.IGNORECASE)
CUT_TAG = re.compile(r"<(?:[A-Za-z/!?][^<>]*)?$")
#: Elements that hold a page or its article: their names tell the layout, not what they hold.
WRAPPER = {"html", "body", *MAIN}
#: A named element with more than this share of the page's text is a wrapper too.
MOST = 0.5
CLOSES_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div",
            "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5",
            "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "search",
            "section", "summary", "table", "ul"}
#: Elements with implied ends: what an opening tag closes, and the elements it does not reach beyond.
IMPLIED: dict[str, tuple[set[str], set[str]]] = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"td", "th", "tr"}, {"table"}),
    **{x: ({"td", "th", "tr", "thead", "tbody", "tfoot"}, {"table"}) for x in ("thead", "tbody", "tfoot")}}
#: An open p is not closed from inside these.
P_SCOPE = {"table", "td", "th", "caption", "button", "object", "template"}
DEPTH, LEAST_ROWS = 6, 1


@dataclass
class Block:
    text: str
    linked: int
    inside: bool
    frame: bool
    named: int = -1


class _Blocks(HTMLParser):
    """``open`` holds (tag, framing tag, number of a framing name or -1) of every open element."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.ends = Counter(x.lower() for x in SOFT_END.findall(html))  # that are still to come
        self.open: list[tuple[str, bool, int]] = []
        self.tags: Counter[str] = Counter()
        self.parts: list[str] = []
        self.links: list[str] = []
        self.blocks: list[Block] = []
        self.outer: list[int] = []  # of each framing name, the one around it
        self.inner = -1
        self.silent = self.frames = self.mains = self.anchors = 0

    def _count(self, tag: str, frame: bool, by: int) -> None:
        self.tags[tag] += by
        self.silent += by * (tag in SILENT)
        self.frames += by * frame
        self.mains += by * (tag in MAIN)
        self.anchors += by * (tag == "a")

    def _pop(self) -> str:
        tag, frame, name = self.open.pop()
        self._count(tag, frame, -1)
        if name >= 0:
            self.inner = self.outer[name]
        return tag

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append(Block(text, len(" ".join(self.links).split()),
                                     self.mains > 0, self.frames > 0, self.inner))
        self.parts, self.links = [], []

    def _end(self, tags: set[str], scope: set[str]) -> None:
        """Close the outermost open element of ``tags`` below the last one of ``scope``."""
        if not any(self.tags[t] for t in tags):
            return
        at = None
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in scope:
                break
            if self.open[i][0] in tags:
                at = i
        if at is not None:
            while len(self.open) > at:
                self._pop()

    def _recover(self, tag: str) -> None:
        """End soft elements that ``tag`` cannot lie in, or whose end tag is missing."""
        missing = SOFT if tag in SECTIONING else {t for t in SOFT if self.tags[t] > self.ends[t]}
        self._end(missing, {"template"})

    def handle_startendtag(self, tag, attrs) -> None:
        self.ends[tag] += tag in SOFT
        super().handle_startendtag(tag, attrs)

    def handle_starttag(self, tag, attrs) -> None:
        if tag not in INLINE:
            self.flush()
        if self.silent and tag in CLOSES_P:
            self._recover(tag)
        if tag in CLOSES_P:
            self._end({"p"}, P_SCOPE)
        if tag in IMPLIED:
            self._end(*IMPLIED[tag])
        if tag in VOID:
            self.parts.append(" " if tag == "br" else "")
            return
        if tag == "body":  # an unclosed head ends here
            while self.tags["head"]:
                self._pop()
        name = -1
        if tag not in WRAPPER and FRAME_NAME.search(
                " ".join(v or "" for k, v in attrs if k in ("class", "id", "role"))):
            name = len(self.outer)
            self.outer.append(self.inner)
            self.inner = name
        self.open.append((tag, tag in FRAME, name))
        self._count(tag, tag in FRAME, 1)

    def handle_endtag(self, tag) -> None:
        if tag not in INLINE:
            self.flush()
        self.ends[tag] -= tag in SOFT
        if self.tags[tag]:
            while self._pop() != tag:
                pass

    def handle_data(self, data) -> None:
        if not self.silent:
            self.parts.append(data)
            if self.anchors:
                self.links.append(data)


def blocks_of(html: str) -> list[Block]:
    """Flat blocks in page order. A tag cut off by the end of the page is dropped.

    A name marks an element as frame unless the element is a wrapper: it holds most of the page's
    unlinked text, and no text of an article or main element lies outside it.
    """
    html = CUT_TAG.sub("", html)
    parser = _Blocks(html)
    parser.feed(html)
    parser.close()
    parser.flush()
    outer = parser.outer
    held, mains = [0] * (len(outer) + 1), [0] * (len(outer) + 1)  # the last is the page
    for b in parser.blocks:
        size = 0 if b.frame else max(0, len(b.text) - b.linked)
        held[b.named] += size
        mains[b.named] += size * b.inside
    for i in range(len(outer) - 1, -1, -1):  # inner elements have larger numbers
        held[outer[i]] += held[i]
        mains[outer[i]] += mains[i]
    frames = [False] * (len(outer) + 1)
    for i, at in enumerate(outer):
        frames[i] = frames[at] or held[i] <= MOST * held[-1] or mains[i] < mains[-1]
    for b in parser.blocks:
        b.frame = b.frame or frames[b.named]
    return parser.blocks


def features_of(blocks: list[Block]) -> list[tuple[float, ...]]:
    """Words and link density of the block before, the block and the one after; its place."""
    own = [(0.0, 0.0), *((float(len(b.text.split())), b.linked / len(b.text.split()))
                         for b in blocks), (0.0, 0.0)]
    return [(*own[i], *own[i + 1], *own[i + 2], float(b.inside), float(b.frame))
            for i, b in enumerate(blocks)]


_LONG = "plain words of a paragraph that goes on for a while and says what the article is about"
#: The labelled table: pages and, block by block, 1 for article text.
LABELLED: tuple[tuple[str, str], ...] = (
    (f"<nav><li><a>Home</a></li><li><a>News</a></li></nav><div class='ad'>Buy now.</div><article>"
     f"<h1>A title</h1><p>{_LONG}</p><p>Short.</p><p>{_LONG}</p></article><footer>Rights</footer>",
     "00011110"),
    (f"<header><p>{_LONG}</p></header><main><h2>Head</h2><p>Yes.</p><p><a>All linked</a></p>"
     f"<p>{_LONG} <a>link</a></p></main><aside><p>{_LONG}</p></aside><form>Your name</form>",
     "0111100"),
    (f"<div><a>One</a></div><div><a>Two three</a></div><div>{_LONG}</div><div>{_LONG}</div>"
     f"<div><a>Next page</a></div><div class='comments'><p>{_LONG}</p><p>Nice.</p></div>",
     "0011000"),
    (f"<article><p>{_LONG}</p><div class='ad'>{_LONG}</div><p>End.</p><div id='comments'>"
     f"<p>{_LONG}</p></div></article><div class='cookie-notice'>We use cookies</div>", "10100"),
    (f"<ul><li><a>Menu entry with words</a></li><li><a>{_LONG}</a></li></ul><p>{_LONG}</p>"
     f"<p>{_LONG} {_LONG}</p><div class='sidebar'>{_LONG} <a>more</a></div>", "00110"),
    (f"<body class='has-sidebar'><div>Site name</div><div><a>Home</a> <a>About us</a></div><div "
     f"class='content no-nav'><h1>Head words</h1><p>{_LONG}</p><p>Yes, so.</p><p>{_LONG}</p></div>"
     f"<div>All rights</div><div><a>Terms</a></div></body>", "00111100"),
    (f"<div id='main-sidebar'><div>Welcome back</div><div><a>{_LONG}</a></div><p>{_LONG}<p>{_LONG}"
     f"</div><div>Read next <a>{_LONG}</a></div><div><a>One</a></div>", "001100"),
    (f"<div><a>Home</a></div><p>{_LONG}</p><p>{_LONG}</p><div><a>Top</a></div><div>All rights</div>",
     "01100"),
    (f"<p>{_LONG}</p><div><a>Top</a></div><div>All rights</div>", "100"),
    (f"<div><a>Home</a></div><p>{_LONG}</p><p>{_LONG}</p>", "011"), (f"<p>{_LONG}</p>", "1"),
    (f"<main id='search'><p>{_LONG}</p><p>{_LONG}</p><p>Short end.</p></main>", "111"),
    (f"<nav><a>Home</a></nav><p>{_LONG} {_LONG}</p><div><a>More</a></div><p>{_LONG} {_LONG}</p>", "0101"),
    (f"<article><p>{_LONG}</p><div class='ad'><a>Buy it</a></div><p>{_LONG}</p></article>", "101"),
    (f"<article><p>{_LONG}</p><p><a>All linked</a></p><p>Yes.</p><div class='ad'><a>Buy it</a></div>"
     f"<p>{_LONG}</p></article>", "11101"),
)
Tree = tuple  # (feature, bound, below, above), or (verdict,)


def grow(rows: list[tuple[tuple[float, ...], int]], depth: int = DEPTH) -> Tree:
    """A tree of binary splits with the least Gini impurity; ties go to the first feature."""
    n, ones = len(rows), sum(y for _, y in rows)
    if depth == 0 or ones in (0, n):
        return (int(2 * ones > n),)
    impurity = lambda part: (lambda k, m: 2 * k * (m - k) / m)(sum(y for _, y in part), len(part))
    best = None
    for f in range(len(rows[0][0])):
        values = sorted({x[f] for x, _ in rows})
        for low, high in zip(values, values[1:]):
            bound = (low + high) / 2
            parts = [r for r in rows if r[0][f] <= bound], [r for r in rows if r[0][f] > bound]
            if min(map(len, parts)) >= LEAST_ROWS:
                score = sum(map(impurity, parts))
                if best is None or score < best[0] - 1e-12:
                    best = score, f, bound, parts
    if best is None:
        return (int(2 * ones > n),)
    _, f, bound, (below, above) = best
    return f, bound, grow(below, depth - 1), grow(above, depth - 1)


def verdict(tree: Tree, x: tuple[float, ...]) -> int:
    while len(tree) > 1:
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree[0]


def trained(labelled: tuple[tuple[str, str], ...] = LABELLED) -> Tree:
    rows = []
    for html, labels in labelled:
        found = features_of(blocks_of(html))
        if len(found) != len(labels):
            raise ValueError(f"{len(labels)} labels for {len(found)} blocks")
        rows += zip(found, map(int, labels))
    return grow(rows)


def main_text(html: str, tree: Tree) -> str:
    blocks = blocks_of(html)
    return "\n".join(b.text for b, x in zip(blocks, features_of(blocks)) if verdict(tree, x))


def extract(pages: DataFrame, html: str = "html", keep: list[str] | None = None,
            tree: Tree | None = None) -> DataFrame:
    """One row per page: struct ``row`` of the ``keep`` columns, ``text`` and ``n_chars``.

    A button, drawing, select, object or noscript that is not closed ends at the next block.
    A null or empty page has an empty text, as has a page without article. Repeated rows each
    give a row, an empty table none; columns of any name stay inside ``row``.
    """
    keep = pages.columns if keep is None else keep
    tree = tree or trained()
    row = free_name(pages, "_row")
    plain = pages.select(F.struct(*[F.col(c) for c in keep]).alias(row), text_of(html).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, tree) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(texts, pa.string()),
                pa.array([len(t) for t in texts], pa.int64())], ["row", "text", "n_chars"])
    kind = plain.schema[0].dataType.simpleString()
    return plain.mapInArrow(run, f"row {kind}, text string, n_chars long")
