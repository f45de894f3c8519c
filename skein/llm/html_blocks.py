"""HTML extraction: flat text blocks, classified by a decision tree on their words, links and neighbours.

The tree sees six numbers: word count and share of link text of a block, of the one before and of the one after. It is
trained on a small labelled table of such blocks and knows no markup. The text runs from the first block that it calls content to the
last one, so that headings and short lines between them stay; menus, headers and footers are left to it.

Markup can only take away: elements that are asides or forms, or whose class or id says notice, advert, comments and the like, as prose inside them
has the same numbers as an article's. Where the tree calls nothing content there is no text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches

#: Elements that don't end a block, whose text is never text, that are never part of an article, and that make one.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
HIDDEN = frozenset("script style noscript template head title textarea select option button svg math iframe object canvas audio video".split())
CHROME = frozenset("aside form dialog".split())
ARTICLE = frozenset("article main".split())
FOREIGN = frozenset("svg math path g circle rect line polyline polygon ellipse use defs symbol image stop mi mn mo mrow".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
#: Words in class, id and role that mark what isn't the article; the second kind is also found on wrappers of whole pages, and any article below
#: it is one again. A name counts as a whole: each of its parts must be such a word or one that only says what shape it has, so that ad-box is marked
#: and ad-free, comments-open or has-sidebar aren't.
FIRM = frozenset("ad ads advert adverts advertisement advertisements sponsor sponsored promo cookie cookies consent gdpr notice notices popup modal newsletter subscribe signup comment comments respond disqus replies reply breadcrumb breadcrumbs".split())
SOFT = frozenset("banner sidebar side widget widgets menu nav navbar navigation masthead topbar toolbar share sharing social related recommended pagination pager search login complementary".split())
SHAPE = frozenset("area bar block body box btn button buttons card cards col column container content footer form group header holder inner item items left link links list main module outer page panel post right row section site slot text thread title top unit wrap wrapper".split())
#: Elements that can stand in a head; any other ends it.
HEAD = frozenset("title style script noscript template meta link base object".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_ATTRIBUTE = re.compile(r"(?i)\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")

FEATURES = ["words", "links", "words_before", "links_before", "words_after", "links_after"]
#: The small labelled table: rows of FEATURES and whether the block belongs to the article. Word counts are cut at 50.
LABELLED = [
    # article blocks of pages: headings, paragraphs and short lines
    ((4, 0.0, 7, 0.0, 4, 0.0), 1), ((7, 0.0, 8, 0.0, 7, 0.0), 1), ((1, 0.0, 50, 0.0, 1, 0.0), 1), ((4, 0.0, 5, 0.0, 12, 0.0), 1),
    ((6, 0.0, 8, 0.0, 13, 0.0), 1), ((4, 0.0, 34, 0.0, 15, 0.0), 1), ((1, 0.0, 1, 0.0, 48, 0.0), 1), ((2, 0.0, 12, 0.0, 19, 0.0), 1),
    ((5, 0.0, 45, 0.0, 31, 0.0), 1), ((2, 0.0, 50, 0.0, 50, 0.0), 1), ((10, 0.0, 7, 0.0, 4, 0.0), 1), ((9, 0.0, 9, 0.0, 6, 0.0), 1),
    ((12, 0.0, 50, 0.0, 2, 0.0), 1), ((11, 0.0, 5, 0.0, 14, 0.0), 1), ((8, 0.0, 12, 0.0, 8, 0.0), 1), ((8, 0.0, 26, 0.0, 11, 0.0), 1),
    ((13, 0.0, 6, 0.0, 50, 0.0), 1), ((11, 0.0, 8, 0.0, 49, 0.0), 1), ((8, 0.0, 8, 0.0, 17, 0.0), 1), ((14, 0.0, 24, 0.0, 43, 0.0), 1),
    ((15, 0.0, 50, 0.0, 50, 0.0), 1), ((20, 0.0, 6, 0.0, 2, 0.0), 1), ((23, 0.0, 10, 0.0, 4, 0.0), 1), ((17, 0.0, 44, 0.0, 1, 0.0), 1),
    ((19, 0.0, 2, 0.0, 13, 0.0), 1), ((19, 0.0, 13, 0.0, 11, 0.0), 1), ((17, 0.0, 43, 0.0, 14, 0.0), 1), ((22, 0.0, 7, 0.0, 33, 0.0), 1),
    ((22, 0.0, 14, 0.0, 20, 0.0), 1), ((20, 0.0, 22, 0.0, 49, 0.0), 1), ((31, 0.0, 5, 0.0, 1, 0.0), 1), ((31, 0.0, 10, 0.0, 6, 0.0), 1),
    ((24, 0.0, 50, 0.0, 5, 0.0), 1), ((29, 0.0, 6, 0.0, 9, 0.0), 1), ((25, 0.0, 10, 0.0, 15, 0.0), 1), ((26, 0.0, 50, 0.0, 8, 0.0), 1),
    ((26, 0.0, 6, 0.0, 50, 0.0), 1), ((31, 0.0, 9, 0.0, 34, 0.0), 1), ((30, 0.0, 33, 0.0, 45, 0.0), 1), ((50, 0.0, 7, 0.0, 2, 0.0), 1),
    ((50, 0.0, 15, 0.0, 2, 0.0), 1), ((50, 0.0, 49, 0.0, 1, 0.0), 1), ((40, 0.0, 25, 0.0, 6, 0.0), 1), ((50, 0.0, 1, 0.0, 11, 0.0), 1),
    ((50, 0.0, 15, 0.0, 10, 0.0), 1), ((46, 0.0, 50, 0.0, 8, 0.0), 1), ((32, 0.0, 27, 0.0, 8, 0.0), 1), ((48, 0.0, 1, 0.0, 24, 0.0), 1),
    ((35, 0.0, 6, 0.0, 23, 0.0), 1), ((50, 0.0, 13, 0.0, 50, 0.0), 1), ((50, 0.0, 9, 0.0, 50, 0.0), 1), ((50, 0.0, 50, 0.0, 50, 0.0), 1),
    ((38, 0.0, 23, 0.0, 16, 0.0), 1),
    # menu links, adverts after a menu, and footers of the same pages
    ((7, 0.0, 1, 1.0, 4, 0.0), 0), ((5, 0.0, 1, 1.0, 11, 0.0), 0), ((7, 0.0, 4, 0.0, 0, 0.0), 0), ((7, 0.0, 10, 0.0, 0, 0.0), 0),
    ((7, 0.0, 50, 0.0, 0, 0.0), 0), ((1, 1.0, 0, 0.0, 1, 1.0), 0), ((1, 1.0, 1, 1.0, 1, 1.0), 0), ((1, 1.0, 1, 1.0, 8, 0.0), 0),
    ((8, 0.0, 1, 1.0, 6, 0.0), 0), ((8, 0.0, 1, 1.0, 14, 0.0), 0), ((9, 0.0, 1, 1.0, 8, 0.0), 0), ((11, 0.0, 5, 0.0, 0, 0.0), 0),
    ((11, 0.0, 9, 0.0, 0, 0.0), 0), ((8, 0.0, 46, 0.0, 0, 0.0), 0), ((16, 0.0, 3, 0.0, 0, 0.0), 0), ((16, 0.0, 8, 0.0, 0, 0.0), 0),
    ((16, 0.0, 50, 0.0, 0, 0.0), 0),
    # other pages: long blocks with few links, and headings and short lines between them
    ((50, 0.2, 0, 0.0, 0, 0.0), 1), ((35, 0.0, 2, 1.0, 3, 0.9), 1), ((9, 0.0, 2, 1.0, 40, 0.0), 1), ((8, 0.0, 3, 0.8, 50, 0.0), 1),
    ((24, 0.0, 16, 0.0, 4, 1.0), 1), ((5, 0.0, 1, 1.0, 50, 0.0), 1), ((7, 0.0, 2, 1.0, 48, 0.0), 1), ((3, 0.0, 1, 1.0, 44, 0.0), 1),
    ((2, 0.0, 0, 0.0, 0, 0.0), 1), ((12, 0.0, 0, 0.0, 0, 0.0), 1), ((50, 0.0, 0, 0.0, 0, 0.0), 1), ((5, 0.0, 0, 0.0, 50, 0.0), 1), ((8, 0.0, 0, 0.0, 40, 0.0), 1), ((2, 0.0, 0, 0.0, 30, 0.0), 1),
    ((40, 0.1, 3, 0.0, 45, 0.0), 1), ((17, 0.1, 22, 0.1, 25, 0.0), 1), ((50, 0.0, 50, 0.0, 0, 0.0), 1), ((45, 0.1, 30, 0.0, 1, 1.0), 1),
    # other pages: lists of links, and short lines among them
    ((2, 1.0, 2, 1.0, 9, 0.0), 0), ((3, 0.9, 50, 0.0, 4, 0.8), 0), ((10, 0.8, 12, 0.7, 9, 0.9), 0), ((4, 0.0, 2, 1.0, 3, 1.0), 0),
    ((30, 0.9, 8, 1.0, 6, 1.0), 0), ((6, 0.0, 1, 1.0, 2, 0.0), 0), ((50, 0.8, 20, 0.9, 20, 0.9), 0), ((7, 0.5, 3, 0.6, 8, 0.5), 0),
    ((3, 0.0, 0, 0.0, 4, 1.0), 0), ((1, 1.0, 50, 0.0, 1, 1.0), 0), ((2, 1.0, 40, 0.0, 0, 0.0), 0), ((4, 1.0, 50, 0.0, 50, 0.0), 0),
]


def marks(attributes: str) -> int:
    """0, 1 for a mark that any article inside lifts, 2 for a firm one."""
    found = 0
    for a, b, c in _ATTRIBUTE.findall(attributes):
        for token in (a or b or c).lower().split():
            parts = {x.rstrip("0123456789") for x in re.split("[-_]+", token)} - {""}
            if parts and parts <= FIRM | SOFT | SHAPE:
                found = max(found, 2 if parts & FIRM else 1 if parts & SOFT else 0)
    return found


def blocks_of(page: str) -> list[tuple[str, int, float, int, int]]:
    """The page's text blocks in order: text, words, share of link text, number of the outermost article (0: none), and
    how firmly it is marked as something else (0: not at all).

    A block is the text between tags that aren't inline. Scripts, styles, comments and other hidden elements have none.
    Elements end with their end tag, or with that of one around them; everything open ends with the page.
    """
    out, parts = [], []
    stack: list[tuple[str, int, int, int, int]] = []  # tag, and what held before it: hidden, link, article, chrome
    hidden = link = article = chrome = articles = 0
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((text, len(text.split(" ")), min(1.0, linked / len(text)), article, chrome))
            parts.clear()
            linked = 0

    def text(piece: str) -> None:
        nonlocal linked
        if piece and not hidden:
            parts.append(piece)
            if link:
                linked += len(piece)

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:-3])
            continue
        tag = m[2].lower()
        if tag == "br":
            text(" ")
            continue
        if tag not in INLINE:
            flush()
        if m[1]:
            depth = next((d for d in range(len(stack) - 1, -1, -1) if stack[d][0] == tag), None)
            if depth is not None:
                _, hidden, link, article, chrome = stack[depth]
                del stack[depth:]
            continue
        if tag not in HEAD and (depth := next((d for d, x in enumerate(stack) if x[0] == "head"), None)) is not None:
            _, hidden, link, article, chrome = stack[depth]  # the end tag of a head may be left out
            del stack[depth:]
        if tag in VOID or m[3].endswith("/") and tag in FOREIGN:
            continue
        if tag == "p" and stack and stack[-1][0] == "p":
            _, hidden, link, article, chrome = stack.pop()
        stack.append((tag, hidden, link, article, chrome))
        hidden |= tag in HIDDEN
        link |= tag == "a"
        mark = marks(m[3]) if m[3] and tag not in ("html", "body") else 0
        if tag in ARTICLE:
            if chrome == 1 or chrome == 2 and (tag == "main" or not articles):  # the first article of a page is one wherever it stands
                chrome = 0
            if not article:
                articles += 1
                article = articles
                mark = 0
            mark = 2 * (mark == 2 and tag == "article")  # a comment inside an article
        if tag in CHROME:
            mark = 3
        chrome = max(chrome, mark)
        if tag in RAW:  # their content is no markup
            close = re.compile(f"</{tag}\\s*>", re.I).search(page, at)
            at = close.start() if close else end
    flush()
    return out


def features_of(blocks: list[tuple[str, int, float, int, int]]) -> list[tuple[float, ...]]:
    near = [(0.0, 0.0), *((min(w, 50), link) for _, w, link, *_ in blocks), (0.0, 0.0)]
    return [(*near[i + 1], *near[i], *near[i + 2]) for i in range(len(blocks))]


def learn_tree(spark: SparkSession, labelled=LABELLED, depth: int = 6):
    """The tree learned on the small table, as nested (feature, threshold, below, above) or a class."""
    rows = spark.createDataFrame([(Vectors.dense(x), float(y)) for x, y in labelled], ["features", "label"])
    root = DecisionTreeClassifier(maxDepth=depth, maxBins=64, seed=10).fit(rows)._call_java("rootNode")

    def read(node):
        if node.getClass().getSimpleName() == "LeafNode":
            return int(node.prediction())
        return (node.split().featureIndex(), node.split().threshold(), read(node.leftChild()), read(node.rightChild()))

    return read(root)


def decide(tree, x: tuple[float, ...]) -> int:
    while not isinstance(tree, int):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def main_text(page: str, tree) -> str:
    """The blocks from the first to the last one that the tree calls content, less the marked ones, joined by a space."""
    blocks = blocks_of(page)
    called = [k for k, (b, x) in enumerate(zip(blocks, features_of(blocks))) if not b[4] and decide(tree, x)]
    return " ".join(b[0] for b in blocks[called[0] : called[-1] + 1] if not b[4]) if called else ""


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", tree=None) -> DataFrame:
    """``pages`` without its html, with (text, n_chars): the article's blocks in order, joined by one space.

    Null and empty html, and pages without an article, give the empty text; null ids, null urls and repeated rows stay;
    an empty table gives an empty one. Columns of ``pages`` called text or n_chars are replaced.
    """
    small_batches(pages)
    tree = tree if tree is not None else learn_tree(pages.sparkSession)
    kept = pages.select(*(F.col(c) for c in pages.columns if c not in ("text", "n_chars") or c == html_col), F.coalesce(F.col(html_col), F.lit("")).alias("_html"))
    kept = kept.drop(html_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "_html")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), 256):
                part = frame.iloc[i : i + 256]
                text = [main_text(p, tree) for p in part["_html"]]
                yield part.drop(columns="_html").assign(text=text, n_chars=[len(t) for t in text])

    return kept.mapInPandas(run, f"{schema}, text string, n_chars long")
