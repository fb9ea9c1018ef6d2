"""Main text of web pages from flat text blocks and a decision tree.

A page is cut at block-level tags into a flat list of text blocks. A decision tree, trained here on
the small table ``LABELLED``, says from word counts and link densities of a block and of those before and
after it which blocks are main text; three marks of the markup help where these can't: whether the block
stands in a container that is boilerplate by its tag, or by a class, id or role of nothing but such words;
whether it stands in an article, or outside the page's articles; and whether it is a heading. A class
that marks a container in which the page's first article opens is a name of the layout and doesn't count.

Defined cases: a null or empty page has empty text; white space (of Unicode, so with
no-break spaces) inside a block becomes one space; a page cut short anywhere, tags left
open and end tags without a start are read as far as they go; page ids and urls may be
null and may repeat; other columns are ignored, whatever their names; an empty table
gives an empty result. No page is too long and no block too short.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: A comment, a declaration, or a tag with its attributes, where a quote opens a value only right
#: behind an equals sign; possessive, so that the time is linear.
MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)?+)*+)(?:>|\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/>]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")

RAW = frozenset("script style title textarea noscript iframe template xmp svg math select option button object canvas".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILERPLATE_TAGS = frozenset("nav aside footer menu dialog fieldset".split())
MAIN_TAGS = frozenset("article main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A class, id or role is boilerplate if all its words are such words, a part's name, or, in front, a place.
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent"
    " gdpr notice notices alert popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget widgets footer header"
    " masthead share sharing social related recommended newsletter subscribe subscription signup login search form toolbar pagination pager"
    " copyright disclaimer complementary contentinfo dialog".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist respond reply replies discussion disqus".split())
PART_WORDS = frozenset("area bar block box container inner item items links list panel section slot unit wrap wrapper".split())
PLACE_WORDS = frozenset("bottom global left main page primary right secondary site top".split())


class Block(NamedTuple):
    text: str
    words: int
    linked: int
    boilerplate: bool
    main: bool
    heading: bool


#: Words, link density; the same of the block before and after; in boilerplate; 1 in an article, -1 outside those
#: of the page, 0 where it has none; heading; main text or not.
LABELLED = [
    # paragraphs of articles, long and short, with and without links, and headings
    (120, 0.00, 80, 0.00, 95, 0.00, 0, 1, 0, 1),
    (45, 0.05, 120, 0.00, 60, 0.10, 0, 1, 0, 1),
    (3, 0.00, 60, 0.00, 90, 0.00, 0, 1, 0, 1),
    (1, 0.00, 1, 0.00, 1, 0.00, 0, 1, 0, 1),
    (12, 0.40, 30, 0.00, 4, 0.00, 0, 1, 0, 1),
    (6, 1.00, 40, 0.00, 40, 0.00, 0, 1, 0, 1),
    (9, 0.00, 8, 0.00, 50, 0.00, 0, 1, 1, 1),
    (5, 0.00, 6, 1.00, 2, 0.00, 0, 1, 1, 1),
    (2, 1.00, 1, 1.00, 30, 0.00, 0, 1, 1, 1),
    (300, 0.02, 0, 0.00, 0, 0.00, 0, 1, 0, 1),
    (18, 0.00, 10, 0.00, 12, 1.00, 0, 1, 0, 1),
    (4, 0.00, 90, 0.00, 8, 0.30, 0, 1, 0, 1),
    (4, 0.00, 3, 1.00, 2, 1.00, 0, 1, 0, 1),
    (8, 1.00, 0, 0.00, 30, 0.00, 0, 1, 0, 1),
    (1, 1.00, 25, 0.00, 3, 0.00, 0, 1, 0, 1),
    (30, 0.70, 4, 1.00, 60, 0.10, 0, 1, 0, 1),
    (16, 0.80, 40, 0.00, 20, 0.90, 0, 1, 0, 1),
    (11, 0.00, 6, 0.00, 1, 1.00, 0, 1, 0, 1),
    (2, 0.50, 14, 0.00, 9, 0.00, 0, 1, 0, 1),
    (5, 1.00, 9, 0.00, 7, 0.00, 0, 1, 0, 1),
    (3, 1.00, 4, 0.00, 2, 0.00, 0, 1, 0, 1),
    (2, 0.90, 30, 0.00, 0, 0.00, 0, 1, 0, 1),
    (9, 1.00, 1, 0.10, 10, 0.00, 0, 1, 0, 1),
    (4, 0.80, 15, 0.20, 4, 0.30, 0, 1, 0, 1),
    (1, 1.00, 2, 0.00, 1, 0.00, 0, 1, 0, 1),
    (3, 0.00, 2, 0.00, 4, 0.00, 0, 1, 0, 1),
    (2, 0.20, 8, 0.00, 3, 0.40, 0, 1, 0, 1),
    (7, 0.00, 1, 0.00, 0, 0.00, 0, 1, 0, 1),
    (40, 0.00, 2, 0.70, 3, 1.00, 0, 1, 0, 1),
    (26, 0.00, 5, 1.00, 1, 1.00, 0, 1, 0, 1),
    (70, 0.10, 1, 1.00, 4, 0.80, 0, 1, 0, 1),
    (2, 0.00, 3, 0.70, 12, 0.00, 0, 1, 0, 1),
    (6, 0.10, 2, 0.60, 2, 0.60, 0, 1, 0, 1),
    (15, 0.00, 4, 0.90, 0, 0.00, 0, 1, 0, 1),
    (24, 0.30, 30, 0.60, 25, 0.70, 0, 1, 0, 1),
    (1, 0.00, 1, 1.00, 3, 1.00, 0, 1, 0, 1),
    (9, 0.20, 7, 0.75, 40, 0.90, 0, 1, 0, 1),
    (3, 0.30, 2, 1.00, 1, 0.50, 0, 1, 0, 1),
    (55, 0.50, 6, 0.60, 8, 1.00, 0, 1, 0, 1),
    # menus inside articles that no tag or class gives away: short links beside links
    (3, 1.00, 2, 1.00, 4, 1.00, 0, 1, 0, 0),
    (2, 1.00, 1, 1.00, 60, 0.00, 0, 1, 0, 0),
    (4, 1.00, 80, 0.00, 3, 1.00, 0, 1, 0, 0),
    (5, 0.90, 3, 1.00, 2, 1.00, 0, 1, 0, 0),
    (1, 1.00, 1, 1.00, 1, 1.00, 0, 1, 0, 0),
    (2, 1.00, 3, 1.00, 0, 0.00, 0, 1, 0, 0),
    (7, 0.80, 6, 0.90, 5, 1.00, 0, 1, 0, 0),
    (1, 1.00, 12, 0.00, 1, 1.00, 0, 1, 0, 0),
    # menus, adverts, notices, forms, footers and comments in containers of their own, some inside articles
    (1, 1.00, 1, 1.00, 1, 1.00, 1, 0, 0, 0),
    (8, 0.00, 1, 1.00, 9, 0.00, 1, 0, 0, 0),
    (12, 0.00, 150, 0.00, 0, 0.00, 1, 0, 0, 0),
    (60, 0.00, 40, 0.00, 55, 0.00, 1, 0, 0, 0),
    (140, 0.00, 3, 0.00, 70, 0.00, 1, 0, 0, 0),
    (3, 0.00, 12, 0.00, 5, 0.00, 1, 0, 1, 0),
    (25, 0.10, 80, 0.00, 90, 0.00, 1, 1, 0, 0),
    (6, 0.50, 60, 0.00, 2, 1.00, 1, 1, 0, 0),
    (2, 0.00, 30, 0.00, 40, 0.00, 1, 1, 1, 0),
    (90, 0.00, 90, 0.00, 90, 0.00, 1, 1, 0, 0),
    (15, 0.90, 1, 1.00, 30, 0.00, 1, 0, 0, 0),
    (1, 0.00, 0, 0.00, 1, 0.00, 1, 1, 0, 0),
    (9, 0.00, 1, 1.00, 8, 0.00, 1, -1, 0, 0),
    (1, 1.00, 1, 1.00, 1, 1.00, 1, -1, 0, 0),
    (70, 0.00, 90, 0.00, 60, 0.00, 1, -1, 0, 0),
    # text beside the articles of a page
    (60, 0.00, 80, 0.00, 40, 0.00, 0, -1, 0, 0),
    (4, 0.00, 90, 0.00, 3, 1.00, 0, -1, 0, 0),
    (1, 0.00, 1, 0.00, 0, 0.00, 0, -1, 0, 0),
    (5, 1.00, 4, 1.00, 9, 0.00, 0, -1, 0, 0),
    (3, 0.00, 2, 1.00, 60, 0.00, 0, -1, 1, 0),
    (25, 0.10, 6, 0.00, 30, 0.00, 0, -1, 0, 0),
    (40, 0.00, 80, 0.00, 5, 0.00, 0, -1, 0, 0),
    (18, 0.00, 10, 0.00, 2, 0.00, 0, -1, 0, 0),
    (90, 0.00, 4, 0.00, 8, 0.10, 0, -1, 0, 0),
    (15, 0.00, 30, 0.00, 0, 0.00, 0, -1, 0, 0),
    (33, 0.10, 1, 1.00, 1, 1.00, 0, -1, 0, 0),
    (14, 0.00, 9, 0.00, 11, 0.00, 0, -1, 0, 0),
    (22, 0.00, 45, 0.10, 70, 0.00, 0, -1, 0, 0),
    (8, 0.00, 12, 0.00, 25, 0.00, 0, -1, 1, 0),
    # pages without an article: long runs of text
    (110, 0.00, 90, 0.00, 70, 0.00, 0, 0, 0, 1),
    (55, 0.08, 100, 0.00, 40, 0.05, 0, 0, 0, 1),
    (30, 0.10, 45, 0.00, 12, 0.00, 0, 0, 0, 1),
    (24, 0.00, 3, 0.00, 80, 0.00, 0, 0, 0, 1),
    (40, 0.20, 5, 1.00, 6, 0.00, 0, 0, 0, 1),
    (11, 0.00, 70, 0.00, 85, 0.00, 0, 0, 0, 1),
    (22, 0.00, 2, 0.00, 22, 0.00, 0, 0, 0, 1),
    (20, 0.00, 22, 0.00, 2, 1.00, 0, 0, 0, 1),
    (18, 0.10, 25, 0.00, 20, 0.00, 0, 0, 0, 1),
    (15, 0.00, 15, 0.00, 15, 0.00, 0, 0, 0, 1),
    (17, 0.20, 1, 1.00, 3, 0.00, 0, 0, 0, 1),
    (2, 0.00, 1, 1.00, 22, 0.00, 0, 0, 1, 1),
    (6, 0.00, 15, 0.00, 18, 0.00, 0, 0, 1, 1),
    (6, 0.00, 50, 0.05, 60, 0.00, 0, 0, 0, 1),
    (8, 0.00, 4, 0.50, 90, 0.00, 0, 0, 1, 1),
    (3, 0.00, 60, 0.00, 45, 0.00, 0, 0, 1, 1),
    (5, 0.00, 2, 1.00, 35, 0.00, 0, 0, 1, 1),
    (35, 0.00, 3, 1.00, 4, 1.00, 0, 0, 0, 1),
    (28, 0.10, 60, 0.00, 2, 1.00, 0, 0, 0, 1),
    (90, 0.00, 5, 0.70, 3, 0.90, 0, 0, 0, 1),
    (50, 0.30, 40, 0.60, 6, 1.00, 0, 0, 0, 1),
    (19, 0.00, 30, 0.00, 1, 1.00, 0, 0, 0, 1),
    # pages without an article: lists of links and scraps
    (2, 1.00, 2, 1.00, 2, 1.00, 0, 0, 0, 0),
    (6, 0.80, 3, 1.00, 5, 0.90, 0, 0, 0, 0),
    (25, 0.90, 4, 1.00, 6, 1.00, 0, 0, 0, 0),
    (40, 0.85, 20, 0.80, 10, 1.00, 0, 0, 0, 0),
    (4, 0.00, 3, 1.00, 2, 1.00, 0, 0, 0, 0),
    (7, 0.00, 5, 0.60, 4, 0.00, 0, 0, 0, 0),
    (9, 0.10, 6, 0.00, 3, 1.00, 0, 0, 0, 0),
    (3, 0.00, 4, 0.00, 2, 0.50, 0, 0, 0, 0),
    (10, 0.00, 2, 0.00, 1, 1.00, 0, 0, 0, 0),
    (4, 0.60, 80, 0.00, 2, 1.00, 0, 0, 0, 0),
    (3, 1.00, 3, 1.00, 40, 0.00, 0, 0, 0, 0),
    (2, 0.00, 1, 1.00, 3, 0.50, 0, 0, 1, 0),
    (2, 1.00, 80, 0.00, 0, 0.00, 0, 0, 0, 0),
    (3, 1.00, 22, 0.00, 0, 0.00, 0, 0, 0, 0),
    (5, 0.90, 60, 0.00, 30, 0.00, 0, 0, 0, 0),
    (12, 0.80, 40, 0.10, 50, 0.00, 0, 0, 0, 0),
    (3, 0.00, 50, 0.00, 0, 0.00, 0, 0, 0, 0),
    (5, 0.00, 90, 0.00, 0, 0.00, 0, 0, 0, 0),
]


class Tree:
    """A classification tree by Gini impurity; leaves are classes, of ``least`` rows or more."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, depth: int = 8, least: int = 3) -> None:
        self.split: tuple[int, float] | None = None
        self.label = int(labels.mean() >= 0.5)
        if depth == 0 or labels.min() == labels.max():
            return
        best = (self._impurity(labels) - 1e-12, -1, 0.0)
        for f in range(rows.shape[1]):
            values = np.unique(rows[:, f])
            for cut in (values[1:] + values[:-1]) / 2:
                left = rows[:, f] <= cut
                if min(left.sum(), (~left).sum()) >= least:
                    best = min(best, (self._impurity(labels[left]) + self._impurity(labels[~left]), f, float(cut)))
        if best[1] >= 0:
            self.split = best[1:]
            left = rows[:, best[1]] <= best[2]
            self.low, self.high = Tree(rows[left], labels[left], depth - 1, least), Tree(rows[~left], labels[~left], depth - 1, least)

    @staticmethod
    def _impurity(labels: np.ndarray) -> float:
        return 2 * len(labels) * labels.mean() * (1 - labels.mean())

    def predict(self, row: tuple) -> int:
        node = self
        while node.split is not None:
            node = node.low if row[node.split[0]] <= node.split[1] else node.high
        return node.label


@lru_cache(maxsize=1)
def tree() -> Tree:
    table = np.array(LABELLED, float)
    return Tree(table[:, :-1], table[:, -1])


def _names_boilerplate(value: str, is_id: bool, words: frozenset) -> bool:
    """Whether a token of a class, id or role consists of such words, so that ``has-sidebar`` isn't a sidebar."""
    for token in value.split():
        parts = [w.lower() for w in WORDS.findall(token)]
        while len(parts) > 1 and parts[0] in PLACE_WORDS:
            del parts[0]
        while is_id and len(parts) > 1 and parts[-1] in PLACE_WORDS:
            del parts[-1]
        if not words.isdisjoint(parts) and all(p in words or p in PART_WORDS for p in parts):
            return True
    return False


def _hints(tag: str, attributes: str, in_main: bool) -> int:
    """2: an element is boilerplate; 1: it is, unless the page's first article turns out to be inside; 0: nothing says so."""
    if tag in BOILERPLATE_TAGS or tag == "header" and not in_main:
        return 2
    found = 1 if tag == "form" else 0
    if not attributes or tag in ("html", "body"):
        return found
    words = COMMENT_WORDS if tag in MAIN_TAGS or in_main and tag in HEADINGS else BOILERPLATE_WORDS | COMMENT_WORDS
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role"):
            if _names_boilerplate(value, name == "id", words):
                found = 1
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
            return 2
    return found


class _Open:
    """The open elements of a page, found by tag at once however deep they are, and what each says of its text."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int]] = []  # tag, node
        self.places: dict[str, list[int]] = {}
        self.mains: list[int] = []
        # By node, in the order they open: the one around it, whether it says boilerplate, whether it is in an article.
        self.parent, self.own, self.main = [-1], [0], [False]
        self.doubtful: list[int] = []
        self.seen = False

    @property
    def node(self) -> int:
        return self.stack[-1][1] if self.stack else 0

    def push(self, tag: str, own: int, is_main: bool) -> None:
        if is_main and not self.seen:
            for n in self.doubtful:  # a class said so, but the page's main text is inside
                self.own[n] = 0
            self.doubtful.clear()
            self.seen = True
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in MAIN_TAGS:
            self.mains.append(len(self.stack))
        self.parent.append(self.node)
        self.main.append(self.main[self.node] or is_main)
        self.own.append(own)
        self.stack.append((tag, len(self.own) - 1))
        if own == 1:
            self.doubtful.append(len(self.own) - 1)

    def pop(self) -> None:
        tag, node = self.stack.pop()
        self.places[tag].pop()
        if tag in MAIN_TAGS:
            self.mains.pop()
        if self.doubtful and self.doubtful[-1] == node:
            self.doubtful.pop()

    def close(self, tag: str) -> bool:
        """Closes the innermost element of a tag and all inside it, unless that is around an open article."""
        at = self.places.get(tag)
        if not at or self.mains and at[-1] < self.mains[-1] and tag not in ("body", "html"):
            return False
        low = at[-1]
        while len(self.stack) > low:
            self.pop()
        return True

    def boilerplate(self) -> list[bool]:
        out = [False]
        for parent, own in zip(self.parent[1:], self.own[1:]):
            out.append(bool(own) or out[parent])
        return out


def blocks(page: str) -> list[Block]:
    """The text blocks of a page, in order."""
    found: list[tuple[str, int, int, int, bool]] = []
    text: list[str] = []
    linked: list[str] = []
    opened = _Open()
    links, heading, at = 0, False, 0

    def cut() -> None:
        words = html.unescape("".join(text)).split()
        if words:
            found.append((" ".join(words), len(words), len(html.unescape("".join(linked)).split()), opened.node, heading))
        text.clear()
        linked.clear()

    def say(part: str) -> None:
        text.append(part)
        if links:
            linked.append(part)

    while at < len(page):
        m = MARKUP.search(page, at)
        say(page[at : m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        ends, attributes = bool(m[1]), m[3] or ""
        if tag == "a":
            linked.append(" ")
            links = 0 if ends else 1
        elif tag == "br":
            say(" ")
        elif tag in RAW:
            if not ends and not attributes.endswith("/"):
                # What is inside isn't text of the page, whatever it looks like.
                raw_end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
                at = raw_end.end() if raw_end else len(page)
            say(" ")
        elif ends:
            if tag in BLOCKS:
                cut()
                links = 0
                heading = False
            elif opened.places.get(tag):
                cut()
            opened.close(tag)
        elif tag not in VOID or tag == "hr":
            block = tag in BLOCKS
            if block:
                cut()
                links = 0
                heading = tag in HEADINGS
                last = opened.stack[-1][0] if opened.stack else ""
                if last == "p" or last == tag and tag in ("li", "dd", "dt", "td", "th"):
                    opened.pop()
            own = _hints(tag, attributes, opened.main[opened.node])
            if tag != "hr" and (own or block and tag not in HEADINGS or opened.places.get(tag)):
                if not block:
                    cut()
                opened.push(tag, own, not own and (tag in MAIN_TAGS or "articleBody" in attributes))
            elif own:
                say(" ")
    cut()
    boilerplate = opened.boilerplate()
    return [Block(t, n, k, boilerplate[node], opened.main[node], h) for t, n, k, node, h in found]


def extract(page: str | None) -> str:
    """The main text of a page: its blocks of that class, joined by empty lines."""
    found = blocks(page) if page else []
    none = Block("", 0, 0, False, False, False)
    rule, kept = tree(), []
    beside = -1 if any(b.main and not b.boilerplate for b in found) else 0
    for before, b, after in zip([none, *found], found, [*found[1:], none]):
        near = [x for n in (b, before, after) for x in (n.words, n.linked / n.words if n.words else 0.0)]
        if rule.predict((*near, b.boilerplate, 1 if b.main else beside, b.heading)):
            kept.append(b.text)
    return "\n\n".join(kept)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars) for each row of ``pages``."""
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            texts = [extract(p) for p in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([*map(len, texts)], pa.int64())], ["id", "url", "text", "n"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    out = rows.mapInArrow(run, f"id {kinds[id_col]}, url {kinds[url_col]}, text string, n long")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.col("n").alias("n_chars"))
