"""Main text of web pages from flat text blocks (after Kohlschuetter, Fankhauser and Nejdl, 2010)."""

from __future__ import annotations

import html as entities
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from frostline.llm.columns import arrow_rows, given

# A quote opens a value only right after the equals sign, as browsers read tags; elsewhere it is a character like others.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[a-zA-Z/!?](?:[^>=]+|=\s*(?:"[^"]*"|'[^']*')|=)*+(?:>|\Z)""", re.S)
NAME = re.compile(r"</?\s*([a-zA-Z][a-zA-Z0-9:-]*)")
MARK = re.compile(r"""\s(class|id|role|hidden|style|aria-label)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
BLANK = re.compile(r"\s+")
# Elements by what they mean for text.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "annotation", "annotation-xml", "iframe", "object", "canvas", "select",
       "button", "datalist", "xmp", "noembed", "noframes", "audio", "video", "head"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i",
          "img", "input", "ins", "kbd", "label", "mark", "meter", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small",
          "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "link", "meta",
          "math", "mfrac", "mi", "mn", "mo", "mover", "mroot", "mrow", "mspace", "msqrt", "mstyle", "msub", "msubsup", "msup",
          "mtext", "munder", "munderover", "semantics"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
FRAME = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset"}
FORMS = {"form", "fieldset"}
MAIN = {"article", "main"}
FRAME_WORDS = {"nav", "navbar", "navigation", "menu", "header", "footer", "sidebar", "side", "aside", "widget", "ad", "ads",
               "adv", "advert", "adverts", "advertisement", "banner", "promo", "promotion", "sponsor", "sponsored", "cookie",
               "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "comment", "comments",
               "reply", "replies", "disqus", "share", "sharing", "social", "related", "recommended", "breadcrumb",
               "breadcrumbs", "newsletter", "subscribe", "subscription", "signup", "login", "search", "toolbar", "pagination",
               "pager", "tags", "skip", "copyright", "legal", "disclaimer", "complementary", "contentinfo", "dialog", "hidden",
               "respond", "form", "toc"}
# Parts that may stand beside frame words in a name. Others, as in has-sidebar or overflow-hidden, make it another name.
PLACE_WORDS = {"site", "page", "main", "global", "primary", "secondary", "left", "right", "top", "bottom", "upper", "lower",
               "list", "box", "bar", "area", "block", "links", "section", "inner", "posts", "buttons", "form", "the", "and"}
# Frame words that wrappers of whole pages bear too.
WRAP_WORDS = {"form", "search", "header", "side", "sidebar", "notice", "notices", "alert", "legal", "tags", "modal", "overlay"}
MAIN_WORDS = {"article", "content", "main", "post", "entry", "story", "body", "text"}


# How firmly a container frames the page.
NAMED, ELEMENT, HIDDEN = 1, 2, 3
# Start tags that end an open paragraph or item, as browsers read them.
ENDS_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "dd", "dt", "fieldset",
          "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "menu",
          "nav", "ol", "p", "pre", "section", "summary", "table", "ul"}
ENDS_ITEM = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr"}}
INSIDE_ITEM = {"p", "div", "address"}


class Block(NamedTuple):
    """A run of text without a block boundary, and where it stands.

    ``held`` is the share of the page's unlinked words that its form, or container with a name that wrappers of whole pages
    bear, holds: the smallest of them, 1 outside of all.
    """

    text: str
    words: int
    linked: int
    framed: bool
    main: bool
    heading: bool
    held: float = 1.0


#: What the tree may ask of a block. Density is the share of words inside links.
FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "framed", "main", "heading", "held")

#: The labelled table: FEATURES of a block but ``held``, which is 1, then 1 for main text and 0 for the rest.
UNWRAPPED = (
    # Articles: headings, long and short paragraphs, with the blocks around them.
    (9, 0.0, 6, 1.0, 80, 0.0, 0, 1, 1, 1), (6, 0.0, 12, 0.0, 45, 0.0, 0, 1, 1, 1), (4, 0.0, 90, 0.0, 70, 0.0, 0, 1, 1, 1),
    (80, 0.0, 9, 0.0, 60, 0.02, 0, 1, 0, 1), (60, 0.02, 80, 0.0, 3, 0.0, 0, 1, 0, 1), (3, 0.0, 60, 0.02, 120, 0.0, 0, 1, 0, 1),
    (120, 0.01, 3, 0.0, 14, 0.0, 0, 1, 0, 1), (14, 0.0, 120, 0.01, 8, 0.0, 0, 1, 0, 1), (1, 0.0, 40, 0.0, 9, 0.1, 0, 1, 0, 1),
    (7, 0.0, 30, 0.0, 10, 0.9, 0, 1, 0, 1), (25, 0.3, 60, 0.0, 60, 0.0, 0, 1, 0, 1), (5, 0.0, 11, 0.0, 0, 0.0, 0, 1, 0, 1),
    (2, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0, 1), (10, 0.4, 50, 0.0, 70, 0.0, 0, 1, 0, 1), (1, 1.0, 30, 0.0, 40, 0.0, 0, 1, 0, 1),
    # Short and linked blocks beside others of that kind are main text where the article is marked.
    (3, 0.0, 5, 1.0, 2, 0.0, 0, 1, 0, 1), (4, 0.0, 2, 1.0, 3, 1.0, 0, 1, 1, 1), (5, 0.8, 60, 0.0, 4, 1.0, 0, 1, 0, 1),
    (20, 0.7, 40, 0.0, 6, 1.0, 0, 1, 0, 1), (2, 0.0, 4, 0.0, 6, 0.5, 0, 1, 0, 1), (5, 0.0, 3, 0.0, 0, 0.0, 0, 1, 0, 1),
    (6, 0.5, 0, 0.0, 1, 1.0, 0, 1, 0, 1), (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 0, 1), (3, 1.0, 2, 1.0, 60, 0.0, 0, 1, 0, 1),
    (14, 0.9, 3, 1.0, 20, 0.8, 0, 1, 0, 1), (3, 0.0, 5, 1.0, 2, 0.0, 0, 1, 0, 1), (4, 0.0, 1, 1.0, 1, 1.0, 0, 1, 1, 1),
    # The same as the first without an element that marks the article.
    (9, 0.0, 5, 1.0, 70, 0.0, 0, 0, 1, 1), (70, 0.0, 9, 0.0, 55, 0.05, 0, 0, 0, 1), (55, 0.05, 70, 0.0, 18, 0.0, 0, 0, 0, 1),
    (18, 0.0, 55, 0.05, 40, 0.0, 0, 0, 0, 1), (40, 0.0, 18, 0.0, 4, 0.75, 0, 0, 0, 1), (12, 0.0, 60, 0.0, 60, 0.0, 0, 0, 0, 1),
    (30, 0.1, 0, 0.0, 0, 0.0, 0, 0, 0, 1), (22, 0.0, 1, 1.0, 25, 0.0, 0, 0, 0, 1), (6, 0.0, 45, 0.0, 50, 0.0, 0, 0, 0, 1),
    # Menus, link lists, notices, adverts and footers by their container, also where it lies in the article.
    (3, 0.0, 5, 1.0, 2, 0.0, 1, 1, 0, 0), (20, 0.7, 40, 0.0, 6, 1.0, 1, 1, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 1, 1, 0, 0),
    (5, 0.0, 3, 0.0, 0, 0.0, 1, 1, 0, 0), (80, 0.0, 70, 0.0, 90, 0.0, 1, 1, 0, 0), (9, 0.0, 6, 1.0, 80, 0.0, 1, 1, 1, 0),
    (1, 1.0, 0, 0.0, 1, 1.0, 1, 0, 0, 0), (1, 1.0, 1, 1.0, 12, 0.0, 1, 0, 0, 0), (12, 0.0, 1, 1.0, 9, 0.0, 1, 0, 0, 0),
    (15, 0.0, 80, 0.0, 0, 0.0, 1, 0, 0, 0), (40, 0.0, 60, 0.0, 30, 0.5, 1, 0, 0, 0), (60, 0.0, 12, 0.0, 25, 0.0, 1, 1, 0, 0),
    (8, 0.5, 70, 0.0, 5, 1.0, 1, 1, 0, 0), (3, 0.0, 50, 0.0, 40, 0.0, 1, 1, 1, 0), (120, 0.02, 40, 0.0, 30, 0.0, 1, 0, 0, 0),
    (2, 0.0, 10, 0.0, 0, 0.0, 1, 0, 1, 0), (25, 0.0, 90, 0.0, 80, 0.0, 1, 1, 0, 0), (7, 0.0, 1, 1.0, 60, 0.0, 1, 0, 1, 0),
    # The same without one: linked blocks among others of that kind, labels of link lists, what stands in menus.
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 0, 0), (3, 1.0, 2, 1.0, 60, 0.0, 0, 0, 0, 0), (5, 0.8, 60, 0.0, 4, 1.0, 0, 0, 0, 0),
    (14, 0.9, 3, 1.0, 20, 0.8, 0, 0, 0, 0), (4, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0), (3, 0.0, 5, 1.0, 2, 0.0, 0, 0, 0, 0),
    (6, 0.5, 0, 0.0, 1, 1.0, 0, 0, 0, 0), (20, 0.7, 40, 0.0, 6, 1.0, 0, 0, 0, 0), (2, 0.0, 1, 1.0, 1, 1.0, 0, 0, 1, 0),
    (2, 1.0, 0, 0.0, 3, 1.0, 0, 0, 1, 0), (4, 0.0, 1, 1.0, 1, 1.0, 0, 0, 1, 0), (9, 1.0, 7, 1.0, 9, 1.0, 0, 0, 0, 0),
    (2, 0.0, 50, 0.0, 6, 1.0, 0, 0, 1, 0), (1, 0.0, 60, 0.0, 4, 1.0, 0, 0, 0, 0), (2, 0.0, 1, 1.0, 3, 0.0, 0, 0, 0, 0),
    (1, 1.0, 40, 0.0, 2, 1.0, 0, 0, 0, 0), (8, 1.0, 12, 0.9, 0, 0.0, 0, 0, 0, 0), (3, 0.0, 0, 0.0, 1, 1.0, 0, 0, 0, 0),
    # Unlinked sentences and paragraphs whatever stands beside them.
    (22, 0.0, 1, 1.0, 22, 0.0, 0, 0, 0, 1), (12, 0.0, 3, 1.0, 10, 0.0, 0, 0, 0, 1), (8, 0.0, 1, 1.0, 9, 0.0, 0, 0, 1, 1),
    (30, 0.0, 2, 1.0, 1, 1.0, 0, 0, 0, 1), (15, 0.0, 1, 1.0, 1, 1.0, 0, 0, 0, 1), (10, 0.0, 5, 1.0, 4, 1.0, 0, 0, 0, 1),
    (40, 0.05, 9, 1.0, 12, 1.0, 0, 0, 0, 1), (7, 0.0, 2, 1.0, 20, 0.0, 0, 0, 0, 1), (18, 0.0, 0, 0.0, 1, 1.0, 0, 0, 0, 1),
    (9, 0.0, 0, 0.0, 2, 1.0, 0, 0, 0, 1), (75, 0.0, 1, 1.0, 3, 0.0, 0, 0, 0, 1), (26, 0.1, 14, 0.9, 2, 0.0, 0, 0, 0, 1),
    (11, 0.0, 60, 0.0, 1, 1.0, 0, 0, 0, 1), (16, 0.0, 6, 1.0, 0, 0.0, 0, 0, 0, 1), (50, 0.02, 80, 0.0, 5, 1.0, 0, 0, 0, 1),
    # Link lists between paragraphs and at the ends of a page.
    (2, 1.0, 60, 0.0, 1, 1.0, 0, 0, 0, 0), (1, 1.0, 2, 1.0, 45, 0.0, 0, 0, 0, 0), (7, 1.0, 30, 0.0, 8, 1.0, 0, 0, 0, 0),
    (11, 0.9, 9, 1.0, 50, 0.0, 0, 0, 0, 0), (4, 1.0, 5, 1.0, 0, 0.0, 0, 0, 0, 0), (12, 0.8, 0, 0.0, 10, 1.0, 0, 0, 0, 0),
    # Short blocks beside unlinked text, or alone on their page: headings, sentences, items, and a link between paragraphs.
    (4, 0.0, 0, 0.0, 60, 0.0, 0, 0, 1, 1), (4, 0.0, 1, 1.0, 60, 0.0, 0, 0, 1, 1), (5, 0.0, 70, 0.0, 55, 0.05, 0, 0, 0, 1),
    (3, 0.0, 90, 0.0, 0, 0.0, 0, 0, 0, 1), (2, 0.0, 0, 0.0, 40, 0.0, 0, 0, 1, 1), (5, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1),
    (1, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1), (4, 0.0, 30, 0.1, 35, 0.0, 0, 0, 1, 1), (3, 0.0, 60, 0.0, 3, 0.0, 0, 0, 0, 1),
    (3, 0.0, 2, 0.0, 4, 0.0, 0, 0, 0, 1), (1, 0.0, 3, 0.0, 2, 0.0, 0, 0, 0, 1), (2, 0.0, 4, 0.0, 0, 0.0, 0, 0, 0, 1),
    (5, 0.0, 50, 0.0, 3, 1.0, 0, 0, 0, 1), (4, 0.0, 80, 0.0, 6, 1.0, 0, 0, 0, 1), (6, 1.0, 45, 0.0, 50, 0.0, 0, 0, 0, 1),
    (2, 0.0, 1, 1.0, 30, 0.0, 0, 0, 1, 1), (5, 0.0, 12, 0.0, 9, 0.0, 0, 0, 0, 1), (3, 0.2, 20, 0.0, 14, 0.1, 0, 0, 0, 1),
)
#: Blocks in a form or a possible wrapper: FEATURES, and the label. One with most of the page's text wraps it; the others,
#: which hold a search field, a notice or a list, frame their blocks.
WRAPPED = (
    (80, 0.0, 70, 0.0, 90, 0.0, 0, 0, 0, 0.6, 1), (9, 0.0, 6, 1.0, 80, 0.0, 0, 0, 1, 0.9, 1), (30, 0.1, 80, 0.0, 3, 0.0, 0, 0, 0, 1.0, 1),
    (60, 0.0, 9, 0.0, 40, 0.0, 0, 1, 0, 0.7, 1), (4, 0.0, 60, 0.0, 50, 0.0, 0, 1, 0, 0.95, 1), (12, 0.0, 40, 0.0, 45, 0.0, 0, 0, 0, 0.55, 1),
    (9, 0.0, 6, 1.0, 80, 0.0, 0, 0, 1, 0.1, 0), (40, 0.0, 60, 0.0, 30, 0.5, 0, 0, 0, 0.3, 0), (60, 0.0, 12, 0.0, 25, 0.0, 0, 1, 0, 0.45, 0),
    (3, 0.0, 60, 0.0, 50, 0.0, 0, 1, 0, 0.02, 0), (25, 0.0, 90, 0.0, 80, 0.0, 0, 1, 0, 0.15, 0), (12, 0.0, 40, 0.0, 45, 0.0, 0, 0, 0, 0.2, 0),
    (2, 0.0, 0, 0.0, 40, 0.0, 0, 0, 1, 0.01, 0), (90, 0.0, 30, 0.0, 0, 0.0, 0, 0, 0, 0.4, 0),
)
LABELLED = tuple((*row[:-1], 1.0, row[-1]) for row in UNWRAPPED) + WRAPPED
DEPTH, LEAF = 8, 1


class Tree(NamedTuple):
    """Nodes of a decision tree; ``feature`` is -1 in leaves, whose answer is ``value``."""

    feature: np.ndarray
    limit: np.ndarray
    low: np.ndarray
    high: np.ndarray
    value: np.ndarray


def fit_tree(table=LABELLED, depth: int = DEPTH, leaf: int = LEAF) -> Tree:
    """Gini tree on the labelled table; ties go to the first feature and the lowest limit."""
    data = np.array(table, float)
    x, y = data[:, :-1], data[:, -1]
    nodes: list[list] = []

    def grow(rows: np.ndarray, level: int) -> int:
        at = len(nodes)
        share = y[rows].mean()
        nodes.append([-1, 0.0, 0, 0, float(share >= 0.5)])
        best = (share * (1 - share) * len(rows) - 1e-12, None)
        if level < depth and 0 < share < 1:
            for f in range(x.shape[1]):
                values = np.unique(x[rows, f])
                for cut in (values[1:] + values[:-1]) / 2:
                    side = x[rows, f] <= cut
                    sides = [y[rows[side]], y[rows[~side]]]
                    if min(map(len, sides)) >= leaf:
                        cost = sum(len(s) * s.mean() * (1 - s.mean()) for s in sides)
                        if cost < best[0] - 1e-9:
                            best = (cost, (f, cut))
        if best[1]:
            f, cut = best[1]
            side = x[rows, f] <= cut
            nodes[at][:2] = [f, cut]
            nodes[at][2] = grow(rows[side], level + 1)
            nodes[at][3] = grow(rows[~side], level + 1)
        return at

    grow(np.arange(len(y)), 0)
    return Tree(*map(np.array, zip(*nodes)))


def classify(tree: Tree, features: np.ndarray) -> np.ndarray:
    node = np.zeros(len(features), np.int64)
    while True:
        inner = np.flatnonzero(tree.feature[node] >= 0)
        if not len(inner):
            return tree.value[node] > 0.5
        at = node[inner]
        low = features[inner, tree.feature[at]] <= tree.limit[at]
        node[inner] = np.where(low, tree.low[at], tree.high[at])


def _named(name: str) -> tuple[bool, bool]:
    """Whether a whole name is that of a frame, and whether wrappers of whole pages bear it too."""
    parts = set(re.split(r"[^a-z]+", name)) - {""}
    found = parts & FRAME_WORDS
    frame = bool(found) and parts <= FRAME_WORDS | PLACE_WORDS
    return frame, frame and found <= WRAP_WORDS


def _marks(tag: str) -> tuple[int, bool, bool]:
    """How firmly attributes say that an element frames the page, whether it may wrap it, and whether it holds main text."""
    level, wraps, main = 0, False, False
    for name, value in MARK.findall(tag):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            level = HIDDEN
        elif name != "style":
            for frame, wrap in map(_named, [value] if name == "aria-label" else value.split()):
                if wrap:
                    wraps = True
                elif frame:
                    level = max(level, NAMED)
            main |= bool(set(re.split(r"[^a-z]+", value)) & MAIN_WORDS)
    return level, wraps, main


def _ended(open_: list[tuple], name: str) -> int:
    """Number of open elements that stay open when a start tag of this name ends a paragraph or item before it."""
    stay = len(open_)
    ends = ENDS_ITEM.get(name, ())
    for depth in range(len(open_) - 1 if ends else -1, -1, -1):
        of = open_[depth][0]
        if of in ends:
            stay = depth
            break
        if of not in INLINE and of not in INSIDE_ITEM and not (name == "tr" and of in ("td", "th")):
            break
    for depth in range(stay - 1 if name in ENDS_P else -1, -1, -1):
        if open_[depth][0] == "p":
            return depth
        if open_[depth][0] not in INLINE:
            break
    return stay


def _shares(found: list[Block], inside: list[tuple[int, ...]], forms: set[int]) -> list[Block]:
    """The blocks with the share of the page's unlinked words that their wrappers hold.

    On a page with marked main text outside of frames and wrappers, only forms may wrap it; other wrappers frame.
    """
    held: dict[int, int] = {}
    every, marked = 0, False
    for block, within in zip(found, inside):
        if not block.framed:
            every += block.words - block.linked
            marked |= block.main and not within
            for k in within:
                held[k] = held.get(k, 0) + block.words - block.linked
    share = {k: words / max(every, 1) for k, words in held.items()}
    return [b._replace(framed=b.framed or (marked and not forms.issuperset(within)),
                       held=min((share.get(k, 0.0) for k in within), default=1.0)) for b, within in zip(found, inside)]


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page in page order.

    A paragraph or item left open ends where the next begins, other unclosed or cut elements with what holds them. Forms,
    and names that wrappers of whole pages bear too, may wrap the page; what they hold of it is told. A link reaches over
    the blocks inside it, to its end or that of the element it stands in. An article or
    main element starts unframed, except in a hidden one; an article also stays framed in a frame's element, or by a
    frame's name within main text.
    """
    out: list[Block] = []
    inside: list[tuple[int, ...]] = []  # possible wrappers of each block
    open_: list[tuple[str, int, tuple[int, ...], bool]] = []  # element, framed, wrappers, main
    wrappers: tuple[int, ...] = ()
    forms: set[int] = set()
    n_wrappers = 0
    text: list[str] = []
    linked = links = link_depth = 0
    framed, main, heading = 0, False, False

    def close() -> None:
        nonlocal linked
        joined = BLANK.sub(" ", entities.unescape("".join(text))).strip()
        if joined:
            out.append(Block(joined, joined.count(" ") + 1, linked, framed > 0, main, heading))
            inside.append(wrappers)
        text.clear()
        linked = 0

    at, end = 0, len(page)
    while at < end:
        found = TAG.search(page, at)
        start = found.start() if found else end
        if start > at:
            part = page[at:start]
            text.append(part)
            if links:
                linked += len(part.split())
        if not found:
            break
        at, tag = found.end(), found.group()
        named = NAME.match(tag)
        if not named:
            continue
        name, ends = named.group(1).lower(), tag[1] == "/"
        if name in RAW and not ends:
            if name != "head":
                stop = re.compile(rf"</\s*{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = stop.end() if stop else end
            else:
                stop = re.compile(r"</\s*head\b[^>]*>|<\s*body\b", re.I).search(page, at)
                if stop:
                    at = stop.start() if stop.group().lower().lstrip("<").lstrip().startswith("body") else stop.end()
            continue
        if name in INLINE:
            if name == "a":
                links, link_depth = (0, 0) if ends else (1, len(open_))
            elif name in ("br", "img", "input"):
                text.append(" ")
            elif not ends and BLANK.search(tag) and any((marks := _marks(tag))[:2]):
                close()
                open_.append((name, framed, wrappers, main))
                framed = max(framed, marks[0] or NAMED)
            elif ends and open_ and open_[-1][0] == name:
                close()
                _, framed, wrappers, main = open_.pop()
            continue
        close()
        if not ends and (stay := _ended(open_, name)) < len(open_):
            _, framed, wrappers, main = open_[stay]
            del open_[stay:]
            links = links if len(open_) >= link_depth else 0
        heading = not ends and bool(re.fullmatch(r"h[1-6]", name))
        if name in VOID:
            continue
        if not ends:
            level, wraps, holds = _marks(tag) if BLANK.search(tag) else (0, False, False)
            open_.append((name, framed, wrappers, main))
            if name in MAIN:
                if framed < HIDDEN and (name == "main" or framed < (NAMED if main else ELEMENT)):
                    framed, wrappers = 0, ()
                framed, main = max(framed, level), True
            elif name not in ("html", "body"):
                if name in FRAME - FORMS or (name == "header" and not main):
                    level = max(level, ELEMENT)
                framed = max(framed, level)
                main = main or (holds and not level and not wraps)
            if (wraps or name in FORMS) and name not in ("html", "body"):
                wrappers += (n_wrappers,)
                if name in FORMS:
                    forms.add(n_wrappers)
                n_wrappers += 1
        else:
            for depth in range(len(open_) - 1, -1, -1):
                if open_[depth][0] == name:
                    _, framed, wrappers, main = open_[depth]
                    del open_[depth:]
                    links = links if len(open_) >= link_depth else 0
                    break
    close()
    return _shares(out, inside, forms)


def block_features(found: list[Block]) -> np.ndarray:
    """FEATURES of the blocks of one page."""
    words = np.array([b.words for b in found], float)
    density = np.minimum(np.array([b.linked for b in found], float) / words, 1.0)
    before, after = (lambda v: np.concatenate([[0.0], v[:-1]])), (lambda v: np.concatenate([v[1:], [0.0]]))
    flags = [np.array([getattr(b, k) for b in found], float) for k in ("framed", "main", "heading", "held")]
    return np.column_stack([words, density, before(words), before(density), after(words), after(density), *flags])


def main_text(page: str, tree: Tree) -> str:
    found = blocks(page)
    if not found:
        return ""
    keep = classify(tree, block_features(found))
    return "\n".join(b.text for b, k in zip(found, keep) if k)


def release_texts(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add ``text``, the main text of every press release page.

    Pages are cut into flat blocks at block elements; scripts, styles, comments and other raw elements hold no text. A
    decision tree fitted to the table ``LABELLED`` judges a block by its words and link density, those of its neighbours,
    whether its containers frame the page or hold the article, whether it is a heading, and how much of the page its
    wrappers hold. On pages that mark no article, the neighbours decide about short blocks. Kept blocks follow in page order, one
    line each; references are decoded, and white space inside a block becomes one space. Whole pages are read; nothing
    is cut or capped. A null page, an empty one, and one without main text give an empty text. A given column ``text``
    is replaced; all others stay; repeated rows are read each on its own; no row leaves its task.
    """
    tree = fit_tree()

    def extract(columns: list[pa.Array]) -> pa.Array:
        return pa.array([main_text(page, tree) for page in columns[-1].to_pylist()], pa.string())

    return arrow_rows(pages, {"page": given(html)}, T.StructField("text", T.StringType()), extract)
