"""Pages without marked article, odd tags, links over blocks, and blocks against the standard library's parser."""

import html as entities
import re
from html.parser import HTMLParser

import numpy as np
import pytest

from frostline.llm import html_extraction as he

TREE = he.fit_tree()
LONG = "Crews will close the ramp from Route 28 to the bridge so that the deck can be repaired before the snow comes again."


def text(page):
    return he.main_text(page, TREE)


def test_tree_asks_for_neighbours():
    used = {he.FEATURES[f] for f in TREE.feature if f >= 0}
    assert used & {"words_before", "words_after"} and used & {"density_before", "density_after"}
    assert {"words", "density", "framed", "held"} <= used


def test_tree_knows_its_table():
    data = np.array(he.LABELLED, float)
    assert (he.classify(TREE, data[:, :-1]) == (data[:, -1] == 1)).all()


def test_headings_and_short_sentences_stay_on_plain_pages():
    page = f"<body><h1>Storm closes two bridges</h1><p>{LONG}</p><p>Drive safely.</p><p>{LONG}</p><ul><li>Monday<li>Tuesday night</ul></body>"
    assert text(page) == f"Storm closes two bridges\n{LONG}\nDrive safely.\n{LONG}\nMonday\nTuesday night"
    assert text("<body><p>Bridge closed today.</p></body>") == "Bridge closed today."


def test_menus_go_on_plain_pages():
    menu = "".join(f"<li><a href=/{k}>{k}</a></li>" for k in ("Home", "News", "Plow tracker", "Contact us"))
    cards = "".join(f"<a href=/c{k}><div><h3>Card number {k}</h3><p>Read how crews salt the roads of the county</p></div></a>" for k in range(3))
    page = f"<body><ul>{menu}</ul><h1>Storm closes two bridges</h1><p>{LONG}</p><p>{LONG}</p><h3>More news</h3>{cards}<ul>{menu}</ul></body>"
    assert text(page) == f"Storm closes two bridges\n{LONG}\n{LONG}"


@pytest.mark.parametrize("page, want", [
    (f"<article><p title=it's>{LONG}</p><p>Two.</p><p title=that's>Three.</p></article>", f"{LONG}\nTwo.\nThree."),
    ("<article><p data-a=\"x>y\" b='p>q' c = \"d>e\">One</p></article>", "One"),
    ("<article><p>where <math><mi>x</mi><mo>=</mo><mn>5</mn></math> cm fell</p></article>", "where x=5 cm fell"),
    ("<article><p>a <math><semantics><mi>x</mi><annotation>\\alpha</annotation></semantics></math> b</p></article>", "a x b"),
    ("<article><p a=\"never closed>One</p></article>", "One"),
    (f"<body><form><h1>Storm closes two bridges</h1><p>{LONG}</p><p>{LONG}</p></form></body>", f"Storm closes two bridges\n{LONG}\n{LONG}"),
    (f"<article><p>{LONG}</p><form><p>Mail me the news of all closures every day</p></form><p>{LONG}</p></article>", f"{LONG}\n{LONG}"),
])
def test_odd_tags_and_wrappers(page, want):
    assert text(page) == want


def test_links_reach_over_blocks_to_their_end():
    found = he.blocks(f"<div><a href=x><div>one two</div><p>three</p></a><p>four five</p></div><div><a>six<p>seven</div><p>eight</p>")
    assert [(b.text, b.linked) for b in found] == [("one two", 2), ("three", 1), ("four five", 0), ("six", 1), ("seven", 1), ("eight", 0)]


class Plain(HTMLParser):
    """Block texts by the standard library's parser: the same elements end a block, raw ones hold no text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.raw, self.parts, self.out = [], [], []

    def close_block(self):
        joined = re.sub(r"\s+", " ", "".join(self.parts)).strip()
        if joined:
            self.out.append(joined)
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if self.raw:
            return
        if tag in he.RAW:
            if tag == "head":
                self.close_block()
            self.raw.append(tag)
        elif tag in ("br", "img", "input"):
            self.parts.append(" ")
        elif tag not in he.INLINE:
            self.close_block()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.raw:
            if tag == self.raw[-1]:
                self.raw.pop()
        elif tag not in he.INLINE:
            self.close_block()

    def handle_data(self, data):
        if not self.raw:
            self.parts.append(data)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_blocks_are_those_of_the_standard_parser(spark, sf):
    pages = [r["html"] for r in spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").select("html").collect() if r["html"]]
    assert pages
    for page in pages:
        parser = Plain()
        parser.feed(page)
        parser.close()
        parser.close_block()
        assert [b.text for b in he.blocks(page)] == parser.out
