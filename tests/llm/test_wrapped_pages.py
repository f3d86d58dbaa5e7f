import pytest

from frostline.llm import html_extraction as he

FIRST = "Crews salt the parkway and all of its ramps from four in the morning until the snow has ended in the county tonight."
SECOND = "Drivers should allow more time and leave room for the plows which cannot pass stopped cars on narrow city streets."
BODY = f"<p>{FIRST}</p><p>{SECOND}</p>"
TEXT = f"{FIRST}\n{SECOND}"
NAV = '<nav><ul><li><a href="/a">Roads</a><li><a href="/b">Plows</a></ul></nav>'


@pytest.mark.parametrize("page", [
    f'<div class="page has-sidebar">{BODY}</div>', f'<div class="container overflow-hidden"><article>{BODY}</article></div>',
    f'<div class="no-sidebar">{NAV}<div id="content">{BODY}</div></div>',
    f'<form id="aspnetForm" action="x">{NAV}<div class="wrap">{BODY}</div></form>',
    f'<form action="x">{NAV}<main>{BODY}</main><div class="cookie-notice">We use cookies on this site for all.</div></form>',
    f'<div class="sidebar"><article>{BODY}</article></div>', f'<div class="ads"><main>{BODY}</main></div>',
    f'<div class="search">{BODY}</div>', f'<article><form action="x">{BODY}</form></article>',
    f'<p class="ad">Buy new tires today<p>{FIRST}<p>{SECOND}',
    f'<article><ul><li class="widget">Buy tires<li>{FIRST}<li>{SECOND}</ul></article>',
    f'<p class="ad">Buy new tires today<div>{BODY}</div>', f'<div\nclass="ads">Buy new tires</div><article>{BODY}</article>',
])
def test_wrappers_do_not_take_the_article(page):
    assert he.main_text(page, he.fit_tree()) == TEXT


@pytest.mark.parametrize("frame", [
    '<div class="sidebar">{}</div>', '<div class="site-footer">{}</div>', '<div id="comments"><article>{}</article></div>',
    '<aside><article>{}</article></aside>', '<form action="x">{}</form>', '<div hidden><main>{}</main></div>',
    '<div role="navigation">{}</div>', '<section aria-label="Main menu">{}</section>', '<ul class="related posts"><li>{}</ul>',
])
def test_frames_beside_the_article_are_left_out(frame):
    other = frame.format("Another release with many more words to be read by all who came here for it.")
    assert he.main_text(f"<main>{BODY}{other}</main>", he.fit_tree()) == TEXT
