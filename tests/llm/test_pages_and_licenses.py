import pytest
from pyspark.sql import functions as F

from frostline.llm import html_extraction as he
from frostline.llm import license_scan
from tests.llm.samples import descriptions, events, low

PAGE = """<!DOCTYPE html><html><head><title>Route 28 &amp; more</title><style>p{x:y}</style></head><body>
<header class="top"><a href="/">PennDOT</a></header><nav><ul><li><a href="/a">Districts</a></li><li><a href="/b">Plows</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this site to improve it for all of our visitors.</div>
<article><h1>Lane  restriction\n on Route&nbsp;28</h1><!-- <p>draft</p> -->
<p>Route 28 (Allegheny Valley Expressway) between <a href="/x">Etna</a> and Harmar is &#8220;Restricted&#8221; &lt;daily&gt;.
<p>Short one.</p><aside><p>Related: another release with many words to be read by all who came here.</p></aside>
<script>var t = "</p><p>not text</p>";</script><ul><li>Monday</li><li>Tuesday<br>night</li></ul>
<form><label>Mail</label><input name=q><button>Go</button></form>
<div id="comments"><p>I think that this closure is far too long for all of us who drive there.</p></div></article>
<div class="ad banner">Buy new tires today</div><footer>&copy; PennDOT, all rights reserved by the department</footer></body></html>"""
TEXT = ("Lane restriction on Route 28\nRoute 28 (Allegheny Valley Expressway) between Etna and Harmar is “Restricted” "
        "<daily>.\nShort one.\nMonday\nTuesday night")


def test_article_without_its_frame():
    assert he.main_text(PAGE, he.fit_tree()) == TEXT


def test_tree_knows_its_table():
    import numpy as np

    data = np.array(he.LABELLED, float)
    assert (he.classify(he.fit_tree(), data[:, :-1]) == (data[:, -1] == 1)).all()


@pytest.mark.parametrize("page, want", [
    ("", ""), ("<p>", ""), ("plain words without any markup at all", "plain words without any markup at all"),
    ("<article><p>cut in the mid", "cut in the mid"), ("<article><p>x &amp", "x &"), ("<article>a<b", "a"),
    ("<article><p>tag > with \"quotes\" < 5 and <a title='x>y'>z</a></article>", 'tag > with "quotes" < 5 and z'),
    ("<main><p>one<div class=sidebar>two</div>three</main>", "one\nthree"), ("<script>never closed", ""),
    ("<article><p hidden>gone</p><p style='display: none'>gone</p><p>stays</p></article>", "stays"),
])
def test_odd_pages(page, want):
    assert he.main_text(page, he.fit_tree()) == want


def test_pages_keep_their_columns(spark):
    long = "<article>" + "<p>Salt trucks are out.</p>" * 20000 + "</article>"
    rows = [("u1", PAGE, "a"), ("u2", None, "b"), (None, "", None), ("u1", PAGE, "a"), ("u3", long, "c")]
    df = spark.createDataFrame(rows, "url string, html string, text string").withColumn("odd.name", F.lit(1))
    got = he.release_texts(df)
    assert got.columns == ["url", "html", "odd.name", "text"]
    assert sorted(r["text"] for r in got.collect())[:2] == ["", ""] and got.where(F.col("text") == TEXT).count() == 2
    assert got.where("url = 'u3'").select(F.length("text")).first()[0] == 20000 * 21 - 1
    assert he.release_texts(df.where("false")).count() == 0


def places(text):
    import re

    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
    found = []
    for phrase, label in license_scan.BASE:
        p = phrase.split()
        found += [(at, label) for at in range(len(words) - len(p) + 1) if words[at:at + len(p)] == p]
    return len(words), sorted(found)


NOTICES = [
    (1, "Licensed under the Apache License, Version 2.0."), (2, "CC-BY cc by Cc By CC_BY"), (3, "MIT\nLicense mit licenses"),
    (4, "This is under the GNU General Public License, version 3. GNU Public License."), (5, "apache licenses mit-license"),
    (6, "Licensed under CC BY-NC 4.0. All rights reserved."), (7, "gnu général public license"), (8, None), (None, "MIT License"),
    (1, "Licensed under the Apache License, Version 2.0."), (9, "the mit license " * 5000),
    (10, "Permission is hereby granted, free of charge, to any one person obtaining a copy of this fine software and "
         "associated documentation files"),
    (11, "redistribution and use of roads in winter")]


PLAIN = [(50 + i, text) for i, text in descriptions()[:5]]


@pytest.fixture(scope="module")
def scanned(spark):
    df = events(spark, NOTICES + PLAIN)
    return license_scan.scan_licenses(df, "event_id", "description").collect()


def test_phrases_equal_a_loop(scanned):
    rows = NOTICES + PLAIN
    assert len(scanned) == len(rows)
    got = sorted((r["release_id"] is None, r["release_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"],
                  r["base_labels"]) for r in scanned)
    want = []
    for i, text in rows:
        n, found = places(text)
        starts = [at for at, _ in found]
        want.append((i is None, i, n, len(found), min(starts, default=None), max(starts, default=None),
                     ",".join(sorted({label for _, label in found}))))
    key = lambda r: (r[0], r[1] or 0, r[2])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_further_notices(scanned):
    labels = {r["release_id"]: r["labels"].split(",") for r in scanned}
    assert labels[6] == ["all-rights-reserved", "cc-by", "cc-by-nc"]
    assert "gpl-3" in labels[4] and "gpl-2" not in labels[4]
    assert labels[10] == ["mit-text"] and labels[11] == [""]
    scores = {r["release_id"]: r["score"] for r in scanned}
    assert scores[1] == 1 and scores[50] == 0 and 0.8 <= scores[10] < 1


def test_no_releases(spark):
    assert license_scan.scan_licenses(events(spark).where("false"), "event_id", "description").count() == 0


def test_only_the_fixed_table_is_broadcast(spark):
    df = license_scan.scan_licenses(events(spark), "event_id", "description")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") == 1 and "Python" not in plan
