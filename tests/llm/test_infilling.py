import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from frostline.llm import infilling as fim
from tests.llm.samples import descriptions, events


def by_hand(event_id, text, seed=1, percent=90, spm_percent=20):
    """The cut by plain slices."""
    digest = hashlib.sha256(f"{seed}:{'' if event_id is None else event_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    text = text or ""
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm_percent:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


EXTRA = [(700 + i, t) for i, t in enumerate(
    ["<P>", "a<S>b", "<", "<M", "P><S", "🙂é漢" * 30, "<<<>>>" * 9, "\n\n", "S><P", "x<M>", "\x00 null", "é" * 9])]


def test_descriptions_as_by_hand(spark):
    rows = descriptions() + EXTRA + [(None, None), (700, "<P>")]
    df = events(spark, rows).withColumn("infill", F.lit(1)).withColumn("form", F.lit(2))
    out = fim.fill_in_middle(df)
    assert sorted(out.columns) == sorted([*df.columns, "n_units", "prefix_chars", "middle_chars"])
    out = out.withColumn("back", fim.restored(F.col("infill"), F.col("form"))).collect()
    assert len(out) == len(rows)
    seen = set()
    for r in out:
        assert tuple(r[c] for c in ("n_units", "form", "prefix_chars", "middle_chars", "infill")) == by_hand(
            r["event_id"], r["description"])
        assert r["back"] == (r["description"] or "")
        seen.add(r["form"])
    assert seen == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(df.where("false")).count() == 0


def test_all_forms_on_request(spark):
    df = events(spark, EXTRA[5:8] * 3, clash=False)
    forms = {p: {r["form"] for r in fim.fill_in_middle(df, percent=p[0], spm_percent=p[1]).collect()}
             for p in ((0, 50), (100, 0), (100, 100))}
    assert forms == {(0, 50): {"plain"}, (100, 0): {"psm"}, (100, 100): {"spm"}}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=700), st.randoms(use_true_random=False))
def test_ranks_in_the_skip_list(widths, r):
    lanes = fim.unit_lanes(np.array(widths, np.int64))
    assert lanes.n_units == len(widths) and len(lanes.units[-1]) <= fim.STEP
    for rank in {0, len(widths), *[r.randint(0, len(widths)) for _ in range(20)]}:
        assert lanes.chars_at(rank) == sum(widths[:rank])


def test_few_links_are_passed():
    lanes = fim.unit_lanes(np.ones(100_000, np.int64))
    assert len(lanes.units) == 6
    assert [lanes.chars_at(k) for k in (0, 1, 8, 9, 99_999, 100_000)] == [0, 1, 8, 9, 99_999, 100_000]


@pytest.mark.parametrize("pattern, text, widths", [
    (r"\S+", "snow  on ramp", [4, 2, 2, 1, 4]), (r"\S+\s*", "snow  on ramp", [6, 3, 4]), (r"\X", "éa", [2, 1]),
    (r"[^\n]*\n?", "a\nbc\n", [2, 3]), (r"x", "abc", [3]), (r"x*", "", []), (fim.CODE_POINT, "a\n漢", [1, 1, 1])])
def test_other_units(pattern, text, widths):
    assert fim.unit_widths(text, pattern).tolist() == widths


def test_cuts_between_words(spark):
    rows = [(i, t) for i, t in descriptions() if t and i is not None]
    out = fim.fill_in_middle(events(spark, rows, clash=False), unit=r"\S+|\s+", percent=100).where("form <> 'plain'").collect()
    for r in out:
        for at in (r["prefix_chars"], r["prefix_chars"] + r["middle_chars"]):
            text = r["description"]
            assert at in (0, len(text)) or text[at - 1].isspace() != text[at].isspace()


@pytest.mark.parametrize("marks", [("<P>", "<P>", "<M>"), ("aba", "<S>", "<M>"), ("xy", "yz", "<M>"), ("", "<S>", "<M>"),
                                   ("<<P>", "<P>", "<M>")])
def test_marks_that_could_be_mistaken(spark, marks):
    with pytest.raises(ValueError):
        fim.fill_in_middle(events(spark, EXTRA[:1]), marks=marks)


def test_other_marks_go_back(spark):
    r, marks = random.Random(3), ("[pre]", "[suf]", "[mid]")
    rows = [(i, "".join(r.choice("[]presufmid") for _ in range(r.randint(0, 40)))) for i in range(200)]
    out = fim.fill_in_middle(events(spark, rows, clash=False), marks=marks, percent=100, spm_percent=50)
    back = fim.restored(F.col("infill"), F.col("form"), marks)
    assert out.where(back != F.col("description")).count() == 0
