import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from frostline.llm import language_model as lm
from frostline.llm import quality_classifier as qc
from tests.llm.samples import descriptions, events, low, sentence


@pytest.fixture(scope="module")
def marked(spark):
    r = random.Random(9)
    rows = [(i, sentence(r, r.randint(20, 120))) for i in range(160)]
    rows += [(500 + i, " ".join(w + r.choice(["###", " |", "&&&"]) for w in sentence(r, 60).split())) for i in range(40)]
    rows += [(700 + i, " ".join(w for w in sentence(r, 10).split() for _ in range(9))) for i in range(40)]
    marks = spark.createDataFrame([(i, int(i < 500)) for i, _ in rows] + [(None, 1), (3, 1), (4, None), (9999, 0)],
                                  "event_id long, useful int")
    return rows, marks


def test_held_out_descriptions_are_told_apart(spark, marked):
    rows, marks = marked
    df = events(spark, rows)
    model = qc.train_quality(df, marks.where("event_id % 5 <> 0"))
    got = {r["event_id"]: r["quality_score"] for r in qc.score_quality(df, model).where("event_id % 5 = 0").collect()}
    assert sum((p >= 0.3) == (i < 500) for i, p in got.items()) >= 0.97 * len(got)


def test_scores_follow_the_text_alone(spark, marked):
    rows, marks = marked
    model = qc.train_quality(events(spark, rows), marks)
    df = events(spark).withColumn("quality_score", F.lit("given"))
    got = qc.score_quality(df, model)
    assert got.columns == df.columns and got.count() == len(descriptions())
    by_text = {}
    for r in got.select("description", "quality_score").collect():
        assert 0 <= r["quality_score"] <= 1
        assert by_text.setdefault(r["description"] or "", r["quality_score"]) == r["quality_score"]
    assert qc.score_quality(df.where("false"), model).count() == 0


def test_sample_is_bounded_and_may_lack_a_side(spark, marked):
    rows, marks = marked
    df = events(spark, rows)
    none = qc.score_quality(df, qc.train_quality(df, marks.where("false"))).select("quality_score").distinct().collect()
    assert [r[0] for r in none] == [pytest.approx(0.5)]
    ones = qc.score_quality(df, qc.train_quality(df, marks.where("useful = 1"))).agg(F.min("quality_score")).first()[0]
    assert ones > 0.9
    assert qc.train_quality(df, marks, fit_rows=50).weights.any()


def test_hinge_fit_equals_its_optimum():
    """Dual and primal values meet on a small problem."""
    rng = np.random.default_rng(4)
    ratios = np.zeros(1 << qc.BITS)
    ratios[:30] = rng.normal(size=30)
    rows = [np.sort(rng.choice(30, 8, replace=False)) for _ in range(60)]
    labels = np.array([int(ratios[r].sum() > 0) for r in rows])
    w, b = qc.fit_hinge(rows, labels, ratios, epochs=300)
    sign = np.where(labels == 1, 1.0, -1.0)
    share = {s: (sign == s).sum() for s in (1.0, -1.0)}
    cost = np.array([len(rows) / (2 * share[s]) for s in sign])
    margins = np.array([qc.margin(r, ratios, w, b) for r in rows])

    def primal(w, b, margins):
        return 0.5 * (w @ w + b * b) + (cost * np.maximum(0, 1 - sign * margins)).sum()

    here = primal(w, b, margins)
    for _ in range(20):
        step = np.zeros_like(w)
        step[:30] = rng.normal(scale=0.02, size=30)
        moved = np.array([qc.margin(r, ratios, w + step, b) for r in rows])
        assert primal(w + step, b, moved) >= here - 1e-3


def test_grams_are_distinct_and_of_the_whole_text():
    texts = ["salt salt salt salt road", "", "a", "salt salt salt salt road " * 3000]
    lists = list(qc.gram_lists(pa.array(texts)))
    assert all(len(set(g.tolist())) == len(g) for g in lists) and len(lists[1]) == 0
    assert set(lists[0].tolist()) <= set(lists[3].tolist())


def toy(states=3, symbols=6, seed=1):
    rng = np.random.default_rng(seed)

    def rows(shape):
        v = rng.random(shape) + 0.05
        return v / v.sum(axis=-1, keepdims=True)

    return lm.Model(rows(states), rows((states, states)), rows((states, symbols)).T.copy())


def by_paths(model, seq):
    """Probability by all state paths, and expected counts."""
    from itertools import product

    k, out, total = len(model.first), lm.Model(*[np.zeros_like(a) for a in model]), 0.0
    for path in product(range(k), repeat=len(seq)):
        p = model.first[path[0]]
        for t, s in enumerate(path):
            p *= model.emits[seq[t], s] * (model.moves[path[t - 1], s] if t else 1)
        total += p
        out.first[path[0]] += p
        for t, s in enumerate(path):
            out.emits[seq[t], s] += p
            if t:
                out.moves[path[t - 1], s] += p
    return total, lm.Model(*[a / total for a in out])


def test_likelihood_and_counts_equal_all_paths():
    model, sequences = toy(), [np.array(s, np.int16) for s in ([0], [1, 2, 3, 4, 5, 0], [5, 5], [2, 1, 0, 3])]
    want = [by_paths(model, s) for s in sequences]
    assert np.allclose(lm.log_likelihoods(model, sequences), [math.log10(p) for p, _ in want])
    got = lm.expected_counts(model, sequences)
    for k, name in enumerate(lm.Model._fields):
        assert np.allclose(got[k], sum(c[k] for _, c in want)), name


def test_windows_count_every_symbol_once():
    sequences = [np.arange(n, dtype=np.int16) for n in (1, lm.WINDOW - 1, lm.WINDOW, lm.WINDOW + 1, 7 * lm.WINDOW + 5)]
    flat, start, length, lead, stop = lm.windows(sequences)
    counted = np.concatenate([np.arange(a + x, a + y) for a, x, y in zip(start, lead, stop)])
    assert sorted(counted) == list(range(len(flat))) and (lead == 0).sum() == len(sequences)
    assert (start + length <= len(flat)).all() and (stop <= length).all() and lead.max() == lm.MARGIN


def test_cuts_lose_no_transition(monkeypatch):
    model, rng = toy(), np.random.default_rng(4)
    sequences = [rng.integers(0, 6, n).astype(np.int16) for n in (1, 11, 12, 13, 40, 150)]
    whole = lm.expected_counts(model, sequences)
    monkeypatch.setattr(lm, "WINDOW", 12)
    cut = lm.expected_counts(model, sequences)
    assert math.isclose(cut.moves.sum(), sum(len(s) - 1 for s in sequences)) and math.isclose(cut.emits.sum(), sum(map(len, sequences)))
    for k, name in enumerate(lm.Model._fields):
        assert np.allclose(cut[k], whole[k], atol=1e-4), name


def test_passes_equal_a_loop_over_the_turns(spark, monkeypatch):
    """Over all partitions, with turns that hold no text; equal to the same steps on lists."""
    monkeypatch.setattr(lm, "TURNS", 7)
    rng = np.random.default_rng(2)
    halves = [np.concatenate([rng.integers(0, 5, 30), rng.integers(5, 10, 30)]).astype("<i2") for _ in range(40)]
    rows = [7 * i + i % 5 for i in range(40)]  # turns 5 and 6 are empty
    df = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in zip(rows, halves)], "row long, symbols binary").repartition(3)
    shares = np.full(10, 0.1)
    want = lm.opening_model(shares, 2)
    ends = [lm.log_likelihoods(want, halves).sum()]
    for turn in range(5):
        want = lm.updated(lm.expected_counts(want, [s for i, s in zip(rows, halves) if i % 7 == turn]), shares)
    for _ in range(2):
        want = lm.updated(lm.expected_counts(want, halves), shares)
    got = lm.baum_welch(df, shares, 2, 2)
    assert all(np.allclose(a, b) for a, b in zip(got, want))
    assert lm.log_likelihoods(got, halves).sum() > ends[0]


@pytest.fixture(scope="module")
def scored(spark):
    df = events(spark).withColumn("train", F.when(F.col("event_id") == 2, F.lit(None)).otherwise(F.col("event_id") % 3 != 0))
    return lm.language_scores(df, "train", states=3, passes=2).collect()


def test_base_score_equals_a_loop(scored):
    rows = descriptions()
    tokens = [[*[w.lower() for w in low(t).encode().split()], b""] for _, t in rows]
    train = [i is not None and i != 2 and i % 3 != 0 for i, _ in rows]
    c = Counter(w for words, t in zip(tokens, train) if t for w in words)
    n, v = sum(c.values()), len(c)
    want = sorted((i if i is not None else -1, len(w), sum(c[x] > 0 for x in w), n,
                   round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 4)) for (i, _), w in zip(rows, tokens))
    got = sorted((r["event_id"] if r["event_id"] is not None else -1, r["n_tokens"], r["n_known"], r["train_tokens"],
                  round(r["base_score"], 4)) for r in scored)
    assert got == want
    assert all(r["score"] < 0 for r in scored)


def test_counts_beyond_the_held_words_are_joined(spark, scored, monkeypatch):
    monkeypatch.setattr(lm, "COUNTED", 40)
    monkeypatch.setattr(lm, "LEXICON", 20)
    df = events(spark).withColumn("train", F.when(F.col("event_id") == 2, F.lit(None)).otherwise(F.col("event_id") % 3 != 0))
    few = lm.language_scores(df, "train", states=3, passes=1).collect()
    key = lambda r: (r["event_id"] or -1, r["n_tokens"], r["n_known"], round(r["base_score"], 4))
    assert sorted(map(key, few)) == sorted(map(key, scored))


def test_no_training_rows_and_no_rows(spark):
    df = events(spark, [(1, "salt on the road"), (2, None)]).withColumn("train", F.lit(False))
    got = {r["event_id"]: r for r in lm.language_scores(df, "train", states=2, passes=1).collect()}
    assert got[1]["n_known"] == 0 and got[1]["train_tokens"] == 0 and got[1]["base_score"] == 0 and got[2]["n_tokens"] == 1
    assert lm.language_scores(df.where("false"), "train", states=2, passes=1).count() == 0
