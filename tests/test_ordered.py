import random

import numpy as np
import pandas as pd
import pytest

from frostline.operators import ordered, ranking


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    # One key holds most rows, and one value is repeated often.
    return [(0 if i % 3 else 1 + i % 4, round(rng.random(), 2) if i % 5 else 0.0, rng.random()) for i in range(1500)]


def test_percentiles_equal_numpy(spark, rows):
    df = spark.createDataFrame(rows, "k long, x double, y double")
    shares = {"a": 0.25, "b": 0.5, "c": 0.99, "d": 1.0}
    for col, at in (("x", 1), ("y", 2)):
        for r in ordered.exact_percentiles(df, ["k"], col, shares).collect():
            values = [row[at] for row in rows if row[0] == r.k]
            assert [r.a, r.b, r.c, r.d] == pytest.approx(list(np.percentile(values, [25, 50, 99, 100])), abs=1e-12)
    whole = ordered.exact_percentiles(df, [], "y", {"m": 0.5}).first()
    assert whole.m == pytest.approx(np.percentile([r[2] for r in rows], 50), abs=1e-12)


def test_running_totals(spark, rows):
    df = spark.createDataFrame(rows, "k long, x double, y double").groupBy("k", "x").count()
    got = {(r.k, r.x): (r.count_before, r.count_total) for r in ordered.running_totals(df, ["k"], "x", ["count"]).collect()}
    for (k, x), (before, total) in got.items():
        assert before == sum(1 for r in rows if r[0] == k and r[1] < x)
        assert total == sum(1 for r in rows if r[0] == k)
    down = {(r.k, r.x): r.count_before for r in ordered.running_totals(df, ["k"], "x", ["count"], descending=True).collect()}
    assert all(v == sum(1 for r in rows if r[0] == k and r[1] > x) for (k, x), v in down.items())


def test_spearman_equals_rank_correlation(spark, rows):
    df = spark.createDataFrame(rows, "k long, x double, y double")
    pdf = pd.DataFrame(rows, columns=["k", "x", "y"])
    for r in ordered.spearman(df, ["k"], "x", "y").collect():
        part = pdf[pdf.k == r.k]
        assert r.spearman == pytest.approx(part.x.rank().corr(part.y.rank()), abs=1e-9)
    flat = spark.createDataFrame([(1, 0.0, 1.0), (1, 0.0, 2.0)], "k long, x double, y double")
    assert ordered.spearman(flat, ["k"], "x", "y").first().spearman is None


def scored(spark, rows):
    return spark.createDataFrame(rows, "storm_id long, objectid long, risk_score double, prediction double, label_any_incident long")


def test_ranking_metrics_equal_loops(spark):
    rng = random.Random(9)
    rows = [(s, i, round(rng.random(), 1) if rng.random() < 0.4 else 0.0, round(rng.random() - 0.2, 2), int(rng.random() < 0.3))
            for s, n in ((1, 300), (2, 700), (3, 1), (4, 60)) for i in range(n)]
    rows += [(5, i, 0.0, 0.5, 0) for i in range(10)]
    got = {r.storm_id: r for r in ranking.storm_ranking_metrics(scored(spark, rows)).collect()}
    assert set(got) == {1, 2, 4, 5}
    for s, r in got.items():
        part = [(row[1], row[2], max(row[3], 0.0)) for row in rows if row[0] == s]
        by_pred = sorted(part, key=lambda t: (-t[2], t[0]))
        by_true = sorted(part, key=lambda t: (-t[1], t[0]))
        for k in (50, 200, 500):
            dcg = sum((2 ** t[1] - 1) / np.log2(i + 2) for i, t in enumerate(by_pred[:k]))
            ideal = sum((2 ** t[1] - 1) / np.log2(i + 2) for i, t in enumerate(by_true[:k]))
            assert r[f"ndcg_{k}"] == pytest.approx(dcg / ideal if ideal else 0.0)
        for k in (200, 500):
            n = min(k, len(part))
            hits = len({t[0] for t in by_pred[:n]} & {t[0] for t in by_true[:n]})
            assert r[f"recall_{k}"] == pytest.approx(hits / n)
    assert got[5].spearman is None and got[5].ndcg_50 == 0.0
    means = ranking.mean_ranking_metrics(ranking.storm_ranking_metrics(scored(spark, rows))).first()
    assert means.n_storms == 4


def test_truth_ranked_by_itself_is_perfect(spark):
    rows = [(1, i, i / 100, i / 100, 0) for i in range(100)]
    r = ranking.storm_ranking_metrics(scored(spark, rows)).first()
    assert r.ndcg_50 == 1.0 and r.recall_200 == 1.0 and r.spearman == pytest.approx(1.0)


def test_average_precision(spark):
    rng = random.Random(2)
    rows = [(1, i, 0.0, round(rng.random(), 1), int(rng.random() < 0.4)) for i in range(400)]
    total, seen, hits, area = sum(r[4] for r in rows), 0, 0, 0.0
    for level in sorted({r[3] for r in rows}, reverse=True):
        part = [r for r in rows if r[3] == level]
        seen, gained = seen + len(part), sum(r[4] for r in part)
        hits += gained
        area += gained / total * hits / seen
    got = ranking.binary_metrics(scored(spark, rows)).first()
    assert got.pr_auc == pytest.approx(area, abs=1e-6) and got.n_positive == total
    none = ranking.binary_metrics(scored(spark, [(1, 1, 0.0, 0.5, 0)])).first()
    assert (none.pr_auc, none.n_positive, none.recall_at_200) == (0.0, 0, 0.0)


def test_regression_metrics(spark):
    rows = [(1, 0, 0.9, 1.4, 0), (1, 1, 0.1, -0.3, 0), (1, 2, 0.6, 0.4, 0), (1, 3, 0.2, 0.7, 0)]
    y, p = np.array([0.9, 0.1, 0.6, 0.2]), np.array([1.0, 0.0, 0.4, 0.7])
    got = ranking.regression_metrics(scored(spark, rows)).first()
    assert got.rmse == pytest.approx(np.sqrt(np.mean((y - p) ** 2)), abs=1e-6)
    assert got.r2 == pytest.approx(1 - np.sum((y - p) ** 2) / np.sum((y - y.mean()) ** 2), abs=1e-6)
    assert (got.precision_at_05, got.recall_at_05, got.n_samples) == (0.5, 0.5, 4)


def test_sample_keeps_positives_and_split_keeps_storms(spark):
    rows = [(s, i, 0.5 if i < 30 else 0.0, 0.0, 0) for s in (1, 2) for i in range(100 * s)]
    kept = ranking.capped_sample(scored(spark, rows), per_storm=120).collect()
    for s, n in ((1, 100), (2, 120)):
        part = [r for r in kept if r.storm_id == s]
        assert len(part) == n and sum(r.risk_score > 0 for r in part) == 30
    storms = spark.createDataFrame([(i, "2023-24" if i % 5 == 0 else "2015-16") for i in range(50)], "storm_id long, season string")
    split = {r.storm_id: r.split for r in ranking.split_storms(storms).collect()}
    assert all((v == "test") == (k % 5 == 0) for k, v in split.items())
    assert sum(v == "val" for v in split.values()) == 4


def test_null_keys_keep_their_rows(spark):
    df = spark.createDataFrame([(None, 1.0, 1), (None, 3.0, 2), ("a", 2.0, 5)], "k string, v double, n long")
    got = {(r.k, r.v): (r.n_before, r.n_total) for r in ordered.running_totals(df, ["k"], "v", ["n"]).collect()}
    assert got == {(None, 1.0): (0, 3), (None, 3.0): (1, 3), ("a", 2.0): (0, 5)}


def test_large_cap_is_cut_in_parts_first(spark):
    plan = ranking.capped_sample(scored(spark, [(1, 1, 0.5, 0.0, 0)]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 2 and plan.index("_salt") > 0


def test_grades(spark):
    scores = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.0]
    df = ranking.relevance_grades(scored(spark, [(1, i, s, 0.0, 0) for i, s in enumerate(scores)]))
    assert [r.relevance for r in df.orderBy("objectid").collect()] == [0, 1, 1, 2, 3, 4, 0]
