import random

import pytest
from pyspark.sql import functions as F

from frostline.functions import geo
from frostline.operators import graph, lookup, ordered, spatial


@pytest.fixture
def low_bounds(monkeypatch):
    monkeypatch.setattr(lookup, "HOT_KEYS", 10)
    monkeypatch.setattr(lookup, "HOT_ROWS", 5)


def rows_of(spark, hot):
    r = random.Random(4)
    keys = [7] * hot + [r.randint(0, 60) for _ in range(120)] + [None, None, 999]
    return spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k int, row int")


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("hot", [0, 300])
def test_lookup_equals_a_join(spark, low_bounds, how, hot):
    rows = rows_of(spark, hot)
    table = spark.createDataFrame([(k, k * 10, f"v{k}") for k in range(50) if k != 7 or hot % 7], "k int, ten int, name string")
    got = lookup.lookup(rows, table, ["k"], how)
    want = rows.join(table, ["k"], how)
    assert got.columns == want.columns and sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


def test_a_hot_key_without_a_table_row(spark, low_bounds):
    rows = spark.createDataFrame([(1, i) for i in range(200)] + [(2, 0)], "k int, row int")
    table = spark.createDataFrame([(2, "b")], "k int, name string")
    assert lookup.lookup(rows, table, ["k"]).where("name is null").count() == 200
    assert [tuple(r) for r in lookup.lookup(rows, table, ["k"], "inner").collect()] == [(2, 0, "b")]


def test_hot_rows_are_not_shuffled(spark, low_bounds):
    rows = spark.createDataFrame([(1, i) for i in range(500)], "k int, row int")
    got = lookup.lookup(rows, spark.createDataFrame([(1, "a")], "k int, name string"), ["k"])
    spread = got.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in spread) == 500 and len(spread) > 1


def loop_components(nodes, edges):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {n: root(n) for n in nodes}


def test_components_with_hubs(spark, low_bounds):
    """Stars around the lowest, the highest and a middle node, a path, and chance links."""
    r = random.Random(6)
    edges = [(0, k) for k in range(1, 80)] + [(500, k) for k in range(420, 499)] + [(250, k) for k in range(220, 300) if k != 250]
    edges += [(k, k + 1) for k in range(600, 700)] + [(r.randint(700, 900), r.randint(700, 900)) for _ in range(90)] + [(5, 5)]
    names = list(range(901))
    text = {k: f"n{k:04d}" for k in names}
    nodes = spark.createDataFrame([(text[k],) for k in names], "node string")
    df = spark.createDataFrame([(text[a], text[b]) for a, b in edges], "src string, dst string")
    got = {row["node"]: row["component"] for row in graph.components(nodes, df).collect()}
    assert got == {text[k]: text[v] for k, v in loop_components(names, edges).items()}


def test_rank_correlation_with_a_hot_value(spark, low_bounds):
    import pandas as pd

    r = random.Random(3)
    rows = [(k % 2, r.choice([0.0] * 9 + [r.random()]), r.choice([0.0, 0.5, r.random()])) for k in range(400)]
    df = spark.createDataFrame(rows, "storm_id int, x double, y double")
    got = {row["storm_id"]: row["spearman"] for row in ordered.spearman(df, ["storm_id"], "x", "y").collect()}
    frame = pd.DataFrame(rows, columns=["storm_id", "x", "y"])
    for storm, part in frame.groupby("storm_id"):
        ranks = part[["x", "y"]].rank()
        assert got[storm] == pytest.approx(ranks["x"].corr(ranks["y"]))


def test_boxes_of_all_sizes_meet_lines_of_all_sizes(spark):
    r = random.Random(12)
    cell = geo.GRID_DEGREES * 8

    def box(k):
        size = cell * 2.0 ** r.randint(-3, 9)
        x, y = -80 + r.uniform(-1, 1), 40 + r.uniform(-1, 1)
        return k, x, y, x + size * r.random(), y + size * r.random()

    lines = [box(k) for k in range(120)] + [(200, -80.0, 40.0, -80.0, 40.0), (201, -80.0, 40.0, -80.0 + cell, 40.0 + cell),
                                            (202, None, None, None, None)]
    boxes = [box(k) for k in range(60)] + [(300, -90.0, 30.0, -70.0, 50.0), (301, -80.0, 40.0, -80.0, 40.0)]
    left = spark.createDataFrame(lines, "objectid int, min_lng double, min_lat double, max_lng double, max_lat double")
    right = spark.createDataFrame(boxes, "box_id int, box_min_lng double, box_min_lat double, box_max_lng double, box_max_lat double")
    want = sorted((b[0], a[0]) for a in lines for b in boxes if a[1] is not None
                  and a[3] >= b[1] and a[1] <= b[3] and a[4] >= b[2] and a[2] <= b[4])
    for limit in (None, 50):
        got = spatial.bbox_overlap(left, right, pairs_per_task=limit)
        assert sorted((row["box_id"], row["objectid"]) for row in got.collect()) == want
    assert len({w for w in want if w[0] == 300}) == 122


def test_a_wide_box_is_no_cross_join(spark):
    """A box over the whole region meets the lines by an equi-join."""
    lines = spark.createDataFrame([(k, -80.0 + k / 1e4, 40.0, -80.0 + k / 1e4, 40.0) for k in range(50)],
                                  "objectid int, min_lng double, min_lat double, max_lng double, max_lat double")
    wide = spark.createDataFrame([(1, -81.0, 39.0, -79.0, 41.0)],
                                 "box_id int, box_min_lng double, box_min_lat double, box_max_lng double, box_max_lat double")
    got = spatial.bbox_overlap(lines, wide)
    assert got.count() == 50
    plan = got._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
