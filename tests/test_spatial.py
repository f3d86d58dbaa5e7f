import math
import random

import pytest

from frostline.operators import spatial

LNG_M = 111320 * math.cos(math.radians(40.44))


def planar(a, b):
    return math.hypot((a[0] - b[0]) * 111320, (a[1] - b[1]) * LNG_M)


def sphere(a, b):
    p1, p2 = math.radians(a[0]), math.radians(b[0])
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371000 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def scatter(n, seed, lat=40.4, lng=-80.0, width=0.02):
    rng = random.Random(seed)
    return [(i, lat + rng.random() * width, lng + rng.random() * width) for i in range(n)]


def points(spark, rows):
    return spark.createDataFrame(rows, "pid long, lat double, lng double")


def places(spark, rows):
    return spark.createDataFrame(rows, "objectid long, mid_lat double, mid_lng double")


@pytest.mark.parametrize("metric,distance,lat", [("planar", planar, 40.4), ("sphere", sphere, 40.4), ("sphere", sphere, -0.01),
                                                 ("sphere", sphere, 78.0)])
@pytest.mark.parametrize("limit", [None, 3])
def test_pairs_equal_brute_force(spark, metric, distance, lat, limit):
    # A third of the points share one cell; a small limit forces that cell to be divided.
    a = scatter(120, 1, lat) + [(1000 + i, lat + 0.01 + i * 1e-6, -79.99) for i in range(60)]
    b = scatter(80, 2, lat) + [(500, lat + 0.01, -79.99)]
    got = spatial.pairs_within(points(spark, a), places(spark, b), 150.0, metric=metric, pairs_per_task=limit)
    want = {(p[0], q[0]) for p in a for q in b if distance(p[1:], q[1:]) <= 150.0}
    rows = [(r.pid, r.objectid) for r in got.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == want


def test_missing_positions_match_nothing(spark):
    got = spatial.pairs_within(points(spark, [(1, None, -80.0), (2, 40.0, None)]), places(spark, [(1, 40.0, -80.0)]), 100.0)
    assert got.count() == 0


def test_counts_and_flags(spark):
    base, target = scatter(50, 3), scatter(200, 4) + [(900, 40.41, -79.99)] * 30
    df = spatial.radius_count(places(spark, base), points(spark, target), 200.0, "n", target_at=("lat", "lng"))
    got = {r.objectid: r.n for r in df.collect()}
    assert got == {b[0]: sum(planar(b[1:], t[1:]) <= 200 for t in target) for b in base}
    many = spatial.radius_flags(places(spark, base + [(77, None, None)]), {
        "near": points(spark, target[:20]), "none": points(spark, [])}, 100.0, target_at=("lat", "lng"))
    for r in many.collect():
        where = dict((b[0], b[1:]) for b in base).get(r.objectid)
        assert r.near == (where is not None and any(planar(where, t[1:]) <= 100 for t in target[:20]))
        assert r.none is False


def test_nearest_takes_lowest_id_on_ties_and_respects_cutoff(spark):
    base = places(spark, [(1, 40.0, -80.0), (2, 41.0, -80.0), (3, None, None)])
    target = points(spark, [(9, 40.0005, -80.0), (4, 39.9985, -80.0), (6, 40.0005, -80.0), (5, 41.002, -80.0)])
    got = {r.objectid: r.pid for r in spatial.nearest_join(base, target, 100.0, "pid", ["pid"], target_at=("lat", "lng")).collect()}
    assert got == {1: 6, 2: None, 3: None}
    a, b = scatter(60, 5), scatter(300, 6)
    want = {}
    for p in a:
        best = min(((planar(p[1:], q[1:]), q[0]) for q in b))
        want[p[0]] = best[1] if best[0] <= 100 else None
    for first in (None, 20.0):
        df = spatial.nearest_join(places(spark, a), points(spark, b), 100.0, "pid", ["pid"], target_at=("lat", "lng"),
                                  first_radius_m=first)
        assert {r.objectid: r.pid for r in df.collect()} == want


def test_first_area_by_order(spark):
    slopes = spark.createDataFrame([(1, 40.0003, -80.0, 7.0), (0, 40.0004, -80.0, 9.0), (2, 41.0, -80.0, 1.0)],
                                   "o long, lat double, lng double, area double")
    df = spatial.radius_flag(places(spark, [(1, 40.0, -80.0), (2, 42.0, -80.0)]), slopes, 50.0, "flag",
                             target_at=("lat", "lng"), metric="sphere", carry=("area", "o"))
    assert {(r.objectid, r.flag, r.area) for r in df.collect()} == {(1, True, 9.0), (2, False, None)}


def test_box_overlap(spark):
    rng = random.Random(8)
    lines, boxes = [], []
    for i in range(60):
        x, y = -80 + rng.random() * 0.1, 40 + rng.random() * 0.1
        lines.append((i, x, y, x + rng.random() * 0.05, y + rng.random() * 0.05))
    for i in range(20):
        x, y = -80 + rng.random() * 0.1, 40 + rng.random() * 0.1
        boxes.append((i, x, y, x + rng.random() * 0.05, y + rng.random() * 0.05))
    got = spatial.bbox_overlap(
        spark.createDataFrame(lines, "id long, min_lng double, min_lat double, max_lng double, max_lat double"),
        spark.createDataFrame(boxes, "box_id long, box_min_lng double, box_min_lat double, box_max_lng double, box_max_lat double"))
    rows = [(r.box_id, r.id) for r in got.collect()]
    want = {(b[0], m[0]) for b in boxes for m in lines if m[3] >= b[1] and m[1] <= b[3] and m[4] >= b[2] and m[2] <= b[4]}
    assert len(rows) == len(set(rows)) and set(rows) == want


@pytest.mark.parametrize("n_points, n_places", [(2, 900), (900, 2), (300, 300), (1, 1)])
def test_crowded_cells_are_cut_on_both_sides(spark, n_points, n_places):
    from pyspark.sql import functions as F

    def cell(n):
        return spark.range(n).select(F.lit(1).alias("_cx"), F.lit(1).alias("_cy"), F.col("id"))

    left, right = spatial._divide_crowded(cell(n_points), cell(n_places).withColumnRenamed("id", "other"), 400)
    pairs = left.join(right, ["_cx", "_cy", "_salt"])
    assert pairs.count() == pairs.distinct().count() == n_points * n_places
    assert pairs.groupBy("_salt").count().agg(F.max("count")).first()[0] <= 1000
    assert left.count() + right.count() <= n_points + n_places + 2 * n_points * n_places / 20 + 20


def test_copied_rows_are_not_sent_through_the_driver(spark):
    # Small as stored, nine times larger as joined: both sides are to be shuffled by cell.
    pairs = spatial.pairs_within(points(spark, scatter(20, 11)), places(spark, scatter(20, 12)), 100.0)
    lines = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0)], "id long, min_lng double, min_lat double, max_lng double, max_lat double")
    boxes = lines.toDF("box_id", "box_min_lng", "box_min_lat", "box_max_lng", "box_max_lat")
    for df in (pairs, spatial.bbox_overlap(lines, boxes)):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin [_" in plan


@pytest.mark.parametrize("metric, distance", [("planar", planar), ("sphere", sphere)])
def test_nearest_meets_few_targets_however_dense_they_are(spark, monkeypatch, metric, distance):
    base, targets = scatter(150, 13, width=0.004), scatter(3000, 14, width=0.003)
    rows = []
    whole = spatial.pairs_within

    def counted(*args, **kwargs):
        pairs = whole(*args, **kwargs)
        rows.append(pairs.count())
        return pairs

    monkeypatch.setattr(spatial, "pairs_within", counted)
    df = spatial.nearest_join(places(spark, base), points(spark, targets + [(-1, None, -80.0)]), 200.0, "pid", ["pid"], target_at=("lat", "lng"),
                              metric=metric)
    want = {}
    for b in base:
        best = min((distance(b[1:], t[1:]), t[0]) for t in targets)
        want[b[0]] = best[1] if best[0] <= 200 else None
    assert {r.objectid: r.pid for r in df.collect()} == want
    assert sum(rows) < 60 * len(base)


@pytest.mark.parametrize("limit", [None, 40])
def test_sums_around_places_shuffle_no_pairs(spark, limit):
    from pyspark.sql import functions as F

    here = scatter(60, 15, width=0.006) + [(1000 + i, 40.403, -79.997) for i in range(20)]
    there = [(i % 3, *rest) for i, *rest in scatter(400, 16, width=0.006)] + [(1, None, -80.0)]
    options = {} if limit is None else {"pairs_per_task": limit}
    kind = spark.createDataFrame(there, "kind long, lat double, lng double").withColumn("n", F.lit(2).cast("bigint"))
    for twice in (False, True):
        base = here + [(0, 40.4031, -79.9971)] * twice + [(None, 40.402, -79.998), (None, 40.4021, -79.998)] * twice
        df = spatial.sums_within(kind, places(spark, base), 200.0, "objectid", ["kind"], {"n": F.sum}, **options)
        want = {}
        for b in base:
            for t in there[:-1]:
                if planar(b[1:], t[1:]) <= 200:
                    want[b[0], t[0]] = want.get((b[0], t[0]), 0) + 2
        got = [((r.objectid, r.kind), r.n) for r in df.collect()]
        assert len(got) == len(want) and dict(got) == want
        if not twice:
            plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
            assert "Exchange" not in plan.split("SortMergeJoin")[0]


@pytest.mark.parametrize("limit", [None, 5])
def test_nearest_rows_of_clusters(spark, limit):
    # Clusters of targets, some at one position and one without an id; points without a target in reach are left out.
    rng = random.Random(9)
    b = [(i, 40.4 + (i % 4) * 0.002 + rng.random() * 1e-4, -80.0 + (i % 3) * 0.003) for i in range(240)] + [(None, 40.41, -80.0), (7, 40.41, -80.0)]
    a = scatter(200, 3, width=0.012) + [(900 + i, 40.41 + i * 1e-6, -80.0) for i in range(40)]
    found = spatial.nearest_rows(points(spark, a), places(spark, b), 150.0, "objectid", ["objectid"], base_at=("lat", "lng"),
                                 target_at=("mid_lat", "mid_lng"), points_per_task=limit).collect()
    want = {}
    for pid, *at in a:
        near = min((planar(at, t[1:]), t[0] is not None, t[0] or 0) for t in b)
        if near[0] <= 150:
            want[pid] = (near[2] if near[1] else None, pytest.approx(near[0], abs=1e-6))
    assert len(found) == len(want) < len(a) and any(v[0] is None for v in want.values())
    assert {r.pid: (r.objectid, r.distance_m) for r in found} == want


def test_pairs_of_the_nearest_search_are_not_sorted(spark, monkeypatch):
    stored = []
    keep = spatial.cut_lineage
    monkeypatch.setattr(spatial, "cut_lineage", lambda df, label="": stored.append((label, df)) or keep(df, label))
    a, b = points(spark, scatter(30, 4)), places(spark, scatter(30, 5))
    spatial.nearest_join(a, b, 400.0, "objectid", ["objectid"], base_at=("lat", "lng"), target_at=("mid_lat", "mid_lng")).count()
    plan = [df for label, df in stored if label == "hits"][0]._jdf.queryExecution().executedPlan().toString()
    # The least distance is a hash aggregate; the points are shuffled to their cells and not again by position.
    assert "HashAggregate(keys=[_cx" in plan and "hashpartitioning(_lat" not in plan.split("SortMergeJoin")[1]


def test_long_lines_meet_only_boxes_in_touched_cells(spark):
    rng, rows = random.Random(21), []
    for i in range(60):
        x, y = rng.uniform(-2, 2), rng.uniform(-2, 2)
        rows.append((i, x, y, x + rng.choice([0.0, 0.01, 1.5, 3.0]) * rng.random(), y + rng.choice([0.0, 0.01, 1.5, 3.0]) * rng.random()))
    # A line that passes the boxes far to the right, and would share a cell of its own size with them.
    rows += [(100 + i, 0.05, 0.0, 3.9, 3.9) for i in range(5)]
    boxes = [(i, x, y, x + s, y + s) for i in range(60) for x, y, s in [(rng.uniform(-2, 2), rng.uniform(-2, 2), rng.choice([0.0, 0.015, 0.3, 2.0]))]]
    boxes += [(100 + i, 0.0, 0.5 + i / 50, 0.01, 0.51 + i / 50) for i in range(40)]
    lines = spark.createDataFrame(rows, "line long, min_lng double, min_lat double, max_lng double, max_lat double")
    asked = spark.createDataFrame(boxes, "box_id long, box_min_lng double, box_min_lat double, box_max_lng double, box_max_lat double")
    want = sorted((b[0], r[0]) for b in boxes for r in rows if r[3] >= b[1] and r[1] <= b[3] and r[4] >= b[2] and r[2] <= b[4])
    found = []
    meet = spatial._meet
    try:
        spatial._meet = lambda left, right, cell: found.append(left.join(right, cell).count()) or meet(left, right, cell)
        for limit in (None, 50):
            got = spatial.bbox_overlap(lines, asked, pairs_per_task=limit)
            assert sorted((r.box_id, r.line) for r in got.collect()) == want
        few = spatial.bbox_overlap(lines.where("line >= 100"), asked.where("box_id >= 100"))
        # No pair is tested where no cell is shared.
        assert few.count() == 0 and found[-1] == 0
    finally:
        spatial._meet = meet


@pytest.mark.parametrize("options", [{}, {"pairs_per_block": 50}, {"flags": True}])
def test_packed_totals_equal_a_loop(spark, options):
    r = random.Random(21)
    pts = [(40.4 + r.random() * 0.03, -80.0 + r.random() * 0.03, r.choice([0, 3, 70000]), r.choice([1, 1, 400])) for _ in range(300)]
    base = [(k % 45, 40.4 + r.random() * 0.03, -80.0 + r.random() * 0.03) for k in range(50)] + [(900, None, -80.0), (901, 41.4, -80.0)]
    df = spark.createDataFrame([*pts, (None, -80.0, 0, 1)], "lat double, lng double, day int, n int")
    segments = spark.createDataFrame(base, "objectid long, mid_lat double, mid_lng double")
    totals = spatial.totals_within(df, segments, 200.0, "objectid", "day", "n", **options)
    want = {}
    for oid, y, x in base:
        for lat, lng, day, n in pts if y is not None else []:
            if planar((y, x), (lat, lng)) <= 200.0:
                want[(oid, day)] = want.get((oid, day), 0) + n
    got = {}
    for oid, day, n in spatial.unpacked(totals, "objectid", "day", "n").collect():
        got[(oid, day)] = got.get((oid, day), 0) + n
    assert got.keys() == want.keys() and len(want) > 40
    if not options.get("flags"):
        assert got == want
    # A row a place, however many points it has: what is shuffled behind it does not grow with the pairs.
    assert totals.count() <= len(base)
