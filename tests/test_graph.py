import heapq
import random

import pytest
from pyspark.sql import functions as F

from frostline.functions import geo
from frostline.operators import graph

SEGMENT = "objectid long, coords array<struct<lng double, lat double>>, streetname string, oneway string, length_m double"
STEP = 0.001


def segments(spark, rows):
    return spark.createDataFrame(rows, SEGMENT)


def lattice(seed=3, side=6):
    rng, rows = random.Random(seed), []

    def at(x, y):
        return (round(-80 + x * STEP, 5), round(40 + y * STEP, 5))

    for x in range(side):
        for y in range(side):
            for dx, dy in ((1, 0), (0, 1)):
                if x + dx < side and y + dy < side:
                    rows.append((len(rows) + 1, [at(x, y), at(x + dx, y + dy)], f"Street {y if dx else 'N'}",
                                 rng.choice(["B", "B", "FT", "TF"]), 50 + rng.random() * 100))
    return rows


def key(p):
    return f"{p[0]:.5f},{p[1]:.5f}"


def dijkstra(rows, risks, start):
    out = {}
    for oid, coords, _, one, length in rows:
        a, b = key(coords[0]), key(coords[-1])
        cost = length * (1 + 10 * risks.get(oid, 0.0))
        if one != "TF":
            out.setdefault(a, []).append((b, cost))
        if one not in ("FT", "yes"):
            out.setdefault(b, []).append((a, cost))
    best, heap = {start: 0.0}, [(0.0, start)]
    while heap:
        c, n = heapq.heappop(heap)
        if c > best[n]:
            continue
        for m, w in out.get(n, []):
            if c + w < best.get(m, float("inf")):
                best[m] = c + w
                heapq.heappush(heap, (c + w, m))
    return best


def test_routes_equal_dijkstra(spark):
    rows, rng = lattice(), random.Random(7)
    risks = {0: {r[0]: rng.random() for r in rows}, 1: {r[0]: 0.0 for r in rows}}
    preds = spark.createDataFrame([(d, o, v) for d in risks for o, v in risks[d].items()],
                                  "day_offset long, objectid long, risk_score double")
    nodes = sorted({key(c) for r in rows for c in r[1]})
    asked = []
    for i in range(24):
        a, b = rng.choice(nodes), rng.choice(nodes)
        x, y = map(float, a.split(",")), map(float, b.split(","))
        (fx, fy), (tx, ty) = tuple(x), tuple(y)
        asked.append((i, i % 2, fx + 1e-5, fy, tx, ty - 1e-5, a, b))
    requests = spark.createDataFrame([r[:6] for r in asked], "route_id long, day_offset long, from_lng double, from_lat double, "
                                                             "to_lng double, to_lat double")
    hops = graph.safest_routes(requests, segments(spark, rows), preds).cache()
    got = {}
    for r in hops.orderBy("route_id", "hop").collect():
        got.setdefault(r.route_id, []).append(r)
    for i, day, *_, a, b in asked:
        best = dijkstra(rows, risks[day], a)
        if a == b or b not in best:
            assert i not in got
            continue
        path = got[i]
        assert [h.hop for h in path] == list(range(len(path)))
        assert path[0].src == a and path[-1].dst == b
        assert all(p.dst == q.src for p, q in zip(path, path[1:]))
        assert sum(h.length_m * (1 + 10 * h.risk) for h in path) == pytest.approx(best[b])
    lines = {r.route_id: r.coords for r in graph.route_geometry(hops).collect()}
    assert all(len(lines[i]) == len(p) + 1 for i, p in got.items())
    summary = {r.route_id: r for r in graph.route_summary(hops).collect()}
    for i, p in got.items():
        assert summary[i].distance_m == pytest.approx(sum(h.length_m for h in p), abs=0.51)
        assert summary[i].max_risk == pytest.approx(max(h.risk for h in p), abs=6e-4)
    hops.unpersist()


def test_components_of_long_chain_and_islands(spark):
    names = [f"n{i:03d}" for i in range(90)]
    links = [(names[i], names[i + 1]) for i in range(59)] + [(names[70], names[71]), (names[80], names[80])]
    random.Random(1).shuffle(links)
    nodes = spark.createDataFrame([(n,) for n in names], "node string")
    parts = {r.node: r.component for r in graph.components(nodes, spark.createDataFrame(links, "src string, dst string")).collect()}
    assert all(parts[n] == "n000" for n in names[:60])
    assert parts["n071"] == "n070" and parts["n080"] == "n080" and parts["n065"] == "n065"
    main = graph.largest_component(spark.createDataFrame(list(parts.items()), "node string, component string"))
    assert main.count() == 60


def test_stitching_distance_and_existing_links(spark):
    deg = 1 / 111194.9
    nodes = spark.createDataFrame([("a", -80.0, 40.0), ("b", -80.0, 40.0 + 14.9 * deg), ("c", -80.0, 40.0 - 15.2 * deg),
                                   ("d", -70.0, 40.0), ("e", -70.0, 40.0 + 5 * deg)], "node string, lng double, lat double")
    none = spark.createDataFrame([], "src string, dst string")
    got = {(r.src, r.dst, r.segment_id) for r in graph.stitch_edges(nodes, none).collect()}
    assert {g[:2] for g in got} == {("a", "b"), ("b", "a"), ("d", "e"), ("e", "d")} and {g[2] for g in got} == {-1, -2}
    both = spark.createDataFrame([("a", "b"), ("b", "a"), ("d", "e")], "src string, dst string")
    assert {(r.src, r.dst) for r in graph.stitch_edges(nodes, both).collect()} == {("d", "e"), ("e", "d")}


def test_edges_follow_one_way_codes_and_fill_length(spark):
    c = [(-80.0, 40.0), (-80.0, 40.001)]
    rows = [(1, c, "A", "FT", 10.0), (2, c, "A", "TF", 10.0), (3, c, "A", "B", 0.0), (4, c, None, None, 10.0), (5, c[:1], "A", "B", 1.0)]
    got = graph.road_edges(segments(spark, rows)).collect()
    a, b = key(c[0]), key(c[1])
    assert sorted((r.segment_id, r.src, r.dst) for r in got) == sorted(
        [(1, a, b), (2, b, a), (3, a, b), (3, b, a), (4, a, b), (4, b, a)])
    assert {round(r.length_m) for r in got if r.segment_id == 3} == {111}
    back = [r for r in got if r.segment_id == 2][0]
    assert back.coords[0]["lat"] == 40.001


def loop_steps(path):
    """Steps of one route by walking its edges."""
    steps, street, length, risks, prev = [], "", 0.0, [], None
    for i, (name, bearing, metres, risk) in enumerate(path):
        delta = 0 if prev is None else min(abs(bearing - prev) % 360, 360 - abs(bearing - prev) % 360)
        if i == 0 or (name != street and name != "") or delta > 30:
            if i > 0 and length > 0:
                diff = (bearing - prev + 360) % 360
                turn = "Turn right onto" if 30 <= diff < 150 else "Turn left onto" if 210 <= diff < 330 else "Continue on"
                steps.append((f"{turn} {street or 'road'}", street, round(length), len(risks)))
            street, length, risks = name or street, metres, [risk]
        else:
            length += metres
            risks.append(risk)
        prev = bearing
    if length > 0:
        steps.append((f"Continue on {street or 'road'}", street, round(length), len(risks)))
    return steps


def test_steps_equal_a_loop(spark):
    rng, rows, paths = random.Random(12), [], {}
    for route in range(12):
        x, y = -80.0, 40.0
        for hop in range(rng.randrange(1, 12)):
            dx, dy = rng.choice([(1, 0), (0, 1), (1, 0.2), (-1, 0.3)])
            nx, ny = x + dx * STEP, y + dy * STEP
            rows.append((route, 0, hop, [(x, y), (nx, ny)], rng.choice(["", "Main", "Oak"]), rng.choice([40.31, 70.12, 10.33]), 0.25))
            x, y = nx, ny
    hops = spark.createDataFrame(rows, "route_id long, day_offset long, hop long, coords array<struct<lng double, lat double>>, "
                                       "streetname string, length_m double, risk double")
    f, l = F.element_at("coords", 1), F.element_at("coords", -1)
    for r in hops.withColumn("b", geo.bearing_deg(f["lat"], f["lng"], l["lat"], l["lng"])).orderBy("route_id", "hop").collect():
        paths.setdefault(r.route_id, []).append((r.streetname, r.b, r.length_m, r.risk))
    got = {}
    for r in graph.route_steps(hops).orderBy("route_id", "step").collect():
        got.setdefault(r.route_id, []).append((r.instruction, r.streetname, r.distance_m))
    assert got == {k: [s[:3] for s in loop_steps(p)] for k, p in paths.items()}


def test_search_rows_hold_many_origins(spark, monkeypatch):
    rng, nodes = random.Random(5), 40
    # Two layers: even and odd numbers. Costs are whole numbers, so that ties and long ways round occur.
    pairs = {(a, b) for a in range(nodes) for b in rng.sample(range(nodes), 2) if a != b} | {(a, a + 1) for a in range(nodes - 1)}
    rows = [(a * 2 + side, b * 2 + side, float(rng.randrange(1, 30)), i) for i, (a, b) in enumerate(sorted(pairs)) for side in (0, 1)]
    links = spark.createDataFrame(rows, "src long, dst long, cost double, segment_id long")
    asked = [(i, o * 2 + i % 2, rng.randrange(nodes) * 2 + i % 2) for i, o in enumerate(rng.choices(range(nodes), k=50))]
    asked = [a for a in asked if a[1] != a[2]]
    wanted = spark.createDataFrame(asked + asked[:2], "route_id long, origin long, target long")
    out = {}
    for a, b, cost, _ in rows:
        out.setdefault(a, []).append((b, cost))

    def least(start):
        best, heap = {start: 0.0}, [(0.0, start)]
        while heap:
            c, n = heapq.heappop(heap)
            for m, w in out.get(n, []):
                if c + w < best.get(m, float("inf")):
                    best[m] = c + w
                    heapq.heappush(heap, (c + w, m))
        return best

    weight = {(a, b): c for a, b, c, _ in rows}
    for few in (0.0, 2.0):  # every round whole, every round apart
        monkeypatch.setattr(graph, "FEW_ROWS", few)
        monkeypatch.setattr(graph, "APART_ROUNDS", 3)
        origins = graph.place_origins(wanted.select("origin").distinct(), 2).cache()
        batches = {r.batch for r in origins.collect()}
        assert len(batches) < origins.count() / 4 and all(r.batch % 2 == r.origin % 2 for r in origins.collect())
        settled = graph.least_cost(links, origins, wanted).cache()
        assert settled.count() == settled.select("batch", "node").distinct().count() <= nodes * len(batches)
        hops = graph.walk_back(graph.predecessors(settled, links), origins, links, wanted).collect()
        paths = {}
        for h in hops:
            paths.setdefault(h.route_id, []).append(h)
        for i, origin, target in asked:
            times = 2 if (i, origin, target) in asked[:2] else 1
            path = sorted(paths[i], key=lambda h: h.hop)[::times]
            assert len(paths[i]) == times * len(path) and [h.hop for h in path] == list(range(len(path)))
            assert path[0].src == origin and path[-1].dst == target and all(p.dst == q.src for p, q in zip(path, path[1:]))
            assert sum(weight[h.src, h.dst] for h in path) == least(origin)[target]
