import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from frostline.operators import labels, storms
from frostline.plans import training

D0 = dt.date(2024, 1, 1)
LNG_M = 111320 * math.cos(math.radians(40.44))


def weather(spark, rows):
    return spark.createDataFrame(
        [(D0 + dt.timedelta(days=d), s, lo, hi, w, p, i) for i, (d, s, lo, hi, w, p) in enumerate(rows)],
        "date date, snowfall_cm double, temp_min_c double, temp_max_c double, wind_max_kmh double, precip_mm double, o long")


def loop_days(daily):
    """Storm days by stepping through the calendar."""
    snowy = sorted(d for d, (s, _) in daily.items() if s is not None and s >= 1.0)
    groups, out = [], []
    for d in snowy:
        if groups and (d - groups[-1][-1]) <= 1:
            groups[-1].append(d)
        else:
            groups.append([d])
    for sid, g in enumerate(groups):
        total, thaw, peak, peak_at, last, post = 0.0, 0.0, 0.0, 0, 0, False
        for i, d in enumerate(range(g[0], g[-1] + 3)):
            s, hi = daily.get(d, (0.0, 0.0))
            s, hi = s or 0.0, hi or 0.0
            total += s
            if s > peak:
                peak, peak_at = s, i
            if s >= 1.0:
                last, post, thaw = i, False, 0.0
            else:
                post = post or i > last
                thaw += hi * 12 if hi > 0 else 0.0
            out.append((sid, i, round(s, 2), round(total, 2), i - peak_at, int(post), round(thaw, 1)))
    return groups, out


def test_storm_days_equal_a_loop(spark):
    rng = random.Random(4)
    rows = [(d, rng.choice([0.0, 0.5, 1.0, 2.5, 2.5, None]), -5.0, rng.choice([-2.0, 3.0, None]), 10.0, 1.0)
            for d in range(160) if rng.random() < 0.9]
    days = storms.by_day(weather(spark, rows), "o")
    table = storms.storm_events(days)
    groups, want = loop_days({r[0]: (r[1], r[3]) for r in rows})
    got = storms.storm_days(table, days)
    rows = sorted((r.storm_id, r.day_offset, r.daily_snowfall_cm, r.cumulative_snowfall_cm, r.days_since_peak_snowfall,
                   r.is_post_storm, r.cumulative_thaw_degree_hours) for r in got.collect())
    assert rows == sorted(want)
    events = table.orderBy("storm_id").collect()
    assert [(e.start_date - D0).days for e in events] == [g[0] for g in groups]
    assert [e.duration_days for e in events] == [g[-1] - g[0] + 1 for g in groups]


def test_storm_edges(spark):
    rows = [(0, 1.0, -3.0, 0.0, 5.0, 1.0), (1, 0.9, -9.0, 0.0, 7.0, 2.0), (3, 4.0, -1.0, 0.0, 9.0, 3.0),
            (3, 2.0, -2.0, 0.0, 8.0, 1.0), (20, None, 0.0, 0.0, 0.0, 0.0)]
    days = storms.by_day(weather(spark, rows), "o")
    events = storms.storm_events(days).orderBy("storm_id").collect()
    # A gap of two days opens a new storm; copies of a date add to the total; windows reach into the next storm.
    assert [(e.total_snowfall_cm, e.max_daily_snowfall_cm, e.min_temp_c) for e in events] == [(1.0, 1.0, -9.0), (6.0, 4.0, -2.0)]
    first = storms.storm_days(storms.storm_events(days), days).where("storm_id = 1 and day_offset = 0").first()
    assert first.daily_snowfall_cm == 4.0
    assert storms.storm_events(storms.by_day(weather(spark, [(0, 0.0, 0.0, 0.0, 0.0, 0.0)]))).count() == 0


def near(a, b, radius):
    return math.hypot((a[0] - b[0]) * 111320, (a[1] - b[1]) * LNG_M) <= radius


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(11)

    def at():
        return 40.4 + rng.random() * 0.01, -80.0 + rng.random() * 0.01

    segments = [(i, *at()) for i in range(12)]
    daily = [(d, 3.0 if d in (2, 3, 6, 28, 29) else 0.0, -4.0, 2.0, 20.0, 1.0) for d in range(45)]
    stamp = dt.datetime(2024, 1, 1)
    complaints = [(stamp + dt.timedelta(days=rng.randrange(45), hours=rng.choice([0, 0, 9])), *at()) for _ in range(120)]
    crashes = [(2024, rng.choice([1, 2, 3]), *at()) for _ in range(40)]
    plow = []
    for _ in range(60):
        _, y, x = rng.choice(segments[:8])
        plow.append((rng.choice(["2024-01-03 - 2024-01-04", "2024-01-08", "run 2024-02-20"]),
                     y + rng.random() * 1e-3, x + rng.random() * 1e-3))
    closures = [(stamp + dt.timedelta(days=rng.randrange(40), hours=rng.choice([0, 15])), None if rng.random() < 0.3 else rng.randrange(60),
                 rng.choice(["True", "yes", "0"]), *at()) for _ in range(25)]
    closures = [(a, None if h is None else a + dt.timedelta(hours=h), f, x, y) for a, h, f, x, y in closures]
    return segments, daily, complaints, crashes, plow, closures


def frames(spark, world):
    segments, daily, complaints, crashes, plow, closures = world
    days = storms.by_day(weather(spark, daily), "o")
    return (
        spark.createDataFrame(segments, "objectid long, mid_lat double, mid_lng double"), storms.storm_events(days),
        spark.createDataFrame(complaints, "created_date timestamp, latitude double, longitude double"),
        spark.createDataFrame(crashes, "crash_year int, crash_month int, latitude double, longitude double"),
        spark.createDataFrame(plow, "event_date string, latitude double, longitude double"),
        spark.createDataFrame(closures, "from_date timestamp, to_date timestamp, full_closure string, latitude double, longitude double"))


def test_labels_equal_a_loop(spark, world):
    segments, daily, complaints, crashes, plow, closures = world
    seg_df, storm_df, c_df, x_df, p_df, d_df = frames(spark, world)
    events = storm_df.collect()
    place = {s[0]: s[1:] for s in segments}

    def nearest(pt, radius):
        best = min((math.hypot((pt[0] - q[0]) * 111320, (pt[1] - q[1]) * LNG_M), i) for i, q in place.items())
        return best[1] if best[0] <= radius else None

    counts, crash, plowed, closed = {}, {}, {}, set()
    monthly = {}
    for y, m, *pt in crashes:
        s = nearest(pt, 200)
        if s is not None:
            monthly[(y, m, s)] = monthly.get((y, m, s), 0) + 1
    for e in events:
        start, end = dt.datetime.combine(e.start_date, dt.time()), dt.datetime.combine(e.window_end, dt.time())
        for t, *pt in complaints:
            if start <= t <= end:
                for s, q in place.items():
                    if near(pt, q, 200):
                        k = (s, e.storm_id, (t - start).days)
                        counts[k] = counts.get(k, 0) + 1
        for (y, m, s), n in monthly.items():
            first = dt.date(y, m, 1)
            last = (dt.date(y, m, 28) + dt.timedelta(days=5)).replace(day=1) - dt.timedelta(days=1)
            hit = [o for o in events if o.start_date <= last and o.window_end >= first]
            if e in hit:
                days = (e.window_end - e.start_date).days + 1
                w = e.total_snowfall_cm / sum(o.total_snowfall_cm for o in hit) / days
                crash[(s, e.storm_id)] = crash.get((s, e.storm_id), 0) + n * w
        dates = {str(e.start_date + dt.timedelta(days=i)) for i in range((e.window_end - e.start_date).days + 1)}
        hits = [nearest(pt, 100) for label, *pt in plow if any(d in label for d in dates)]
        hits = [h for h in hits if h is not None]
        if len(hits) >= 10:
            plowed[e.storm_id] = set(hits)
        for a, b, full, *pt in closures:
            b = b or a
            if full.lower() in ("true", "yes", "1") and a <= end and b >= start:
                day, stop = max(start, a), min(end, b)
                while day <= stop:
                    closed |= {(s, e.storm_id, (day - start).days) for s, q in place.items() if near(pt, q, 200)}
                    day += dt.timedelta(days=1)

    assert plowed and len(plowed) < len(events) and closed and counts and crash
    measures = labels.storm_measures(
        storm_df, labels.complaint_counts(c_df, storm_df, seg_df), labels.crash_scores(x_df, storm_df, seg_df),
        labels.plow_passes(p_df, storm_df, seg_df), labels.closure_days(d_df, storm_df, seg_df))
    rows = {(r.objectid, r.storm_id, r.day_offset): r for r in labels.risk_labels(seg_df, storm_df, measures).collect()}

    want, per_storm = {}, {}
    for e in events:
        for d in range((e.window_end - e.start_date).days + 1):
            c = np.array([counts.get((s, e.storm_id, d), 0) for s in place], float)
            x = np.array([crash.get((s, e.storm_id), 0) for s in place], float)
            f = np.array([float((s, e.storm_id, d) in closed) for s in place])
            g = np.array([0.0 if s in plowed.get(e.storm_id, place) else 1.0 for s in place])

            def norm(v):
                top = np.log1p(v).max()
                return np.log1p(v) / top if top > 0 else v * 0

            if e.storm_id in plowed:
                score = 0.45 * norm(c) + 0.25 * norm(x) + 0.15 * norm(g) + 0.15 * norm(f)
            else:
                score = (0.45 * norm(c) + 0.25 * norm(x) + 0.15 * norm(f)) / 0.85
            for i, s in enumerate(place):
                any_hit = c[i] > 0 or x[i] > 0 or f[i] > 0 or (e.storm_id in plowed and g[i] > 0)
                want[(s, e.storm_id, d)] = (round(float(np.clip(score[i], 0, 1)), 6), int(any_hit), c[i])
                per_storm.setdefault(e.storm_id, []).append(want[(s, e.storm_id, d)][0])
    assert set(rows) == set(want)
    for k, (score, hit, c) in want.items():
        assert rows[k].risk_score == pytest.approx(score, abs=2e-6)
        assert (rows[k].label_any_incident, rows[k].storm_311_count) == (hit, c)
        assert (rows[k].storm_plow_gap is None) == (k[1] not in plowed)
        p95 = np.percentile(per_storm[k[1]], 95)
        if abs(score - p95) > 1e-5:
            assert rows[k].label_top_5pct == int(score >= p95 and score > 0)


def test_last_day_option(spark):
    seg = spark.createDataFrame([(1, 40.4, -80.0)], "objectid long, mid_lat double, mid_lng double")
    days = storms.by_day(weather(spark, [(0, 2.0, 0.0, 0.0, 0.0, 0.0)]), "o")
    table = storms.storm_events(days)
    calls = spark.createDataFrame([(dt.datetime(2024, 1, 3, 15), 40.4, -80.0), (dt.datetime(2024, 1, 3), 40.4, -80.0)],
                                  "created_date timestamp, latitude double, longitude double")
    assert labels.complaint_counts(calls, table, seg).first().complaints == 1
    assert labels.complaint_counts(calls, table, seg, inclusive_last_day=True).first().complaints == 2


def test_plow_gaps_are_the_rest(spark, world):
    seg_df, storm_df, _, _, p_df, _ = frames(spark, world)
    plowed = labels.plow_passes(p_df, storm_df, seg_df)
    done = {(r.storm_id, r.objectid) for r in plowed.collect()}
    gaps = {(r.storm_id, r.objectid) for r in labels.plow_gaps(plowed, seg_df).collect()}
    assert not done & gaps
    assert done | gaps == {(s, i) for s in {d[0] for d in done} for i in range(12)}


def test_matrix_from_grid_equals_matrix_from_stored_labels(spark, world):
    seg_df, storm_df, c_df, x_df, p_df, d_df = frames(spark, world)
    measures = labels.storm_measures(
        storm_df, labels.complaint_counts(c_df, storm_df, seg_df), labels.crash_scores(x_df, storm_df, seg_df),
        labels.plow_passes(p_df, storm_df, seg_df), labels.closure_days(d_df, storm_df, seg_df))
    static = training.static_features(seg_df.withColumn("elevation_m", F.lit("12.5")).withColumn("incline", F.lit("-3%")))
    days = storms.storm_days(storm_df, storms.by_day(weather(spark, world[1]), "o"))
    one = training.training_matrix(static, storm_df, days, measures)
    two = training.join_matrix(labels.risk_labels(seg_df, storm_df, measures), static, storm_df, days)
    assert one.columns == two.columns == training.MATRIX
    assert one.exceptAll(two).count() == 0 and one.count() == two.count()
    row = one.where("day_offset = 1").first()
    assert row.day_offset_x_snow == pytest.approx(row.total_snowfall_cm)
    assert row.snow_x_incline == pytest.approx(3 * row.total_snowfall_cm)


def test_grid_is_unfolded_without_a_shuffle(spark, world):
    seg_df, storm_df, c_df, x_df, p_df, d_df = frames(spark, world)
    twice = seg_df.unionByName(seg_df.limit(1)).unionByName(seg_df.limit(1).withColumn("objectid", F.lit(None).cast("bigint")))
    measures = labels.storm_measures(
        storm_df, labels.complaint_counts(c_df, storm_df, seg_df), labels.crash_scores(x_df, storm_df, seg_df),
        labels.plow_passes(p_df, storm_df, seg_df), labels.closure_days(d_df, storm_df, seg_df))
    rows = labels.risk_labels(twice, storm_df, measures)
    assert "Exchange hashpartitioning" not in rows._jdf.queryExecution().executedPlan().toString()
    assert rows.count() == twice.count() * storms.storm_calendar(storm_df).count()
    # Repeated ids have the same rows; rows without an id have no incident of their own.
    first = seg_df.first().objectid
    assert rows.where(F.col("objectid") == first).count() == 2 * rows.where(F.col("objectid") == first).distinct().count()
    assert rows.where("objectid is null").agg(F.max("storm_311_count")).first()[0] == 0


def test_packed_measures_give_the_same_labels(spark, world, monkeypatch):
    """Days packed by segment, in stretches shorter than the calendar, against a row a day."""
    seg_df, storm_df, c_df, x_df, p_df, d_df = frames(spark, world)
    twice = seg_df.unionByName(seg_df.limit(1)).unionByName(seg_df.limit(1).withColumn("objectid", F.lit(None).cast("bigint")))

    def labelled(**packed):
        measures = labels.storm_measures(
            storm_df, labels.complaint_counts(c_df, storm_df, twice, **packed), labels.crash_scores(x_df, storm_df, twice),
            labels.plow_passes(p_df, storm_df, twice), labels.closure_days(d_df, storm_df, twice, **packed))
        if packed:
            # A few rows a segment, not a row a day.
            daily = measures.where(F.col("kind").isin(labels.COMPLAINTS, labels.CLOSED))
            assert daily.count() <= 2 * twice.count() and daily.where("packed is null").isEmpty()
        return labels.risk_labels(twice, storm_df, measures)

    rows = labelled()
    monkeypatch.setattr(labels, "DAYS_A_ROW", 3)
    packed = labelled(packed=True)
    assert rows.count() == packed.count() and rows.exceptAll(packed).count() == 0


def test_label_summary_stores_no_label_rows(spark, monkeypatch):
    from frostline.operators import cleaning

    df = spark.createDataFrame([(k % 40, k % 3, (k % 7) / 10) for k in range(600)] + [(None, 9, 0.5)], "objectid long, storm_id long, risk_score double")
    stored = []
    write = cleaning.cut_lineage
    monkeypatch.setattr(cleaning, "cut_lineage", lambda df, label: stored.append(df.count()) or write(df, label))
    got = cleaning.label_summary(df).first()
    assert (got["rows"], got["segments"], got["storms"], got["min_score"], got["max_score"]) == (601, 41, 4, 0.0, 0.6)
    assert got["median_score"] == pytest.approx(0.3) and stored == [22]
