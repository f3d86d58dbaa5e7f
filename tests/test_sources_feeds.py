import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from frostline import schemas
from frostline.operators import cleaning
from frostline.plans import serve
from frostline.sources import documents, files, texts
from frostline.streaming import feeds


def test_missing_csv_is_empty_and_fallback_is_used(spark, tmp_path):
    assert files.read_csv(spark, str(tmp_path / "none.csv"), schemas.BRIDGES).count() == 0
    rows = spark.createDataFrame([("1", "x", "y", 40.0, -80.0, 1950, "s")], schemas.BRIDGES)
    files.write_csv(rows, str(tmp_path / "b"), ["bridge_id", "latitude", "longitude"])
    got = files.read_first(spark, [str(tmp_path / "none.csv"), str(tmp_path / "b")], "bridge_id string, latitude double, longitude double")
    assert got.collect() == [("1", 40.0, -80.0)]


def test_csv_is_matched_by_name_and_cast_leniently(spark, tmp_path):
    (tmp_path / "c.csv").write_text("year_built,extra,bridge_id,latitude\n1950.0,x,7,40.5\n,y,8,bad\n")
    got = files.read_csv(spark, str(tmp_path / "c.csv"), schemas.BRIDGES).orderBy("bridge_id").collect()
    assert [(g.bridge_id, g.year_built, g.latitude, g.longitude, g.name) for g in got] == [("7", 1950, 40.5, None, None), ("8", None, None, None, None)]


def test_sinks(spark, tmp_path):
    one, two = spark.range(3), spark.range(9)
    files.write_once(one, str(tmp_path / "o"))
    files.write_once(two, str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o")).count() == 3
    files.append_snapshot(one, str(tmp_path / "s"))
    files.append_snapshot(one, str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    assert stored.count() == 6 and "fetched_at" in stored.columns
    ranked = spark.createDataFrame([(1, 0.2), (2, 0.9), (3, 0.9)], "objectid long, risk_score double")
    files.write_ranked(ranked, str(tmp_path / "r"))
    assert [r.objectid for r in spark.read.option("header", True).csv(str(tmp_path / "r")).collect()] == ["2", "3", "1"]
    files.write_matrix(spark.createDataFrame([(1, "a"), (2, "b")], "x long, season string"), str(tmp_path / "m"))
    assert files.read_columns(spark, str(tmp_path / "m"), ["x"]).count() == 2
    files.write_sample(two.withColumnRenamed("id", "k"), str(tmp_path / "p"), ["k"], rows=4)
    assert [r.k for r in spark.read.option("header", True).csv(str(tmp_path / "p")).collect()] == list("0123")


def test_predictions_replace_only_their_days(spark, tmp_path):
    path = str(tmp_path / "p")
    first = spark.createDataFrame([(0, 1, 0.1, "low"), (1, 1, 0.2, "moderate")], schemas.PREDICTIONS)
    files.write_predictions(first, path)
    files.write_predictions(spark.createDataFrame([(1, 7, 0.9, "very_high")], schemas.PREDICTIONS), path)
    assert sorted(files.read_predictions(spark, path).collect()) == [(0, 1, 0.1, "low"), (1, 7, 0.9, "very_high")]


def feature(kind, coords, **props):
    return {"type": "Feature", "geometry": {"type": kind, "coordinates": coords}, "properties": props}


def test_geojson_collection(spark, tmp_path):
    line = [[-80.0, 40.0], [-80.1, 40.2], [-80.2, 40.4]]
    doc = {"type": "FeatureCollection", "features": [
        feature("LineString", line, objectid=1, streetname="A", measurlgth=12.5, oneway="FT"),
        feature("LineString", line[:1], objectid=2), feature("LineString", line, objectid=1, streetname="later"),
        feature("Point", [-80.5, 40.5], objectid=3), feature("MultiLineString", [line, line[:1]], objectid=4),
        feature("LineString", line, streetname="no id")]}
    (tmp_path / "d.json").write_text(json.dumps(doc, indent=1))
    rows = documents.features(documents.read_documents(spark, str(tmp_path / "d.json")))
    assert rows.count() == 6
    seg = documents.line_segments(rows).collect()
    assert [(s.objectid, s.streetname, s.domi_class, s.length_m, s.oneway, s.mid_lat) for s in seg] == [(1, "A", "Local", 12.5, "FT", 40.2)]
    mids = {m.objectid: (m.mid_lat, m.mid_lng) for m in documents.line_midpoints(rows).collect()}
    assert mids[3] == (40.5, -80.5) and mids[4] == (pytest.approx(40.15), pytest.approx(-80.075)) and mids[1][0] == pytest.approx(40.2)


def test_polygons_traces_services_and_ways(spark):
    ring = [[-80.0, 40.0], [-80.0, 40.2], [-80.3, 40.1]]
    polys = [(0, json.dumps(feature("Polygon", [ring, ring[:2]], shape_area=5.0))), (1, json.dumps(feature("MultiPolygon", [[ring[:2]], [ring]]))),
             (2, json.dumps(feature("Point", [1, 2])))]
    got = documents.polygon_centroids(spark.createDataFrame(polys, "ordinal long, feature string")).orderBy("slope_id").collect()
    assert [(g.slope_id, round(g.lat, 4), round(g.lng, 4), g.slope_area_sqm) for g in got] == [(0, 40.1, -80.1, 5.0), (1, 40.1, -80.0, None)]
    traces = [("2024-01-01", json.dumps(feature("Point", [-80.0, 40.0], TRUCK_ID="T"))),
              ("2024-01-02", json.dumps(feature("LineString", ring, id=5, time="x"))), ("2024-01-03", json.dumps(feature("LineString", [])))]
    got = documents.trace_points(spark.createDataFrame(traces, "label string, feature string")).orderBy("event_date").collect()
    assert [(g.truck_id, g.latitude, g.timestamp) for g in got] == [("T", 40.0, ""), ("5", 40.2, "x")]
    records = [("ice", json.dumps({"attributes": {"ST_RT_NO": "28", "COUNTY": "x"}, "geometry": {"paths": [ring]}})),
               ("snow", json.dumps({"attributes": {"road_name": "B"}, "geometry": {"x": -79.5, "y": 40.5}}))]
    df = spark.createDataFrame(records, "condition_type string, feature string")
    got = documents.road_conditions(df).orderBy("condition_type").collect()
    assert [(g.route, g.county, g.latitude) for g in got] == [("28", "x", 40.2), ("B", "", 40.5)]
    assert documents.state_routes(df.where("condition_type = 'ice'")).first().mid_lng == -80.0
    elements = spark.createDataFrame(
        [(1, "node", 40.0, -80.0, None, None), (2, "node", 40.2, -80.2, None, None), (9, "way", None, None, [1, 2, 3], {"highway": "primary", "name": "N"}),
         (8, "way", None, None, [1], {"highway": "platform"}), (7, "way", None, None, [5], {"highway": "service"})],
        "id long, type string, lat double, lon double, nodes array<long>, tags map<string, string>")
    ways = {w.osm_id: w for w in documents.way_roads(elements).collect()}
    assert set(ways) == {9, 7} and ways[9].mid_lat == pytest.approx(40.1) and ways[9].node_count == 3 and ways[7].mid_lat is None


@pytest.mark.parametrize("wrap", [lambda p: {"properties": {"periods": p}}, lambda p: {"periods": p}, lambda p: p])
def test_forecast_documents(spark, wrap):
    periods = [{"name": "Tonight", "temperature": 20, "temperatureUnit": "F", "windSpeed": "5 mph", "isDaytime": False,
                "probabilityOfPrecipitation": {"value": 60}}]
    df = spark.createDataFrame([(1, json.dumps(wrap(periods)))], "forecast_id long, document string")
    row = documents.forecast_periods(df).first()
    assert (row.period_no, row.temperature, row.is_daytime, row.precip_chance) == (0, 20.0, False, 60.0)


def test_daily_arrays_of_unequal_length(spark):
    doc = {"daily": {"time": ["2024-01-01", "2024-01-02"], "snowfall_sum": [1.5], "weather_code": [71, 3]}}
    got = documents.daily_rows(spark.createDataFrame([(json.dumps(doc),)], "document string")).orderBy("date").collect()
    assert [(g.snowfall_cm, g.temp_max_c, g.weather_code) for g in got] == [(1.5, None, 71), (None, None, 3)]


def test_closure_sentences(spark):
    df = spark.createDataFrame([
        ("Route 28 (East Ohio Street) closed", "Route 28 (East Ohio Street) between <b>X</b> and Y in Z – Closed", "u", "1700000000000"),
        ("nothing", "here", "v", None)], "title string, excerpt string, uri string, millis string")
    got = texts.press_closures(df).collect()
    full = [g for g in got if g.municipality]
    assert len(full) == 1 and (full[0].from_location, full[0].to_location, full[0].municipality, full[0].status) == ("X", "Y", "Z", "Closed")
    assert {g.date for g in got} == {"2023-11-14"} and all(g.route_number == "28" for g in got)


@pytest.mark.parametrize("text,at", [
    ("[[40.41, -79.95], [40.42, -79.96], [40.43, -79.97]]", (40.42, -79.96)), ("[40.4, -79.9]", (40.4, -79.9)),
    ("LINESTRING (40.44 -79.98, 40.45 -79.99)", (40.45, -79.99)), ("linestring(-79.98 40.44, -79.99 40.45)", (40.45, -79.99)),
    ("POINT(-79.91 40.46)", (40.46, -79.91)), ("40.47, -79.92", (40.47, -79.92)), ("-79.92,40.47", (40.47, -79.92)),
    ("[[1, 2]]", None), ("unknown", None), ("", None), (None, None), ("[broken", None)])
def test_location_texts(spark, text, at):
    got = spark.createDataFrame([(text,)], "g string").select(texts.location_point(F.col("g")).alias("p")).first().p
    assert (got and (got.lat, got.lng)) == at


def test_canonical_headers(spark):
    raw = spark.createDataFrame([("a", None, " ", "4")],
                                "`Group_ID ` string, request_type_name string, created_on string, LATITUDE string")
    row = cleaning.canonical(raw, schemas.COMPLAINT_ALIASES, "s").first()
    assert (row.group_id, row.request_type, row.created_date, row.latitude, row.longitude, row.data_source) == ("a", "", "", "4", "", "s")


def test_coercion(spark):
    df = spark.createDataFrame([("40.1", "x"), ("40.2", "-80"), (None, "-80")], "latitude string, longitude string")
    assert cleaning.located(df).collect() == [(40.2, -80.0)]
    times = spark.createDataFrame([("2024-01-02", None), ("bad", "2024-01-02"), ("2024-01-03 05:00:00", "2024-01-04")], "a string, b string")
    got = cleaning.timed(times, "a", "b").orderBy("a").collect()
    assert got[0].a == got[0].b and len(got) == 2


def test_keep_first_and_merge(spark):
    df = spark.createDataFrame([(1, 5, "b"), (1, 2, None), (None, 1, "n"), (None, 0, "m")], "k long, o long, v string")
    assert sorted(cleaning.keep_first(df, ["k"], "o").collect(), key=str) == sorted([(1, 2, None), (None, 0, "m")], key=str)
    a = spark.createDataFrame([("1", None), ("1", None)], "x string, y string")
    b = spark.createDataFrame([("1", None), ("2", "z"), ("2", "z")], "x string, y string")
    assert cleaning.merge_passes(a, b, ["x", "y"]).count() == 3


def test_feature_round_trip(spark, tmp_path):
    preds = spark.createDataFrame([(0, 5, 0.6, "very_high"), (0, 6, 0.0, "very_low")], schemas.PREDICTIONS)
    attrs = spark.createDataFrame([(5, "A", "Local", None, -80.0, True), (6, None, None, 40.0, -80.0, None)],
                                  "objectid long, streetname string, domi_class string, mid_lat double, mid_lng double, is_snow_emergency_route boolean")
    meta = serve.prediction_metadata(preds, spark.createDataFrame([(3.0,)], "snowfall_cm double"), "ranker")
    assert meta.first().risk_distribution.very_high == 1 and meta.first().weather_scenario.snowfall_cm == 3.0
    files.write_features(serve.point_features(preds, attrs), meta, str(tmp_path / "f"))
    rows = spark.read.text(str(tmp_path / "f" / "features")).withColumnRenamed("value", "feature")
    assert sorted(documents.stored_predictions(rows).collect()) == sorted(preds.collect())
    one = json.loads(rows.where(F.col("feature").contains('"objectid":5')).first().feature)
    assert one["geometry"]["coordinates"] == [-80.0, 0.0] and one["properties"]["streetname"] == "A"


def test_upsert_keeps_latest_and_can_be_repeated(spark, tmp_path):
    path = str(tmp_path / "t")

    def batch(*rows):
        return spark.createDataFrame(rows, "k long, at long, v string")

    for rows in ([(1, 5, "a"), (1, 7, "b"), (2, 1, "c")], [(1, 6, "old"), (3, 1, "d")], [(1, 6, "old"), (3, 1, "d")], [(2, 9, "e")]):
        feeds.upsert(batch(*rows), path, "k", ["at"], buckets=4)
    assert sorted(feeds.read_upserted(spark, path).collect()) == [(1, 7, "b"), (2, 9, "e"), (3, 1, "d")]


def test_a_failed_batch_leaves_the_last_version_whole(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")

    def batch(at, keys=range(40)):
        return spark.createDataFrame([(k, at, f"v{at}") for k in keys], "k long, at long, v string")

    def seen():
        return {(r.at, r.v) for r in feeds.read_upserted(spark, path).collect()}, feeds.read_upserted(spark, path).count()

    feeds.upsert(batch(1), path, "k", ["at"], buckets=8)
    before = feeds.read_upserted(spark, path)
    commit = feeds._commit

    def failing(*args):
        raise OSError("lost before the switch")

    monkeypatch.setattr(feeds, "_commit", failing)
    with pytest.raises(OSError):
        feeds.upsert(batch(2), path, "k", ["at"], buckets=8)
    assert seen() == ({(1, "v1")}, 40)
    monkeypatch.setattr(feeds, "_commit", commit)
    feeds.upsert(batch(2), path, "k", ["at"], buckets=8)
    assert seen() == ({(2, "v2")}, 40)
    # A reader that began before the batch still finds its version.
    assert {r.v for r in before.collect()} == {"v1"}


def test_of_two_writers_one_fails(spark, tmp_path):
    path = str(tmp_path / "t")
    feeds.upsert(spark.createDataFrame([(1, 1)], "k long, at long"), path, "k", ["at"], buckets=2)
    number, manifest = feeds._manifest(spark, path)
    feeds._commit(spark, path, number + 1, manifest)
    with pytest.raises(RuntimeError):
        feeds._commit(spark, path, number + 1, manifest)
    assert feeds.read_upserted(spark, path).count() == 1


def test_old_versions_are_removed(spark, tmp_path):
    path = str(tmp_path / "t")
    for at in range(6):
        feeds.upsert(spark.createDataFrame([(k, at) for k in range(20)], "k long, at long"), path, "k", ["at"], buckets=2)
    assert len(feeds._numbers(spark, path)) == feeds.KEPT
    assert len(list((tmp_path / "t").glob("data/*/bucket=0"))) == feeds.KEPT
    feeds.upsert(spark.createDataFrame([], "k long, at long"), path, "k", ["at"], buckets=2)
    assert {r.at for r in feeds.read_upserted(spark, path).collect()} == {5}


def test_snapshot_stream_keeps_late_updates(spark, tmp_path):
    """Three batches, an old update last; repeating the job adds nothing."""
    source, out = tmp_path / "in", tmp_path / "out"
    for k, day in enumerate((10, 11, 5)):
        row = [(f"e{k}", dt.datetime(2024, 1, day)), ("again", dt.datetime(2024, 1, 1))]
        spark.createDataFrame(row * 2, "event_id string, last_updated timestamp").coalesce(1).write.parquet(
            str(source / f"p={k}"))
        stream = spark.readStream.schema("event_id string, last_updated timestamp").parquet(str(source))
        for _ in range(2):
            feeds.snapshot_stream(stream, str(out), str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = sorted(r.event_id for r in spark.read.parquet(str(out)).collect())
    assert got == ["again"] * 3 + ["e0", "e1", "e2"]


def test_upsert_reads_touched_buckets_and_leaves_no_stage(spark, tmp_path):
    import glob

    from frostline.session import shared_folder

    path = str(tmp_path / "t")
    for k in range(3):
        feeds.upsert(spark.createDataFrame([(k, k, "a")], "k long, at long, v string"), path, "k", ["at"], buckets=8)
    assert feeds.read_upserted(spark, path).count() == 3
    # The folder of this session: others may share the one above.
    own = f"{shared_folder(spark).removeprefix('file://')}/frostline/{spark.sparkContext.applicationId}"
    assert not glob.glob(f"{own}/**/upsert-*", recursive=True)


def test_first_row_per_key_of_the_second_pass(spark):
    a = spark.createDataFrame([("k", "", "first pass", 1)], "x string, y string, v string, n int")
    b = spark.createDataFrame([("k", None, "known", 1), ("m", None, "late", 9), ("m", " ", "early", 2), ("m", "", "zz", 5)], a.schema)
    got = cleaning.merge_passes(a, b, ["x", "y"], ["n"])
    assert sorted((r.x, r.v) for r in got.collect()) == [("k", "first pass"), ("m", "early")]


def test_snapshot_stream_drops_repeats(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    at = dt.datetime(2024, 1, 1, 12)
    df = spark.createDataFrame([("a", at), ("a", at), ("b", at)], "event_id string, last_updated timestamp")
    df.coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema(df.schema).parquet(str(source))
    feeds.snapshot_stream(stream, str(out), str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(out))
    assert got.count() == 2 and "fetched_at" in got.columns


def test_records_and_alert_features(spark):
    raw = spark.createDataFrame([("1", "Main "), ("x", "bad"), ("2", None)], "FID string, ST_NAME string")
    mids = spark.createDataFrame([(1, 40.0, -80.0)], "objectid long, mid_lat double, mid_lng double")
    got = documents.segment_records(raw, mids).orderBy("objectid").collect()
    assert [(g.objectid, g.streetname, g.mid_lat) for g in got] == [(1, "Main", 40.0), (2, "", None)]
    records = [(json.dumps({"id": "e1", "county": " Allegheny", "isFullClosure": True, "startDate": "d"}),), (json.dumps({"id": "e2"}),)]
    events = documents.traffic_events(spark.createDataFrame(records, "feature string"))
    assert [(e.event_id, e.is_full_closure, e.start_time) for e in cleaning.in_county(events, "allegheny").collect()] == [("e1", True, "d")]
    alert = {"id": "a", "geometry": {"type": "Polygon", "coordinates": []}, "properties": {"event": "Ice Storm Warning", "severity": "Severe"}}
    row = feeds.alert_events(documents.alert_rows(spark.createDataFrame([(json.dumps(alert),)], "feature string"))).first()
    assert (row.source_event_id, row.event_type, row.severity) == ("nws-a", "winter_condition", 4)
    assert json.loads(row.geometry)["type"] == "Polygon"


def test_updates_and_alerts(spark):
    df = spark.createDataFrame([(1, 0.1, 1), (2, 0.8, 1), (3, 1.5, 1)], "segment_id long, closure_probability double, updated_at long")
    got = {r.segment_id: (r.label, r.score) for r in feeds.prediction_updates(df).collect()}
    assert got == {1: ("open", 90.0), 2: ("closed", 20.0)}
    alerts = spark.createDataFrame([("1", "Wind Chill Advisory", "Severe", "h", "d" * 600, "a", "b", "G"), ("2", "Flood", None, "h", None, "a", "b", "G"),
                                    ("3", "Snow", "Minor", "h", "d", "a", "b", None)],
                                   "id string, event string, severity string, headline string, description string, onset string, expires string, geometry string")
    got = {r.source_event_id: r for r in feeds.alert_events(alerts).collect()}
    assert set(got) == {"nws-1", "nws-2"} and got["nws-1"].event_type == "winter_condition" and len(got["nws-1"].description) == 500
    assert (got["nws-2"].event_type, got["nws-2"].severity, got["nws-2"].description) == ("weather_alert", 1, "")


def test_feature_texts_are_parsed_once(spark):
    # One parse of the feature and one of the coordinates of each kind; filters repeat none of them.
    rows = spark.createDataFrame([("a", '{"geometry":{"type":"Point","coordinates":[-80,40]}}', 1)], "label string, feature string, ordinal long")
    for df, most in ((documents.trace_points(rows), 3), (documents.line_segments(rows), 2), (documents.line_midpoints(rows), 4)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json") <= most
    found = documents.trace_points(rows).first()
    assert (found.latitude, found.longitude) == (40.0, -80.0)
