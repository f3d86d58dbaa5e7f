"""Geo documents and feeds to rows.

Documents are read as one JSON text per row. A collection is unfolded into features first; the scans below then work
on one feature per row, so large collections stored one feature per line need no unfolding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline import schemas
from frostline.functions import geo
from frostline.functions.encode import text_or_null
from frostline.operators.cleaning import canonical, keep_first

# Road types that are not roads in use.
NOT_IN_USE = ["proposed", "construction", "platform"]
LINE_PROPERTIES = ("objectid bigint, streetname string, domi_class string, roadwidth double, measurlgth double, "
                   "Shape__Length double, oneway string, shape_area double, risk_score double, risk_category string")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per file, as text."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "document")


def features(documents: DataFrame) -> DataFrame:
    """Features of collections as JSON texts, numbered in order: (feature, ordinal)."""
    parts = F.from_json("document", "features array<string>")["features"]
    return documents.select(F.posexplode(parts).alias("ordinal", "feature"))


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly value as a column, as the one element of an unfolded array.

    A filter on a plain column would be moved before it with a copy of the value for each mention, so texts would be parsed
    again for every condition and field.
    """
    return rows.select(*[c for c in rows.columns if c != name], F.explode(F.array(value)).alias(name))


def _parsed(rows: DataFrame) -> DataFrame:
    shape = F.from_json("feature", "type string, geometry struct<type: string, coordinates: string>, "
                                   f"properties struct<{LINE_PROPERTIES.replace(' bigint', ': bigint').replace(' string', ': string').replace(' double', ': double')}>")
    return _once(rows, "_f", shape).select(
        *rows.columns, F.col("_f.geometry.type").alias("_type"), F.col("_f.geometry.coordinates").alias("_coords"),
        F.col("_f.properties").alias("_props"))


def _points(text: Column, depth: int) -> Column:
    """Points of nested coordinate arrays as structs, flattened over all levels."""
    kind = "array<double>"
    for _ in range(depth):
        kind = f"array<{kind}>"
    value = F.from_json(text, kind)
    for _ in range(depth - 1):
        value = F.flatten(value)
    return F.transform(value, lambda p: F.struct(F.element_at(p, 1).alias("lng"), F.element_at(p, 2).alias("lat")))


def line_segments(rows: DataFrame) -> DataFrame:
    """Road segments from LineString features with at least two points; the first of each id is kept."""
    df = _parsed(rows).where((F.col("_type") == "LineString") & F.col("_props.objectid").isNotNull())
    df = _once(df, "coords", _points(F.col("_coords"), 1)).where(F.size("coords") >= 2)
    mid = geo.middle_vertex(F.col("coords"))
    segments = df.select(
        "ordinal", F.col("_props.objectid").alias("objectid"), "coords",
        F.coalesce("_props.streetname", F.lit("")).alias("streetname"),
        F.coalesce("_props.domi_class", F.lit("Local")).alias("domi_class"),
        F.coalesce("_props.roadwidth", F.lit(0.0)).alias("roadwidth"),
        F.coalesce("_props.measurlgth", "_props.Shape__Length", F.lit(0.0)).alias("length_m"),
        F.col("_props.oneway").alias("oneway"), mid["lat"].alias("mid_lat"), mid["lng"].alias("mid_lng"))
    return keep_first(segments, ["objectid"], "ordinal").drop("ordinal")


def line_midpoints(rows: DataFrame) -> DataFrame:
    """Id and mean coordinate of Point, LineString and MultiLineString features; the last of an id counts."""
    df = _parsed(rows).where(F.col("_props.objectid").isNotNull())
    point = F.from_json("_coords", "array<double>")
    flat = (
        F.when(F.col("_type") == "LineString", _points(F.col("_coords"), 1))
        .when(F.col("_type") == "MultiLineString", _points(F.col("_coords"), 2))
        .when(F.col("_type") == "Point", F.transform(F.array(point), lambda p: F.struct(
            F.element_at(p, 1).alias("lng"), F.element_at(p, 2).alias("lat")))))
    df = _once(df, "_flat", flat).where(F.size("_flat") > 0).select(
        F.col("_props.objectid").alias("objectid"), (-F.col("ordinal")).alias("_o"),
        F.round(geo.mean_coordinate(F.col("_flat"), "lat"), 6).alias("mid_lat"),
        F.round(geo.mean_coordinate(F.col("_flat"), "lng"), 6).alias("mid_lng"))
    return keep_first(df, ["objectid"], "_o").drop("_o")


def polygon_centroids(rows: DataFrame) -> DataFrame:
    """Mean of the outer ring and the area property of Polygon and MultiPolygon features."""
    df = _parsed(rows)
    one = F.from_json("_coords", "array<array<array<double>>>")
    many = F.from_json("_coords", "array<array<array<array<double>>>>")
    ring = F.when(F.col("_type") == "Polygon", F.get(one, 0)).when(
        F.col("_type") == "MultiPolygon", F.get(F.get(many, 0), 0))
    pts = F.transform(ring, lambda p: F.struct(F.element_at(p, 1).alias("lng"), F.element_at(p, 2).alias("lat")))
    return _once(df, "_ring", pts).where(F.size("_ring") > 0).select(
        F.col("ordinal").cast("bigint").alias("slope_id"), geo.mean_coordinate(F.col("_ring"), "lat").alias("lat"),
        geo.mean_coordinate(F.col("_ring"), "lng").alias("lng"), F.col("_props.shape_area").alias("slope_area_sqm"))


def trace_points(rows: DataFrame) -> DataFrame:
    """GPS rows: a Point is itself, a LineString its middle vertex. Needs (label, feature)."""
    shape = "geometry struct<type: string, coordinates: string>, properties map<string, string>"
    kind, coords, props = F.col("_f.geometry.type"), F.col("_f.geometry.coordinates"), F.col("_f.properties")
    point = F.transform(F.array(F.from_json(coords, "array<double>")), lambda p: F.struct(
        F.get(p, 0).alias("lng"), F.get(p, 1).alias("lat")))
    df = _once(_once(rows, "_f", F.from_json("feature", shape)), "_line", F.when(kind == "Point", point).when(
        kind == "LineString", _points(coords, 1)))
    middle = geo.middle_vertex(F.col("_line"))

    def prop(*names):
        return F.coalesce(*[text_or_null(F.try_element_at(props, F.lit(n))) for n in names], F.lit(""))

    return df.select(
        F.col("label").alias("event_date"), prop("truck_id", "TRUCK_ID", "id").alias("truck_id"),
        middle["lat"].alias("latitude"), middle["lng"].alias("longitude"), prop("timestamp", "TIMESTAMP", "time").alias("timestamp"),
        F.lit("wprdc_plow").alias("data_source")).dropna(subset=["latitude", "longitude"])


def service_rows(rows: DataFrame) -> DataFrame:
    """Attributes (lower-case keys) and a representative point of feature-service records.

    The point is x and y, or the middle vertex of the first path.
    """
    shape = "attributes map<string, string>, geometry struct<x: double, y: double, paths: array<array<array<double>>>>"
    df = _once(rows, "_f", F.from_json("feature", shape))
    path = F.get(F.col("_f.geometry.paths"), 0)
    middle = F.try_element_at(path, F.floor(F.size(path) / 2).cast("int") + 1)
    keys = F.transform_keys("_f.attributes", lambda k, _: F.lower(k))
    return df.select(
        *rows.columns, keys.alias("attributes"), F.coalesce("_f.geometry.y", F.get(middle, 1)).alias("latitude"),
        F.coalesce("_f.geometry.x", F.get(middle, 0)).alias("longitude"))


def state_routes(rows: DataFrame) -> DataFrame:
    df = service_rows(rows)

    def a(name):
        return F.try_element_at("attributes", F.lit(name))

    return df.select(
        F.coalesce(a("st_rt_no"), F.lit("")).alias("route_no"), F.trim(F.coalesce(a("street_name"), F.lit(""))).alias(
            "street_name"), a("lane_cnt").alias("lane_count"), a("cur_aadt").try_cast("double").alias("aadt"),
        a("overall_pvmnt_idx").try_cast("double").alias("pavement_condition"),
        a("rough_indx").try_cast("double").alias("roughness_index"), F.round("latitude", 6).alias("mid_lat"),
        F.round("longitude", 6).alias("mid_lng"), F.lit("penndot_rms").alias("data_source"))


def road_conditions(rows: DataFrame) -> DataFrame:
    """Winter conditions of several layers. Needs (condition_type, feature)."""
    df = service_rows(rows)

    def first(*names):
        return F.coalesce(*[text_or_null(F.try_element_at("attributes", F.lit(n))) for n in names], F.lit(""))

    return df.select(
        "condition_type", first("route", "st_rt_no", "road_name").alias("route"),
        first("seg_desc", "description", "seg_bgn_desc").alias("segment_desc"), first("county", "cty_code").alias("county"),
        "latitude", "longitude", first("last_updt", "update_date").alias("last_updated"),
        F.lit("penndot_winter").alias("data_source"))


def way_roads(elements: DataFrame) -> DataFrame:
    """Roads from way and node elements (id, type, lat, lon, nodes, tags).

    A way's position is the mean of the nodes it names, once per mention; unknown nodes are left out.
    """
    nodes = elements.where(F.col("type") == "node").select(F.col("id").alias("_node"), "lat", "lon")
    tags = F.col("tags")

    def tag(name):
        return F.coalesce(F.try_element_at(tags, F.lit(name)), F.lit(""))

    ways = elements.where((F.col("type") == "way") & ~tag("highway").isin(NOT_IN_USE))
    members = ways.select(F.col("id").alias("_way"), F.explode("nodes").alias("_node")).join(nodes, "_node")
    middles = members.groupBy("_way").agg(F.round(F.avg("lat"), 6).alias("mid_lat"), F.round(F.avg("lon"), 6).alias("mid_lng"))
    names = ["name", "surface", "lanes", "maxspeed", "oneway", "bridge", "tunnel", "lit", "sidewalk", "cycleway", "width",
             "access", "ref", "incline"]
    return ways.join(middles, ways["id"] == middles["_way"], "left").select(
        F.col("id").alias("osm_id"), tag("highway").alias("highway_type"), *[tag(n).alias(n) for n in names], "mid_lat",
        "mid_lng", F.coalesce(F.size("nodes"), F.lit(0)).alias("node_count"), F.lit("osm").alias("data_source"))


def daily_rows(documents: DataFrame) -> DataFrame:
    """One row per day from parallel daily arrays; short arrays give nulls."""
    shape = ("daily struct<time: array<string>, snowfall_sum: array<double>, temperature_2m_max: array<double>, "
             "temperature_2m_min: array<double>, wind_speed_10m_max: array<double>, precipitation_sum: array<double>, "
             "rain_sum: array<double>, weather_code: array<int>>")
    df = documents.withColumn("_d", F.from_json("document", shape)["daily"])
    fields = ["time", "snowfall_sum", "temperature_2m_max", "temperature_2m_min", "wind_speed_10m_max",
              "precipitation_sum", "rain_sum", "weather_code"]
    kinds = {"time": "string", "weather_code": "int"}
    series = [F.coalesce(F.col(f"_d.{f}"), F.array().cast(f"array<{kinds.get(f, 'double')}>")).alias(f) for f in fields]
    rows = df.select(F.inline(F.arrays_zip(*series))).where(
        F.col("time").isNotNull())
    return rows.select(
        F.col("time").try_cast("date").alias("date"), F.col("snowfall_sum").alias("snowfall_cm"),
        F.col("temperature_2m_max").alias("temp_max_c"), F.col("temperature_2m_min").alias("temp_min_c"),
        F.col("wind_speed_10m_max").alias("wind_max_kmh"), F.col("precipitation_sum").alias("precip_mm"),
        F.col("rain_sum").alias("rain_mm"), "weather_code", F.lit("open_meteo").alias("data_source"))


def forecast_periods(documents: DataFrame) -> DataFrame:
    """Periods of a forecast document, whether it is wrapped in properties, bare, or a plain list."""
    period = ("array<struct<name: string, startTime: string, temperature: double, temperatureUnit: string, "
              "windSpeed: string, shortForecast: string, detailedForecast: string, isDaytime: boolean, "
              "probabilityOfPrecipitation: struct<value: double>>>")
    wrapped = F.from_json("document", f"properties struct<periods: {period}>, periods {period}")
    listed = F.when(F.ltrim("document").startswith("["), F.from_json("document", period))
    df = documents.select("forecast_id", F.posexplode(F.coalesce(
        listed, wrapped["properties"]["periods"], wrapped["periods"])).alias("period_no", "_p"))
    return df.select(
        "forecast_id", "period_no", F.col("_p.startTime").alias("start_time"), F.col("_p.temperature").alias("temperature"),
        F.col("_p.temperatureUnit").alias("temperature_unit"), F.col("_p.windSpeed").alias("wind_speed"),
        F.col("_p.shortForecast").alias("short_forecast"), F.col("_p.detailedForecast").alias("detailed_forecast"),
        F.col("_p.isDaytime").alias("is_daytime"), F.col("_p.probabilityOfPrecipitation.value").alias("precip_chance"))


def stored_predictions(rows: DataFrame) -> DataFrame:
    """Day 0 predictions from stored features; a missing score is 0 and a missing category very_low."""
    df = _parsed(rows).where(F.coalesce("_props.objectid", F.lit(0)) != 0)
    return df.select(
        F.lit(0).cast("bigint").alias("day_offset"), F.col("_props.objectid").alias("objectid"),
        F.coalesce("_props.risk_score", F.lit(0.0)).alias("risk_score"),
        F.coalesce("_props.risk_category", F.lit("very_low")).alias("risk_category"))


def segment_records(records: DataFrame, midpoints: DataFrame) -> DataFrame:
    """Tabular road records under their canonical names, with the midpoint of their geometry looked up by id."""
    df = canonical(records, schemas.SEGMENT_ALIASES, "wprdc_centerlines").withColumn(
        "objectid", F.col("objectid").try_cast("bigint")).where(F.col("objectid").isNotNull())
    return df.join(midpoints.select("objectid", "mid_lat", "mid_lng"), "objectid", "left")


def traffic_events(rows: DataFrame) -> DataFrame:
    """Traffic events from service records, one JSON text per row."""
    fields = {"event_id": "id", "event_type": "type", "roadway": "roadwayName", "direction": "direction", "county": "county",
              "description": "description", "location_description": "locationDescription", "start_time": "startDate",
              "end_time": "endDate", "last_updated": "lastUpdated"}
    shape = ", ".join(f"{name} string" for name in fields.values()) + ", isFullClosure boolean"
    df = _once(rows, "_r", F.from_json("feature", shape))
    return df.select(
        *[F.coalesce(F.trim(F.col("_r")[name]), F.lit("")).alias(out) for out, name in fields.items()],
        F.coalesce("_r.isFullClosure", F.lit(False)).alias("is_full_closure"), F.lit("511pa").alias("data_source"))


def alert_rows(rows: DataFrame) -> DataFrame:
    """Weather alerts from features, with their geometry as JSON text."""
    names = ["event", "severity", "headline", "description", "onset", "expires"]
    shape = f"id string, geometry string, properties struct<{', '.join(f'{n}: string' for n in names)}>"
    df = _once(rows, "_r", F.from_json("feature", shape))
    return df.select("_r.id", *[F.col(f"_r.properties.{n}").alias(n) for n in names], "_r.geometry")
