"""Segments with road, terrain, structure and incident attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.functions.encode import is_true, name_key, number
from frostline.operators.spatial import distinct_positions, nearest_join, radius_counts, radius_flag, radius_flags
from frostline.session import cut_lineage

# Reach of each join in metres, and the column order of the result.
NAME_FALLBACK_M = 100.0
ROUTE_M = 100.0
STRUCTURE_M = 50.0
INCIDENT_M = 200.0
PLOW_M = 100.0
COLUMNS = [
    "objectid", "streetname", "domi_class", "paveclass", "speedlimit", "num_lanes", "roadwidth", "oneway",
    "highway_type_osm", "surface_osm", "mid_lat", "mid_lng", "elevation_m", "incline", "near_steep_slope",
    "near_landslide", "is_bridge", "bridge_age_years", "penndot_route", "penndot_aadt", "penndot_pavement_idx",
    "winter_crash_count", "winter_crash_fatal", "snow_complaint_count", "plow_coverage_score",
    "is_snow_emergency_route", "domi_closure_count", "domi_full_closure_count",
]


def road_attributes(segments: DataFrame, roads: DataFrame, ordinal: str = "osm_id") -> DataFrame:
    """Road type, surface and incline by street name, else from the nearest road.

    Per name and column the first value by ``ordinal`` counts. Rows still without a road type take all three
    values of the nearest road in reach. Rows without a name match none.
    """
    fields = ["highway_type", "surface", "incline"]
    named = roads.withColumn("_key", name_key(F.col("name"))).where(F.col("_key").isNotNull())
    by_name = named.groupBy("_key").agg(*[
        F.min_by(f, F.when(F.col(f).isNotNull(), F.col(ordinal))).alias(f"_n_{f}") for f in fields])
    joined = cut_lineage(segments.withColumn("_key", name_key(F.col("streetname"))).join(by_name, "_key", "left"), "named")
    # Only rows without a road type search by distance; the others pass with no position.
    search = F.col("_n_highway_type").isNull()
    joined = joined.withColumn("_slat", F.when(search, F.col("mid_lat"))).withColumn(
        "_slng", F.when(search, F.col("mid_lng")))
    near = nearest_join(
        joined, roads.select(F.col(ordinal).alias("_rid"), *[F.col(f).alias(f"_f_{f}") for f in fields],
                             F.col("mid_lat").alias("_rlat"), F.col("mid_lng").alias("_rlng")),
        NAME_FALLBACK_M, "_rid", [f"_f_{f}" for f in fields], base_at=("_slat", "_slng"), target_at=("_rlat", "_rlng"))
    found = F.col("distance_m").isNotNull()
    out = {"highway_type": "highway_type_osm", "surface": "surface_osm", "incline": "incline"}
    return near.select(*segments.columns, *[
        F.when(found, F.col(f"_f_{f}")).otherwise(F.col(f"_n_{f}")).alias(out[f]) for f in fields])


def route_attributes(segments: DataFrame, routes: DataFrame, order: str = "route_no",
                     positions: DataFrame | None = None) -> DataFrame:
    """Route number, traffic and pavement of the nearest state route."""
    renamed = routes.select(
        F.col(order).alias("_rid"), F.col("route_no").alias("penndot_route"), F.col("aadt").alias("penndot_aadt"),
        F.col("pavement_condition").alias("penndot_pavement_idx"), F.col("mid_lat").alias("_rlat"),
        F.col("mid_lng").alias("_rlng"))
    return nearest_join(segments, renamed, ROUTE_M, "_rid",
                        ["penndot_route", "penndot_aadt", "penndot_pavement_idx"],
                        target_at=("_rlat", "_rlng"), positions=positions).drop("distance_m")


def bridge_age(segments: DataFrame, bridges: DataFrame, as_of_year: int = 2026,
               positions: DataFrame | None = None) -> DataFrame:
    """Age of the nearest bridge of known year."""
    dated = bridges.where(F.col("year_built").isNotNull()).select(
        "bridge_id", F.col("year_built").cast("bigint").alias("_year"), "latitude", "longitude")
    near = nearest_join(segments, dated, STRUCTURE_M, "bridge_id", ["_year"], positions=positions)
    return near.withColumn("bridge_age_years", F.lit(as_of_year) - F.col("_year")).drop("_year", "distance_m")


def steep_slopes(segments: DataFrame, slopes: DataFrame, ordinal: str = "slope_id") -> DataFrame:
    """Whether a steep area lies within 50 great-circle metres, with the area of the first one in file order."""
    return radius_flag(segments, slopes, STRUCTURE_M, "near_steep_slope", target_at=("lat", "lng"), metric="sphere",
                       carry=("slope_area_sqm", ordinal))


def enrich_segments(segments: DataFrame, *, roads: DataFrame, elevation: DataFrame, slopes: DataFrame,
                    bridges: DataFrame, landslides: DataFrame, crashes: DataFrame, complaints: DataFrame,
                    plow: DataFrame, routes: DataFrame, closures: DataFrame, priority: DataFrame,
                    route_order: str = "route_no") -> DataFrame:
    """The master join.

    Positions are stored once and every spatial result is keyed by them, so the segments are read once and shuffled on
    their position once.
    """
    at = cut_lineage(distinct_positions(segments), "positions")
    df = road_attributes(segments, roads)
    df = df.join(elevation.select("objectid", "elevation_m"), "objectid", "left")
    df = df.join(slopes.select("objectid", "near_steep_slope"), "objectid", "left").withColumn(
        "near_steep_slope", F.coalesce("near_steep_slope", F.lit(False)))
    spots = {"is_bridge": bridges, "near_landslide": landslides, "is_snow_emergency_route": priority.select(
        F.col("mid_lat").alias("latitude"), F.col("mid_lng").alias("longitude"))}
    df = radius_flags(df, spots, STRUCTURE_M, positions=at)
    df = radius_counts(df, {
        "winter_crash_count": crashes, "winter_crash_fatal": crashes.where(number(F.col("fatal_count")) > 0),
        "snow_complaint_count": complaints, "domi_closure_count": closures,
        "domi_full_closure_count": closures.where(is_true(F.col("full_closure")))}, INCIDENT_M, positions=at)
    df = radius_counts(df, {"plow_coverage_score": plow}, PLOW_M, positions=at)
    df = bridge_age(df, bridges, positions=at)
    df = route_attributes(df, routes, route_order, positions=at)
    return df.select(*[c for c in COLUMNS if c in df.columns])
