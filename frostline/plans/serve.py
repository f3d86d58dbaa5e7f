"""Queries over segments and predictions: conditions in boxes, risk along routes, inventory.

Segments are (objectid, coords, streetname, domi_class, length_m, ...); predictions are (day_offset, objectid,
risk_score, risk_category).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.functions import geo, risk
from frostline.operators.spatial import bbox_overlap, nearest_join, pairs_within

# Route sampling and matching distances.
SAMPLE_M = 50.0
MATCH_M = 50.0


def with_bounds(segments: DataFrame) -> DataFrame:
    return segments.select("*", *geo.line_bounds(F.col("coords")))


def with_predictions(rows: DataFrame, predictions: DataFrame) -> DataFrame:
    """Prediction per (day_offset, objectid); without one the risk is 0 and very_low."""
    known = predictions.select("day_offset", "objectid", "risk_score", "risk_category")
    return rows.join(known, ["day_offset", "objectid"], "left").withColumns({
        "risk_score": F.coalesce("risk_score", F.lit(0.0)),
        "risk_category": F.coalesce("risk_category", F.lit("very_low"))})


def as_features(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(
        *keys, "objectid", F.nullif("streetname", F.lit("")).alias("name"),
        risk.highway_tier(F.col("domi_class")).alias("highway"), risk.condition_score(F.col("risk_score")).alias("score"),
        risk.status_label(F.col("risk_category")).alias("label"), F.round("length_m").cast("bigint").alias("length_m"),
        F.col("risk_score").alias("closure_probability"), "risk_category")


def conditions(segments: DataFrame, predictions: DataFrame, boxes: DataFrame) -> DataFrame:
    """Features of the segments in each box (box_id, day_offset, box_min_lng, box_min_lat, box_max_lng, box_max_lat)."""
    # A segment meets its predictions of all days before the boxes, since boxes and segments make far more rows together.
    known = predictions.groupBy("objectid").agg(F.collect_list(F.struct("day_offset", "risk_score", "risk_category")).alias("_days"))
    inside = bbox_overlap(with_bounds(segments).drop("coords").join(known, "objectid", "left"), boxes)
    of_day = F.explode_outer(F.filter("_days", lambda p: p["day_offset"] == F.col("day_offset"))).alias("_p")
    scored = inside.select("*", of_day).withColumns({
        "risk_score": F.coalesce("_p.risk_score", F.lit(0.0)), "risk_category": F.coalesce("_p.risk_category", F.lit("very_low"))})
    return as_features(scored, "box_id", "day_offset")


def segment_conditions(segments: DataFrame, predictions: DataFrame, wanted: DataFrame) -> DataFrame:
    """Features of single segments, asked for as (objectid, day_offset)."""
    return as_features(with_predictions(wanted.distinct().join(segments, "objectid"), predictions), "day_offset")


def only_route(features: DataFrame, route_segments: DataFrame) -> DataFrame:
    return features.join(route_segments.select("objectid").distinct(), "objectid", "left_semi")


def status_counts(features: DataFrame, keys: list[str]) -> DataFrame:
    """Features per label and the verdict on the whole view."""
    labels = list(risk.FIVE_LABELS.values())
    counts = features.groupBy(*keys).agg(
        *[F.count_if(F.col("label") == label).alias(label) for label in labels], F.count("*").alias("total"))
    high = (F.col("high_risk") + F.col("closed")) / F.col("total")
    moderate = F.col("moderate_risk") / F.col("total")
    return counts.withColumn("verdict", F.when(F.col("total") == 0, "No Data").when(high > 0.15, "High Risk")
                             .when((high > 0.05) | (moderate > 0.20), "Moderate Risk")
                             .when(moderate > 0.05, "Low Risk").otherwise("Roads Clear"))


def segments_near(points: DataFrame, segments: DataFrame, radius_m: float) -> DataFrame:
    """Segments with a vertex within the radius of each point (point_id, lat, lng), with the smallest distance."""
    vertices = segments.select("objectid", F.explode("coords").alias("_v")).select(
        "objectid", F.col("_v.lat").alias("_vlat"), F.col("_v.lng").alias("_vlng")).distinct()
    near = pairs_within(points, vertices, radius_m, place_at=("_vlat", "_vlng"), metric="sphere")
    return near.groupBy("point_id", "objectid").agg(F.min("distance_m").alias("distance_m"))


def match_routes(routes: DataFrame, segments: DataFrame) -> DataFrame:
    """Segments along each route (route_id, day_offset, coords): the nearest one to each sampled point, once each."""
    sampled = routes.select("route_id", "day_offset", F.posexplode(geo.thin_line(F.col("coords"), SAMPLE_M)).alias(
        "place", "_p")).select("route_id", "day_offset", "place", F.col("_p.lat").alias("lat"), F.col("_p.lng").alias("lng"))
    vertices = segments.select("objectid", F.explode("coords").alias("_v")).select(
        "objectid", F.col("_v.lat").alias("_vlat"), F.col("_v.lng").alias("_vlng"))
    near = nearest_join(sampled, vertices, MATCH_M, "objectid", ["objectid"], base_at=("lat", "lng"),
                        target_at=("_vlat", "_vlng"), metric="sphere")
    return near.where(F.col("objectid").isNotNull()).groupBy("route_id", "day_offset", "objectid").agg(
        F.min("place").cast("bigint").alias("first_place"))


def route_risk(matched: DataFrame, predictions: DataFrame) -> DataFrame:
    """Mean and largest risk over the matched segments of each route."""
    scored = with_predictions(matched, predictions)
    agg = scored.groupBy("route_id", "day_offset").agg(
        F.avg("risk_score").alias("_avg"), F.max("risk_score").alias("_max"), F.count("*").alias("matched_segments"))
    return agg.select("route_id", "day_offset", F.round("_avg", 3).alias("average_risk"),
                      F.round("_max", 3).alias("max_risk"), risk.risk_category(F.col("_avg")).alias("risk_category"),
                      "matched_segments")


def route_risk_by_day(matched: DataFrame, predictions: DataFrame) -> DataFrame:
    """Mean risk per route and day over the matched segments that have a prediction that day."""
    hits = matched.select("route_id", "objectid").distinct().join(
        predictions.select("day_offset", "objectid", "risk_score"), "objectid")
    agg = hits.groupBy("route_id", "day_offset").agg(F.avg("risk_score").alias("_avg"))
    return agg.select("route_id", "day_offset", F.round("_avg", 3).alias("average_risk"),
                      risk.risk_category(F.col("_avg")).alias("risk_category"))


def route_segments(matched: DataFrame, segments: DataFrame, predictions: DataFrame) -> DataFrame:
    """The matched segments of each route with risk and label, in order of travel."""
    rows = with_predictions(matched, predictions).join(segments.select("objectid", "streetname"), "objectid")
    return rows.select("route_id", "day_offset", "first_place", "objectid", F.col("streetname").alias("name"),
                       "risk_score", "risk_category", risk.status_label(F.col("risk_category"), "route").alias("label"))


def prediction_status(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("day_offset").agg(F.count("*").alias("predictions"))


def point_features(predictions: DataFrame, attributes: DataFrame) -> DataFrame:
    """One GeoJSON Point feature per prediction, as JSON text."""
    def filled(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0.0))

    rows = predictions.join(attributes.select(
        "objectid", "streetname", "domi_class", "mid_lat", "mid_lng", "is_snow_emergency_route"), "objectid")
    feature = F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array(filled("mid_lng"), filled("mid_lat")).alias("coordinates")
                 ).alias("geometry"),
        F.struct("objectid", F.coalesce("streetname", F.lit("")).alias("streetname"), "risk_score", "risk_category",
                 F.coalesce("domi_class", F.lit("")).alias("domi_class"),
                 F.coalesce("is_snow_emergency_route", F.lit(False)).alias("is_snow_emergency_route")).alias("properties")))
    return rows.select("objectid", feature.alias("feature"))


def prediction_metadata(predictions: DataFrame, scenario: DataFrame, model: str) -> DataFrame:
    """One row: scenario, model, segment count and risk distribution."""
    names = [name for name, _ in risk.CATEGORIES]
    counts = predictions.agg(F.count("*").alias("segment_count"), F.struct(*[
        F.count_if(F.col("risk_category") == n).alias(n) for n in names]).alias("risk_distribution"))
    return counts.select(F.current_timestamp().alias("generated_at"), F.lit(model).alias("model"), "segment_count",
                         "risk_distribution", scenario.select(F.struct("*")).scalar().alias("weather_scenario"))
