"""Static features and the training matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.functions import encode
from frostline.operators.cleaning import column_medians, keep_first
from frostline.operators.labels import risk_labels
from frostline.session import cut_lineage

# Feature names in matrix order.
MEDIAN_FILLED = ["speedlimit", "num_lanes", "roadwidth", "elevation_m"]
FLAGS = ["near_steep_slope", "near_landslide", "is_bridge", "is_snow_emergency_route"]
HISTORY = ["winter_crash_count", "winter_crash_fatal", "snow_complaint_count", "plow_coverage_score"]
CLOSURES = ["domi_closure_count", "domi_full_closure_count"]
ORDINALS = [("domi_class", encode.ROAD_CLASS, 1), ("paveclass", encode.PAVEMENT, 0),
            ("highway_type_osm", encode.HIGHWAY, 0), ("surface_osm", encode.SURFACE, 0), ("oneway", encode.ONEWAY, 0)]
ROUTES = ["penndot_aadt", "penndot_pavement_idx"]
WEATHER = ["total_snowfall_cm", "max_daily_snowfall_cm", "min_temp_c", "max_wind_kmh", "duration_days",
           "precip_total_mm"]
TEMPORAL = ["day_offset", "days_since_peak_snowfall", "is_post_storm", "cumulative_snowfall_cm",
            "cumulative_thaw_degree_hours", "daily_snowfall_cm"]
INTERACTIONS = ["snow_x_steep_slope", "snow_x_incline", "temp_x_bridge", "wind_x_roadwidth", "snow_x_elevation"]
TEMPORAL_INTERACTIONS = ["thaw_x_steep_slope", "post_storm_x_elevation", "day_offset_x_snow"]
LABEL_VARIANTS = ["label_any_incident", "label_top_1pct", "label_top_5pct"]
STATIC = (MEDIAN_FILLED + FLAGS + [x for c in HISTORY for x in (c, f"{c}_log")] + CLOSURES
          + [f"{c}_enc" for c, _, _ in ORDINALS] + ROUTES
          + ["has_penndot_data", "incline_pct", "bridge_age_years", "mid_lat", "mid_lng"])
FEATURES = STATIC + WEATHER + TEMPORAL + INTERACTIONS + TEMPORAL_INTERACTIONS
MATRIX = ["objectid", "storm_id", "risk_score"] + LABEL_VARIANTS + FEATURES + ["season"]


def fit_medians(segments: DataFrame) -> DataFrame:
    """Medians used for filling, fitted once on de-duplicated segments and kept with the model."""
    return column_medians(segments.select(*[
        encode.number(F.col(c)).alias(c) for c in MEDIAN_FILLED if c in segments.columns]),
        [c for c in MEDIAN_FILLED if c in segments.columns])


def static_features(enriched: DataFrame, medians: DataFrame | None = None, ordinal: str | None = None) -> DataFrame:
    """Encoded features, one row per segment with a position; absent columns take their default."""
    if ordinal:
        enriched = keep_first(enriched, ["objectid"], ordinal)
    have = set(enriched.columns)
    medians = fit_medians(enriched) if medians is None else medians
    fill = medians.agg(F.map_from_entries(F.collect_list(F.struct("column", "median"))).alias("m")).scalar()
    # One entry per filled column.
    df = enriched.withColumn("_fill", fill)

    def num(c, default):
        return F.coalesce(encode.number(F.col(c)), F.lit(default)) if c in have else F.lit(float(default))

    cols = [F.col("objectid")]
    for c in MEDIAN_FILLED:
        cols.append((F.coalesce(encode.number(F.col(c)), F.try_element_at("_fill", F.lit(c)), F.lit(0.0))
                     if c in have else F.lit(0.0)).alias(c))
    cols += [(encode.is_true(F.col(c)).cast("int") if c in have else F.lit(0)).alias(c) for c in FLAGS]
    for c in HISTORY:
        cols += [num(c, 0.0).alias(c), F.log1p(num(c, 0.0)).alias(f"{c}_log")]
    cols += [num(c, 0.0).alias(c) for c in CLOSURES]
    cols += [(encode.code(F.col(c), codes, unknown) if c in have else F.lit(0)).alias(f"{c}_enc")
             for c, codes, unknown in ORDINALS]
    cols += [num(c, -1.0).alias(c) for c in ROUTES]
    cols.append((num("penndot_aadt", -1.0) != -1).cast("int").alias("has_penndot_data"))
    cols.append((encode.incline_percent(F.col("incline")) if "incline" in have else F.lit(0.0)).alias("incline_pct"))
    cols += [num("bridge_age_years", 0.0).alias("bridge_age_years"),
             encode.number(F.col("mid_lat")).alias("mid_lat"), encode.number(F.col("mid_lng")).alias("mid_lng")]
    out = df.select(*cols).dropna(subset=["mid_lat", "mid_lng"])
    return out.select("objectid", *[F.col(c).cast("float").alias(c) for c in STATIC])


def weather_features(storms: DataFrame, days: DataFrame) -> DataFrame:
    """Storm and day weather, one row per storm day; missing values are 0."""
    joined = storms.select("storm_id", "season", *WEATHER).join(days.select("storm_id", *TEMPORAL), "storm_id")
    return joined.select("storm_id", "season", *[
        F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c != "day_offset" else F.col(c)
        for c in WEATHER + TEMPORAL])


def with_interactions(df: DataFrame) -> DataFrame:
    """Weather by road and day by road products."""
    def c(name):
        return F.col(name).cast("double")

    products = {
        "snow_x_steep_slope": c("total_snowfall_cm") * c("near_steep_slope"),
        "snow_x_incline": c("total_snowfall_cm") * F.abs(c("incline_pct")),
        "temp_x_bridge": -c("min_temp_c") * c("is_bridge"),
        "wind_x_roadwidth": c("max_wind_kmh") / (c("roadwidth") + 1),
        "snow_x_elevation": c("total_snowfall_cm") * c("elevation_m") / 1000,
        "thaw_x_steep_slope": c("cumulative_thaw_degree_hours") * c("near_steep_slope"),
        "post_storm_x_elevation": c("is_post_storm") * c("elevation_m") / 1000,
        "day_offset_x_snow": c("day_offset") * c("total_snowfall_cm"),
    }
    return df.withColumns({k: v.cast("float") for k, v in products.items()})


def training_matrix(static: DataFrame, storms: DataFrame, days: DataFrame, measures: DataFrame) -> DataFrame:
    """Labels with static, weather and interaction features.

    The features ride along while the label grid is unfolded, so the dense rows are never joined to them; the
    weather of a storm day is a table of calendar size.
    """
    labels = risk_labels(static, storms, measures).drop("season", "total_snowfall_cm")
    return _finish(labels.join(cut_lineage(weather_features(storms, days), "weather"), ["storm_id", "day_offset"]))


def join_matrix(labels: DataFrame, static: DataFrame, storms: DataFrame, days: DataFrame) -> DataFrame:
    """The same matrix from labels read back from storage."""
    labels = labels.select("objectid", "storm_id", "day_offset", "risk_score", *LABEL_VARIANTS)
    return _finish(labels.join(static, "objectid").join(weather_features(storms, days), ["storm_id", "day_offset"]))


def _finish(joined: DataFrame) -> DataFrame:
    df = with_interactions(joined)
    return df.select(*[
        F.coalesce(F.col(c).cast("float"), F.lit(0.0).cast("float")).alias(c) if c in FEATURES else F.col(c)
        for c in MATRIX])
