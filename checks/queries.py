"""Registered queries: each runs one capability over whole projections of the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from checks.fixtures import FOREST, projection
from frostline.functions import geo, risk, weather
from frostline.functions.encode import day_of_millis, name_key, number
from frostline.operators import cleaning, graph, labels, ordered, ranking, spatial, storms
from frostline.plans import enrich, model, scenario, serve, training
from frostline.session import cut_lineage, new_path
from frostline.sources import documents, files, texts
from frostline.streaming import feeds

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


class Inputs:
    """Projections of one driver folder, and the storm tables derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir, self._storms = spark, sf_dir, None

    def __getattr__(self, name: str) -> DataFrame:
        return projection(self._spark, self._dir, f"fx_{name}")

    @property
    def days(self) -> DataFrame:
        return storms.by_day(cleaning.winter_days(self.weather))

    @property
    def storm_table(self) -> DataFrame:
        # Read by every measure; of calendar size.
        if self._storms is None:
            self._storms = cut_lineage(storms.storm_events(self.days), "storms")
        return self._storms

    @property
    def places(self) -> DataFrame:
        return self.segments.select("objectid", "mid_lat", "mid_lng")

    @property
    def winter_crashes(self) -> DataFrame:
        return cleaning.winter_crashes(self.crashes)

    def measures(self) -> DataFrame:
        table, places = self.storm_table, self.places
        return labels.storm_measures(
            table, labels.complaint_counts(self.complaints, table, places, packed=True),
            labels.crash_scores(self.winter_crashes, table, places), labels.plow_passes(self.plow, table, places),
            labels.closure_days(self.closures, table, places, packed=True))

    @property
    def lines_geo(self) -> DataFrame:
        points = [F.struct(F.col(f"lng{i}").alias("lng"), F.col(f"lat{i}").alias("lat")) for i in range(1, 5)]
        return self.lines.select("objectid", "streetname", "domi_class", "oneway", "length_m",
                                 F.array(*points).alias("coords"))

    @property
    def scored_predictions(self) -> DataFrame:
        return self.predictions.withColumn("risk_category", risk.risk_category(F.col("risk_score")))

    @property
    def routes(self) -> DataFrame:
        vertices = F.array_sort(F.collect_list(F.struct("place", "lng", "lat")))
        # Eight vertices per route.
        return self.route_vertices.groupBy("route_id", "day_offset").agg(vertices.alias("_v")).select(
            "route_id", "day_offset", F.transform("_v", lambda v: F.struct(v["lng"].alias("lng"), v["lat"].alias("lat"))
                                                  ).alias("coords"))

    def enriched(self) -> DataFrame:
        slopes = enrich.steep_slopes(self.places, self.slopes).select("objectid", "near_steep_slope")
        return enrich.enrich_segments(
            self.segments, roads=self.roads, elevation=self.elevation, slopes=slopes, bridges=self.bridges,
            landslides=self.landslides, crashes=self.winter_crashes, complaints=self.complaints, plow=self.plow,
            routes=self.state_routes, closures=self.closures, priority=cleaning.priority_routes(self.segments),
            route_order="route_key")

    def static(self) -> DataFrame:
        return training.static_features(cut_lineage(self.enriched(), "enriched"))

    def matrix(self) -> DataFrame:
        return training.training_matrix(
            cut_lineage(self.static(), "static"), self.storm_table, storms.storm_days(self.storm_table, self.days),
            self.measures())


def _rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


# Storms

@query
def storm_events(spark, sf):
    return storms.storm_events(Inputs(spark, sf).days)


@query
def storm_days(spark, sf):
    i = Inputs(spark, sf)
    return storms.storm_days(i.storm_table, i.days)


# Distance joins

@query
def radius_count(spark, sf):
    i = Inputs(spark, sf)
    return spatial.radius_count(i.places, i.complaints, 200.0, "complaint_count").select("objectid", "complaint_count")


@query
def radius_flag(spark, sf):
    i = Inputs(spark, sf)
    df = spatial.radius_flag(i.places, i.landslides, 50.0, "near_landslide")
    return spatial.radius_flag(df, i.bridges, 50.0, "is_bridge").select("objectid", "near_landslide", "is_bridge")


@query
def steep_slope_flag(spark, sf):
    i = Inputs(spark, sf)
    return enrich.steep_slopes(i.places, i.slopes).select("objectid", "near_steep_slope", "slope_area_sqm")


@query
def closure_segment_pairs(spark, sf):
    i = Inputs(spark, sf)
    closures = i.closures.select("closure_id", "latitude", "longitude")
    near = spatial.pairs_within(closures, i.places, 200.0, point_at=("latitude", "longitude"))
    return _rounded(near.select("closure_id", "objectid", "distance_m"), "distance_m", digits=3)


@query
def nearest_segment(spark, sf):
    i = Inputs(spark, sf)
    near = spatial.nearest_join(i.crashes, i.places, 200.0, "objectid", ["objectid"], base_at=("latitude", "longitude"),
                                target_at=("mid_lat", "mid_lng"))
    return _rounded(near.where(F.col("objectid").isNotNull()).select("crash_crn", "objectid", "distance_m"), "distance_m",
                    digits=3)


@query
def nearest_route(spark, sf):
    i = Inputs(spark, sf)
    return enrich.route_attributes(i.places, i.state_routes, "route_key").select(
        "objectid", "penndot_route", "penndot_aadt", "penndot_pavement_idx")


@query
def bridge_age(spark, sf):
    i = Inputs(spark, sf)
    return enrich.bridge_age(i.places, i.bridges).select("objectid", F.col("bridge_age_years").cast("double").alias(
        "bridge_age_years"))


@query
def name_then_nearest(spark, sf):
    i = Inputs(spark, sf)
    return enrich.road_attributes(i.segments, i.roads).select("objectid", "highway_type_osm", "surface_osm", "incline")


# Labels

@query
def complaint_labels(spark, sf):
    i = Inputs(spark, sf)
    return labels.complaint_counts(i.complaints, i.storm_table, i.places)


@query
def crash_allocation(spark, sf):
    i = Inputs(spark, sf)
    return _rounded(labels.crash_scores(i.winter_crashes, i.storm_table, i.places), "crash_score")


@query
def plow_gaps(spark, sf):
    i = Inputs(spark, sf)
    plowed = cut_lineage(labels.plow_passes(i.plow, i.storm_table, i.places), "plowed")
    return labels.plow_gaps(plowed, i.places)


@query
def closure_flags(spark, sf):
    i = Inputs(spark, sf)
    return labels.closure_days(i.closures, i.storm_table, i.places)


@query
def storm_labels(spark, sf):
    i = Inputs(spark, sf)
    return labels.risk_labels(i.places, i.storm_table, i.measures()).drop("mid_lat", "mid_lng")


@query
def label_profile(spark, sf):
    return _rounded(cleaning.profile(storm_labels(spark, sf), [
        "storm_311_count", "storm_crash_score", "storm_plow_gap", "storm_domi_closure", "risk_score",
        "label_any_incident", "label_top_1pct", "label_top_5pct"]), "min", "max", "mean", digits=5)


@query
def label_summary(spark, sf):
    df = storm_labels(spark, sf).select("objectid", "storm_id", "risk_score")
    return _rounded(cleaning.label_summary(df), "mean_score", "median_score")


# Features and training matrix

@query
def segments_enriched(spark, sf):
    df = Inputs(spark, sf).enriched()
    return df.withColumn("bridge_age_years", F.col("bridge_age_years").cast("double"))


@query
def static_features(spark, sf):
    df = Inputs(spark, sf).static()
    return df.select("objectid", *[F.round(F.col(c).cast("double"), 3).alias(c) for c in training.STATIC])


@query
def training_matrix_profile(spark, sf):
    df = Inputs(spark, sf).matrix()
    agg = df.groupBy("season").agg(
        F.count("*").alias("rows"), F.count_distinct("storm_id").alias("storms"),
        *[F.round(F.avg(F.col(c).cast("double")), 3).alias(c) for c in training.FEATURES + ["risk_score"]])
    return agg


@query
def season_statistics(spark, sf):
    i = Inputs(spark, sf)
    rows = i.scored.join(i.seasons, "storm_id")
    return _rounded(cleaning.season_statistics(rows), "mean", "std")


# Splits, samples, metrics

@query
def season_split(spark, sf):
    return ranking.split_storms(Inputs(spark, sf).seasons)


@query
def capped_sample(spark, sf):
    df = ranking.capped_sample(Inputs(spark, sf).scored)
    return df.select("storm_id", "objectid", "risk_score")


@query
def relevance_grades(spark, sf):
    df = ranking.relevance_grades(Inputs(spark, sf).scored)
    return df.select("storm_id", "objectid", F.col("relevance").cast("bigint").alias("relevance"))


@query
def storm_ranking_metrics(spark, sf):
    df = ranking.storm_ranking_metrics(Inputs(spark, sf).scored)
    return _rounded(df, "ndcg_50", "ndcg_200", "ndcg_500", "recall_200", "recall_500", "spearman")


@query
def ranking_metrics(spark, sf):
    return ranking.mean_ranking_metrics(ranking.storm_ranking_metrics(Inputs(spark, sf).scored))


@query
def regression_metrics(spark, sf):
    return ranking.regression_metrics(Inputs(spark, sf).scored)


@query
def average_precision(spark, sf):
    return ranking.binary_metrics(Inputs(spark, sf).scored)


@query
def score_statistics(spark, sf):
    return ranking.score_statistics(Inputs(spark, sf).scored)


@query
def group_sizes(spark, sf):
    return ranking.group_sizes(Inputs(spark, sf).scored)


#: The two training queries set no rounds of their own: at most 600 and 500, as in production, and fewer where patience ends.
MODEL_ROUNDS = None


@query
def gbt_scores(spark, sf):
    """Train on the sampled matrix, score each scenario day on every segment."""
    i = Inputs(spark, sf)
    matrix = cut_lineage(i.matrix(), "matrix")
    fitted = model.train_ranker(matrix, rounds=MODEL_ROUNDS)
    good, _ = cleaning.check_scenarios(i.scenarios)
    static = matrix.select("objectid", *training.STATIC).dropDuplicates(["objectid"])
    return scenario.predict(fitted, static, scenario.fill_scenarios(good)).select(
        "scenario_id", "day_offset", "objectid", "risk_score", "risk_category")


@query
def feature_importance(spark, sf):
    matrix = cut_lineage(Inputs(spark, sf).matrix(), "matrix")
    return model.top_features(model.train_regression(matrix, rounds=MODEL_ROUNDS))


@query
def forest_scores(spark, sf):
    """Calibrated scores of a given forest, which the SQL twin evaluates as an expression."""
    i = Inputs(spark, sf)
    good, _ = cleaning.check_scenarios(i.scenarios)
    return scenario.predict(FOREST, cut_lineage(i.static(), "static"), scenario.fill_scenarios(good)).select(
        "scenario_id", "day_offset", "objectid", "risk_score", "risk_category")


@query
def importance_share(spark, sf):
    """Percent of total per row, on part sizes per brand instead of a trained model's importances."""
    sums = projection(spark, sf, "part").groupBy("p_brand").agg(F.sum("p_size").cast("double").alias("importance"))
    return ranking.share_of_total(sums.withColumnRenamed("p_brand", "feature"), "importance").select(
        "feature", "importance", "importance_pct")


@query
def training_matrix_rows(spark, sf):
    """Rows of the matrix after its stored form: a digest of each row's features in thousandths, in matrix order.

    They are cut where no value of four decimals lies, so that the last bits of a sum cannot decide.
    """
    path = new_path(spark, "matrix")
    files.write_matrix(Inputs(spark, sf).matrix(), path)
    df = files.read_columns(spark, path, ["storm_id", "objectid", *training.FEATURES, "season"])
    values = [F.coalesce(F.floor(F.col(c).cast("double") * 1000 + 0.2718).cast("bigint").cast("string"), F.lit("")) for c in training.FEATURES]
    return df.select("storm_id", "objectid", F.col("day_offset").cast("bigint").alias("day_offset"), "season",
                     F.md5(F.concat_ws(",", *values)).alias("features"))


# Table files

CRASH_FIELDS = ["crash_crn", "crash_year", "crash_month", "fatal_count", "icy_road", "snow_slush_road", "latitude", "longitude"]
CRASH_SCHEMA = ("crash_crn bigint, crash_year bigint, crash_month bigint, fatal_count int, icy_road string, snow_slush_road string, "
                "latitude double, longitude double, street_name string")


@query
def crash_files(spark, sf):
    """Crashes written with a header and read back by name: a missing file gives way to the next, an absent column is null."""
    path = new_path(spark, "crashes")
    files.write_csv(Inputs(spark, sf).crashes, path, list(reversed(CRASH_FIELDS)))
    return files.read_first(spark, [new_path(spark, "missing"), path], CRASH_SCHEMA).withColumn(
        "street_name", F.coalesce("street_name", F.lit("none")))


@query
def missing_file(spark, sf):
    """Crashes beside an optional file that is not there: each keeps its row, without a value."""
    optional = files.read_csv(spark, new_path(spark, "missing"), "crash_crn bigint, note string")
    return Inputs(spark, sf).crashes.select("crash_crn").join(optional, "crash_crn", "left").select(
        "crash_crn", F.col("note").isNull().alias("bare"))


@query
def written_once(spark, sf):
    """The second write to a path changes nothing."""
    path, crashes = new_path(spark, "once"), Inputs(spark, sf).crashes.select("crash_crn", F.col("crash_year").cast("bigint"))
    files.write_once(crashes.where("crash_year < 1996"), path)
    files.write_once(crashes, path)
    return files.read_columns(spark, path)


@query
def sample_file(spark, sf):
    """The first 1000 crashes by number, through a CSV file."""
    path = new_path(spark, "sample")
    files.write_sample(Inputs(spark, sf).crashes.select("crash_crn", "crash_year"), path, ["crash_crn"])
    return files.read_csv(spark, path, "crash_crn bigint, crash_year bigint")


@query
def ranked_file(spark, sf):
    """Predictions through a CSV of falling risk, and how many of its part files hold a lower score than a later one."""
    path = new_path(spark, "ranked")
    files.write_ranked(Inputs(spark, sf).scored_predictions, path)
    written = spark.read.schema("day_offset bigint, objectid bigint, risk_score double, risk_category string").option(
        "header", True).csv(path)
    bounds = written.groupBy(F.input_file_name().alias("part")).agg(F.min("risk_score").alias("low"), F.max("risk_score").alias("high"))
    # One row a part file: parts follow each other by name.
    beyond = Window.orderBy("part").rowsBetween(1, Window.unboundedFollowing)
    wrong = bounds.withColumn("next", F.max("high").over(beyond)).where(F.col("next") > F.col("low")).count()
    return written.withColumn("parts_out_of_order", F.lit(wrong).cast("bigint"))


# Feeds and features

@query
def timed_closures(spark, sf):
    """Closures whose times are text: rows without a start are dropped, a missing or unreadable end is the start."""
    text = Inputs(spark, sf).closures.select(
        "closure_id", F.when(F.col("closure_id") % 11 == 0, "soon").otherwise(F.col("from_date").cast("string")).alias("from_date"),
        F.when(F.col("closure_id") % 5 == 0, "").otherwise(F.col("to_date").cast("string")).alias("to_date"))
    df = cleaning.timed(text, "from_date", "to_date")
    return df.select("closure_id", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("from_date", "to_date")])


@query
def aligned_features(spark, sf):
    """Segments with the columns a model asks for, in its order: those that a feed lacks are 0, doubles become floats."""
    segments = Inputs(spark, sf).segments.select("objectid", "mid_lat", "mid_lng")
    df = cleaning.to_float(cleaning.align(segments, ["objectid", "mid_lng", "slope_pct", "mid_lat"]))
    return df.select("objectid", *[F.col(c).cast("double").alias(c) for c in ("mid_lng", "slope_pct", "mid_lat")])


@query
def present_columns(spark, sf):
    """The wanted columns that crashes and closures have."""
    i, wanted = Inputs(spark, sf), ["closure_id", "crash_crn", "latitude", "longitude", "neighborhood"]
    found = [cleaning.present_columns(df, wanted) for df in (i.crashes, i.closures)]
    return cleaning.union_feeds(*[_rounded(df, "latitude", "longitude") for df in found])


@query
def release_days(spark, sf):
    """Day of each closure's start from its epoch milliseconds; none for every seventh."""
    millis = F.when(F.col("closure_id") % 7 == 0, "").otherwise(F.unix_millis(F.col("from_date").cast("timestamp")).cast("string"))
    return Inputs(spark, sf).closures.select("closure_id", day_of_millis(millis).alias("day"))


@query
def point_texts(spark, sf):
    """Coordinates from location texts where a closure has none."""
    text = F.format_string("POINT (%.4f %.4f)", "longitude", "latitude")
    bare = F.col("closure_id") % 3 == 0
    df = Inputs(spark, sf).closures.select(
        "closure_id", text.alias("geometry"), *[F.when(~bare, F.col(c)).alias(c) for c in ("latitude", "longitude")])
    df = texts.with_location(df).withColumn("point", texts.wkt_point(F.col("geometry")))
    return df.select("closure_id", *[F.round(c, 4).alias(c) for c in ("latitude", "longitude")],
                     F.col("point.lat").alias("point_lat"), F.col("point.lng").alias("point_lng"))


@query
def route_features(spark, sf):
    """Conditions in the boxes, on the segments of any route only."""
    i = Inputs(spark, sf)
    shown = serve.conditions(i.lines_geo, i.scored_predictions, i.boxes)
    return serve.only_route(shown, i.lines.where("domi_class = 'Collector'")).select("box_id", "day_offset", "objectid", "score", "label")


# Scenarios and forecasts

@query
def rejected_scenarios(spark, sf):
    return cleaning.check_scenarios(Inputs(spark, sf).scenarios)[1].select("scenario_id")


def _scenario_days(i: Inputs) -> DataFrame:
    return scenario.scenario_days(scenario.fill_scenarios(cleaning.check_scenarios(i.scenarios)[0]))


@query
def scenario_days(spark, sf):
    return _rounded(_scenario_days(Inputs(spark, sf)), "cumulative_snowfall_cm", "daily_snowfall_cm")


@query
def scenario_severity(spark, sf):
    return _rounded(scenario.severity(_scenario_days(Inputs(spark, sf))), "severity").select(
        "scenario_id", "day_offset", "severity")


@query
def lingering_snow(spark, sf):
    i = Inputs(spark, sf)
    df = i.scenarios.select(
        "scenario_id", F.col("snowfall_cm").alias("total_snowfall_cm"), F.col("snowfall_cm").alias("max_daily_snowfall_cm"),
        "min_temp_c", "duration_days", F.col("snowfall_cm").alias("precip_total_mm"),
        (F.col("max_wind_kmh") / 3 - 5).alias("recent_snowfall_cm"), F.col("max_wind_kmh").alias("hours_since_snow"),
        F.when(F.col("snowfall_cm") > 20, F.col("min_temp_c") + 8).alias("temp_since_snow_c"))
    out = scenario.with_lingering_snow(df)
    return out.select("scenario_id", "total_snowfall_cm", "max_daily_snowfall_cm", "duration_days", "precip_total_mm",
                      F.col("lingering.thermal_rate").alias("thermal_rate"),
                      F.col("lingering.plow_factor").alias("plow_factor"))


def _calibrated(i: Inputs) -> DataFrame:
    return scenario.calibrate(i.raw_scores, _scenario_days(i))


@query
def calibrated_scores(spark, sf):
    return _calibrated(Inputs(spark, sf)).select("scenario_id", "day_offset", "objectid", "risk_score", "risk_category")


@query
def risk_distribution(spark, sf):
    return scenario.risk_distribution(_calibrated(Inputs(spark, sf)), ["day_offset"])


@query
def highest_risk(spark, sf):
    i = Inputs(spark, sf)
    return scenario.highest_risk(i.predictions.where("day_offset = 0")).select("objectid", "risk_score")


@query
def highest_risk_by_day(spark, sf):
    return scenario.highest_risk(Inputs(spark, sf).predictions, keys=["day_offset"]).select("day_offset", "objectid", "risk_score")


@query
def forecast_summary(spark, sf):
    return scenario.forecast_summary(Inputs(spark, sf).forecast)


@query
def hourly_scenario(spark, sf):
    i = Inputs(spark, sf)
    return scenario.hourly_scenario(i.forecast, i.forecast)


@query
def day_night_pairs(spark, sf):
    df = scenario.day_night_pairs(Inputs(spark, sf).forecast)
    return df.select("forecast_id", "group_no", "day_period", F.coalesce("night_period", F.lit(-1)).alias("night_period"))


@query
def precipitation_bands(spark, sf):
    i = Inputs(spark, sf)
    return i.forecast.select("period_no", weather.precipitation_band(F.col("precip_chance"), F.col("short_forecast")).alias(
        "band"))


# Serving

@query
def conditions_bbox(spark, sf):
    i = Inputs(spark, sf)
    return serve.conditions(i.lines_geo, i.scored_predictions, i.boxes)


@query
def segment_conditions(spark, sf):
    i = Inputs(spark, sf)
    wanted = i.lines.select("objectid", (F.col("objectid") % 7).alias("day_offset"))
    return serve.segment_conditions(i.lines_geo, i.scored_predictions, wanted)


@query
def status_counts(spark, sf):
    i = Inputs(spark, sf)
    return serve.status_counts(serve.conditions(i.lines_geo, i.scored_predictions, i.boxes), ["box_id"])


@query
def segments_near(spark, sf):
    i = Inputs(spark, sf)
    points = i.requests.select(F.col("route_id").alias("point_id"), F.col("from_lat").alias("lat"),
                               F.col("from_lng").alias("lng"))
    return _rounded(serve.segments_near(points, i.lines_geo, 75.0), "distance_m", digits=3)


@query
def route_thinning(spark, sf):
    i = Inputs(spark, sf)
    return i.routes.select("route_id", F.posexplode(geo.thin_line(F.col("coords"), 50.0)).alias("n", "p")).select(
        "route_id", F.col("n").cast("bigint").alias("n"), F.col("p.lng").alias("lng"), F.col("p.lat").alias("lat"))


@query
def route_segments(spark, sf):
    i = Inputs(spark, sf)
    return serve.route_segments(serve.match_routes(i.routes, i.lines_geo), i.lines_geo, i.scored_predictions)


@query
def route_risk(spark, sf):
    i = Inputs(spark, sf)
    return serve.route_risk(serve.match_routes(i.routes, i.lines_geo), i.scored_predictions)


@query
def route_risk_by_day(spark, sf):
    i = Inputs(spark, sf)
    return serve.route_risk_by_day(serve.match_routes(i.routes, i.lines_geo), i.scored_predictions)


@query
def prediction_status(spark, sf):
    return serve.prediction_status(Inputs(spark, sf).predictions)


@query
def stored_predictions(spark, sf):
    """Write predictions by day, rewrite one day, read back."""
    i = Inputs(spark, sf)
    path = new_path(spark, "predictions")
    files.write_predictions(i.scored_predictions, path)
    day = i.scored_predictions.where("day_offset = 2").withColumn("risk_score", F.lit(0.0)).withColumn(
        "risk_category", F.lit("very_low"))
    files.write_predictions(day, path)
    return files.read_predictions(spark, path)


@query
def road_layer(spark, sf):
    i = Inputs(spark, sf)
    roads = i.lines.select("objectid", risk.highway_tier(F.col("domi_class")).alias("highway"), "length_m")
    return cleaning.road_layer(roads)


@query
def line_measures(spark, sf):
    i = Inputs(spark, sf)
    c = F.col("coords")
    mid = geo.middle_vertex(c)
    return i.lines_geo.select(
        "objectid", F.round(geo.line_length_m(c), 3).alias("length"), *geo.line_bounds(c), mid["lat"].alias("mid_lat"),
        F.round(geo.mean_coordinate(c, "lng"), 6).alias("mean_lng"))


# Network

@query
def graph_edges(spark, sf):
    df = graph.road_edges(Inputs(spark, sf).lines_geo)
    return _rounded(df.select("src", "dst", "segment_id", "length_m"), "length_m", digits=3)


def _network(i: Inputs) -> tuple[DataFrame, DataFrame]:
    roads = cut_lineage(graph.road_edges(i.lines_geo), "edges")
    return cut_lineage(graph.road_nodes(roads), "nodes"), roads


@query
def stitched_edges(spark, sf):
    df = graph.stitch_edges(*_network(Inputs(spark, sf)))
    return _rounded(df.select("src", "dst", "length_m"), "length_m", digits=3)


@query
def road_components(spark, sf):
    nodes, roads = _network(Inputs(spark, sf))
    return graph.component_sizes(graph.components(nodes, roads.unionByName(graph.stitch_edges(nodes, roads))))


def _hops(spark, sf) -> DataFrame:
    i = Inputs(spark, sf)
    return graph.safest_routes(i.requests, i.lines_geo, i.predictions)


@query
def safest_routes(spark, sf):
    return graph.route_summary(_hops(spark, sf))


@query
def safest_route_steps(spark, sf):
    return graph.route_steps(_hops(spark, sf))


@query
def safest_route_geometry(spark, sf):
    df = graph.route_geometry(_hops(spark, sf))
    return df.select("route_id", F.size("coords").cast("bigint").alias("points"), F.element_at("coords", 1)["lng"].alias(
        "first_lng"), F.element_at("coords", -1)["lat"].alias("last_lat"))


# Cleaning and texts

@query
def alert_events(spark, sf):
    return feeds.alert_events(Inputs(spark, sf).alerts.withColumn("onset", F.col("ts").cast("string")).withColumn(
        "expires", F.lit(""))).select("source_event_id", "event_type", "severity", "event", "description")


@query
def winter_alerts(spark, sf):
    return feeds.winter_alerts(Inputs(spark, sf).alerts).select("id", "event")


@query
def closure_text(spark, sf):
    return texts.closures_in_text(Inputs(spark, sf).releases, "html", ["release_id"])


@query
def location_text(spark, sf):
    df = Inputs(spark, sf).location_text.withColumn("at", texts.location_point(F.col("geometry")))
    return df.select("closure_id", F.col("at.lat").alias("latitude"), F.col("at.lng").alias("longitude"))


@query
def page_text(spark, sf):
    """Tag stripping over whole web pages."""
    pages = projection(spark, sf, "pages")
    text = F.trim(texts.plain_text(F.col("html")))
    return pages.select("page_id", F.length(text).cast("bigint").alias("n_chars"), F.md5(text).alias("digest"))


@query
def winter_crash_filter(spark, sf):
    return Inputs(spark, sf).winter_crashes.select("crash_crn")


@query
def snow_complaints(spark, sf):
    return cleaning.snow_complaints(Inputs(spark, sf).complaint_types)


@query
def complaint_types(spark, sf):
    return cleaning.frequency(Inputs(spark, sf).complaint_types, "request_type")


@query
def region_filter(spark, sf):
    i = Inputs(spark, sf)
    named = i.landslides.withColumn("region", F.when(F.col("region") == "BUILDING", "Pennsylvania").otherwise(F.col("region")))
    return cleaning.in_region(named, "latitude", "longitude", "region").select("landslide_id")


@query
def county_filter(spark, sf):
    return cleaning.in_county(Inputs(spark, sf).counties, "allegheny").select("event_id")


@query
def priority_routes(spark, sf):
    return cleaning.priority_routes(Inputs(spark, sf).segments).select("objectid", "domi_class")


@query
def winter_days(spark, sf):
    return cleaning.winter_days(Inputs(spark, sf).weather).select("date", "snowfall_cm")


@query
def column_medians(spark, sf):
    i = Inputs(spark, sf)
    numeric = i.segments.select(*[number(F.col(c)).alias(c) for c in ("speedlimit", "num_lanes", "roadwidth")])
    return cleaning.column_medians(numeric, numeric.columns)


@query
def first_per_name(spark, sf):
    """Keep-first de-duplication of roads by street name."""
    df = Inputs(spark, sf).roads.withColumn("key", name_key(F.col("name"))).where(F.col("key").isNotNull())
    return cleaning.keep_first(df.select("key", "osm_id", "highway_type"), ["key"], "osm_id")


@query
def merged_passes(spark, sf):
    """Closures found in short and in whole texts, de-duplicated on four keys."""
    releases = Inputs(spark, sf).releases
    keys = ["route_number", "road_name", "status", "release_id"]
    whole = texts.closures_in_text(releases, "html", ["release_id"])
    start = texts.closures_in_text(releases.withColumn("html", F.substring_index("html", " - ", 1)), "html", ["release_id"])
    return cleaning.merge_passes(start, whole, keys)


@query
def exact_percentiles(spark, sf):
    df = ordered.exact_percentiles(Inputs(spark, sf).scored, ["storm_id"], "prediction", {
        "p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99})
    return _rounded(df, "p25", "p50", "p75", "p99")


# Documents: Spark writes the projections as GeoJSON texts, the scans read them back

def _line_features(i: Inputs) -> DataFrame:
    points = F.transform("coords", lambda p: F.array(p["lng"], p["lat"]))
    feature = F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.when(F.col("length_m") == 0, "MultiLineString").otherwise("LineString").alias("type"),
                 F.when(F.col("length_m") == 0, F.to_json(F.array(points))).otherwise(F.to_json(points)).alias("coordinates")
                 ).alias("geometry"),
        F.struct("objectid", "streetname", "domi_class", F.col("length_m").alias("measurlgth"), "oneway").alias("properties")))
    # to_json quotes the nested text; the coordinates must be an array in the document.
    plain = F.regexp_replace(F.regexp_replace(feature, r'"coordinates":"', '"coordinates":'), r'\]"\}', "]}")
    return i.lines_geo.select(plain.alias("feature"), F.col("objectid").alias("ordinal"))


@query
def geojson_lines(spark, sf):
    df = documents.line_segments(_line_features(Inputs(spark, sf)))
    return df.select("objectid", F.size("coords").cast("bigint").alias("points"), "streetname", "domi_class", "length_m",
                     "mid_lat", "mid_lng")


@query
def geojson_midpoints(spark, sf):
    return documents.line_midpoints(_line_features(Inputs(spark, sf)))


@query
def geojson_polygons(spark, sf):
    i = Inputs(spark, sf)
    c = F.format_string('{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[%s,%s],[%s,%s],[%s,%s]]]},'
                        '"properties":{"shape_area":%s}}',
                        *[x.cast("string") for k in (0, 1, 2) for x in (F.col("lng") + k * 1e-4, F.col("lat") + k * k * 1e-4)],
                        F.col("slope_area_sqm").cast("string"))
    df = documents.polygon_centroids(i.slopes.select(c.alias("feature"), F.col("slope_id").alias("ordinal")))
    return _rounded(df, "lat", "lng")


@query
def plow_traces(spark, sf):
    i = Inputs(spark, sf)
    kind = F.when(F.col("event_date") < "1997", F.concat(
        F.lit('{"geometry":{"type":"Point","coordinates":['), F.col("longitude").cast("string"), F.lit(","),
        F.col("latitude").cast("string"), F.lit(']},"properties":{"TRUCK_ID":"T1"}}'))).otherwise(F.concat(
            F.lit('{"geometry":{"type":"LineString","coordinates":[[0,0],['), F.col("longitude").cast("string"), F.lit(","),
            F.col("latitude").cast("string"), F.lit(']]},"properties":{"id":7}}')))
    return documents.trace_points(i.plow.select(F.col("event_date").alias("label"), kind.alias("feature"))).groupBy(
        "event_date", "truck_id").agg(F.count("*").alias("n"), F.round(F.sum("latitude"), 4).alias("sum_lat"),
                                      F.round(F.sum("longitude"), 4).alias("sum_lng"))


@query
def service_routes(spark, sf):
    i = Inputs(spark, sf)
    text = F.concat(
        F.lit('{"attributes":{"ST_RT_NO":"'), F.col("route_no"), F.lit('","CUR_AADT":'), F.col("aadt").cast("string"),
        F.lit('},"geometry":{"paths":[[[0,0],['), F.col("mid_lng").cast("string"), F.lit(","),
        F.col("mid_lat").cast("string"), F.lit("]]]}}"))
    df = documents.state_routes(i.state_routes.select(text.alias("feature")))
    return df.groupBy("route_no").agg(F.count("*").alias("n"), F.sum("aadt").alias("aadt"),
                                      F.round(F.sum("mid_lat"), 3).alias("sum_lat"))


@query
def segment_records(spark, sf):
    """Raw road records with header variants, and midpoints by id."""
    i = Inputs(spark, sf)
    raw = i.segments.select(F.col("objectid").cast("string").alias("FID "), F.col("streetname").alias("ST_NAME"),
                            F.col("domi_class").alias("DOMI_CLASS"), F.col("roadwidth").alias("RoadWidth"))
    mids = i.lines.select("objectid", F.col("lat3").alias("mid_lat"), F.col("lng3").alias("mid_lng"))
    return documents.segment_records(raw, mids).select("objectid", "streetname", "domi_class", "roadwidth", "speedlimit",
                                                       "mid_lat", "mid_lng", "data_source")


@query
def traffic_events(spark, sf):
    """Traffic records of one county."""
    i = Inputs(spark, sf)
    record = F.to_json(F.struct(
        F.col("e.event_id").cast("string").alias("id"), F.concat(F.lit(" "), F.col("e.event_type")).alias("type"), "c.county",
        (F.col("e.value") > 5).alias("isFullClosure"), F.col("e.last_updated").cast("string").alias("lastUpdated")))
    rows = i.feed.alias("e").join(i.counties.alias("c"), F.col("e.event_id") == F.col("c.event_id")).select(record.alias("feature"))
    return cleaning.in_county(documents.traffic_events(rows), "Allegheny").select(
        "event_id", "event_type", "county", "description", "is_full_closure", "data_source")


@query
def alert_documents(spark, sf):
    """Alerts as features, scanned and typed."""
    i = Inputs(spark, sf)
    feature = F.to_json(F.struct("id", F.when(F.col("geometry").isNotNull(), F.struct(F.col("geometry").alias("type"))).alias(
        "geometry"), F.struct("event", "severity", "headline", "description").alias("properties")))
    return feeds.alert_events(documents.alert_rows(i.alerts.select(feature.alias("feature")))).select(
        "source_event_id", "event_type", "severity", "event", "description")


@query
def way_documents(spark, sf):
    """Roads whose node lists are the road graph's ends."""
    lines = Inputs(spark, sf).lines
    ends = lines.select((F.col("objectid") * 2).alias("id"), F.col("lat1").alias("lat"), F.col("lng1").alias("lon")).unionByName(
        lines.select((F.col("objectid") * 2 + 1).alias("id"), F.col("lat4").alias("lat"), F.col("lng4").alias("lon")))
    nodes = ends.select("id", F.lit("node").alias("type"), "lat", "lon", F.array().cast("array<bigint>").alias("nodes"),
                        F.create_map().cast("map<string,string>").alias("tags"))
    tags = F.create_map(F.lit("name"), F.col("streetname"), F.lit("highway"), F.when(
        F.col("domi_class") == "Alley", "construction").otherwise("residential"))
    ways = lines.select(
        F.col("objectid").alias("id"), F.lit("way").alias("type"), F.lit(None).cast("double").alias("lat"),
        F.lit(None).cast("double").alias("lon"),
        F.array(F.col("objectid") * 2, F.col("objectid") * 2 + 1, F.lit(-1).cast("bigint")).alias("nodes"), tags.alias("tags"))
    df = documents.way_roads(nodes.unionByName(ways))
    return df.select("osm_id", "name", "highway_type", "mid_lat", "mid_lng", F.col("node_count").cast("bigint").alias("node_count"))


@query
def daily_arrays(spark, sf):
    """Weather documents of one month each, unfolded to days."""
    i = Inputs(spark, sf)
    days = i.weather.groupBy(F.date_trunc("month", "date").alias("m")).agg(F.array_sort(F.collect_list(F.struct(
        F.col("date").cast("string").alias("time"), "snowfall_cm", "temp_max_c"))).alias("d"))
    # At most 31 days per document.
    doc = F.to_json(F.struct(F.struct(
        F.col("d.time").alias("time"), F.col("d.snowfall_cm").alias("snowfall_sum"),
        F.col("d.temp_max_c").alias("temperature_2m_max")).alias("daily")))
    return documents.daily_rows(days.select(doc.alias("document"))).select("date", "snowfall_cm", "temp_max_c")


@query
def prediction_features(spark, sf):
    """Predictions written as GeoJSON features and scanned back as day 0."""
    i = Inputs(spark, sf)
    attributes = i.lines.select("objectid", "streetname", "domi_class", F.col("lat1").alias("mid_lat"),
                                F.col("lng1").alias("mid_lng"), F.lit(True).alias("is_snow_emergency_route"))
    features = serve.point_features(i.scored_predictions.where("day_offset = 0"), attributes)
    path = new_path(spark, "features")
    scenario_row = i.scenarios.agg(F.max("snowfall_cm").alias("snowfall_cm"))
    files.write_features(features, serve.prediction_metadata(i.scored_predictions, scenario_row, "ranker"), path)
    return documents.stored_predictions(spark.read.text(f"{path}/features").withColumnRenamed("value", "feature"))


# Feeds

@query
def feed_snapshot_stream(spark, sf):
    """Every fetched event kept by a streaming job over the event files."""
    raw = spark.read.parquet(f"{sf}/events.parquet")
    stream = spark.readStream.schema(raw.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    rows = stream.select("event_id", "user_id", "event_type", F.col("ts").alias("last_updated"), "value")
    path, checkpoint = new_path(spark, "snapshots"), new_path(spark, "snapshots-checkpoint")
    feeds.snapshot_stream(rows, path, checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).select("event_id", "user_id", "event_type", "value")


@query
def feed_snapshot_compacted(spark, sf):
    """Snapshots of two event types a batch, compacted between the batches; a batch repeated afterwards changes nothing."""
    i, path = Inputs(spark, sf), new_path(spark, "snapshots-compacted")
    types = F.pmod(F.crc32(F.coalesce("event_type", F.lit("")).cast("binary")), F.lit(3))
    rows = i.feed.select("event_id", "event_type", "last_updated", "value")
    for number in (0, 1, 2, 1):
        feeds.append_snapshot_batch(rows.where(types == number), number, path)
        feeds.compact_snapshots(spark, path)
    return feeds.read_snapshots(spark, path).select("event_id", "event_type", "value")


@query
def feed_latest(spark, sf):
    i = Inputs(spark, sf)
    return feeds.latest_per_key(i.feed, "event_key", ["last_updated", "event_id"]).select(
        "event_key", "event_id", "event_type", "value")


@query
def feed_latest_stream(spark, sf):
    """The same table kept by a streaming job over the event files."""
    raw = spark.read.parquet(f"{sf}/events.parquet")
    stream = spark.readStream.schema(raw.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    rows = stream.select(F.col("user_id").alias("event_key"), "event_id", "event_type", F.col("ts").alias("last_updated"), "value")
    path, checkpoint = new_path(spark, "latest"), new_path(spark, "latest-checkpoint")
    job = feeds.upsert_stream(rows, path, checkpoint, "event_key", ["last_updated", "event_id"]).trigger(
        availableNow=True).start()
    job.awaitTermination()
    return feeds.read_upserted(spark, path).select("event_key", "event_id", "event_type", "value")


@query
def probability_updates(spark, sf):
    """Latest status per segment from a feed of closure probabilities."""
    i = Inputs(spark, sf)
    latest = feeds.latest_per_key(i.probabilities, "segment_id", ["updated_at", "seq"])
    return feeds.prediction_updates(latest).select("segment_id", "closure_probability", "label", F.round("score", 4).alias("score"))
