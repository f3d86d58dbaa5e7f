"""Row filters, de-duplication, coercion and fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.functions.encode import first_filled, number, text_or_null
from frostline.operators.ordered import bounded_percentiles, exact_percentiles
from frostline.session import cut_lineage

# Predicates of the source feeds.
COMPLAINT_PATTERNS = ["%Snow%", "%Ice%", "%Icy%"]
PRIORITY_CLASSES = ["Principal Arterial", "Minor Arterial", "Collector"]
REGION_BOX = {"lat": (40.30, 40.55), "lng": (-80.15, -79.80)}
REGION_NAMES = ["Pennsylvania", "PA"]
MAJOR_TIERS = ["motorway", "trunk", "primary", "secondary", "tertiary"]
MINOR_MIN_LENGTH_M = 80
WINTER_MONTHS = [11, 12, 1, 2, 3]
SCENARIO_BOUNDS = {"snowfall_cm": (0, 200), "min_temp_c": (-50, 30), "max_wind_kmh": (0, 200),
                   "duration_days": (1, 7)}


def normalise_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower() for c in df.columns])


def canonical(df: DataFrame, aliases: dict[str, list[str]], source: str) -> DataFrame:
    """Canonical columns from header variants: the first present and filled one, else the empty text."""
    df = normalise_headers(df)
    present = set(df.columns)

    def pick(names: list[str]) -> Column:
        return first_filled(*[F.col(f"`{n}`") for n in names if n in present])

    return df.select(*[pick(names).alias(out) for out, names in aliases.items()], F.lit(source).alias("data_source"))


def winter_crashes(df: DataFrame) -> DataFrame:
    return df.where((F.col("snow_slush_road").cast("string") == "1") | (F.col("icy_road").cast("string") == "1"))


def snow_complaints(df: DataFrame, column: str = "request_type") -> DataFrame:
    hit = F.lit(False)
    for pattern in COMPLAINT_PATTERNS:
        hit = hit | F.col(column).like(pattern)
    return df.where(hit)


def in_region(df: DataFrame, lat: str, lng: str, region: str, box: dict = REGION_BOX) -> DataFrame:
    """Rows inside the box; rows without a position stay when their region is named."""
    inside = F.col(lat).between(*box["lat"]) & F.col(lng).between(*box["lng"])
    named = F.lit(False)
    for name in REGION_NAMES:
        named = named | F.coalesce(F.col(region).contains(name), F.lit(False))
    return df.where(F.when(F.col(lat).isNull() | F.col(lng).isNull(), named).otherwise(inside))


def priority_routes(df: DataFrame) -> DataFrame:
    return df.where(F.trim("domi_class").isin(PRIORITY_CLASSES))


def in_county(df: DataFrame, county: str, column: str = "county") -> DataFrame:
    return df.where(F.lower(F.coalesce(F.col(column), F.lit(""))) == county.lower())


def winter_days(df: DataFrame, column: str = "date") -> DataFrame:
    return df.where(F.month(column).isin(WINTER_MONTHS))


def road_layer(df: DataFrame, tiers: list[str] = MAJOR_TIERS, tier: str = "highway", length: str = "length_m") -> DataFrame:
    """Major roads, and minor ones that are long enough."""
    return df.where(F.col(tier).isin(tiers) | (F.col(length) >= MINOR_MIN_LENGTH_M))


def check_scenarios(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scenarios within bounds, and the rejected rest."""
    good = F.lit(True)
    for name, (low, high) in SCENARIO_BOUNDS.items():
        good = good & F.coalesce(F.col(name).between(low, high), F.lit(False))
    return df.where(good), df.where(~good)


def located(df: DataFrame, lat: str = "latitude", lng: str = "longitude") -> DataFrame:
    """Coordinates read as numbers; rows without both are dropped."""
    return df.withColumn(lat, number(F.col(lat))).withColumn(lng, number(F.col(lng))).dropna(subset=[lat, lng])


def timed(df: DataFrame, start: str, end: str | None = None) -> DataFrame:
    """Times read from text; rows without a start are dropped, a missing end is the start."""
    df = df.withColumn(start, F.col(start).try_cast("timestamp")).dropna(subset=[start])
    if end:
        df = df.withColumn(end, F.coalesce(F.col(end).try_cast("timestamp"), F.col(start)))
    return df


def keep_first(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """First row per key by ``ordinal``.

    An aggregate, not a window: copies of a key are reduced before the shuffle, however many there are.
    """
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.col(ordinal)).alias("_row")
    return df.groupBy(*keys).agg(first).select(*[
        F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns])


def merge_passes(first: DataFrame, second: DataFrame, keys: list[str], ordinal: list[str] | None = None) -> DataFrame:
    """Rows of two extraction passes: all of the first, and the first row per key of the second that is new.

    Rows are in the order of the ``ordinal`` columns, else of all their columns. Blank and null key parts compare equal.
    """
    alike = [F.trim(F.coalesce(F.col(k).cast("string"), F.lit(""))).alias(f"_k{i}") for i, k in enumerate(keys)]
    names = [f"_k{i}" for i in range(len(keys))]
    whole = F.struct(*second.columns)
    place = F.struct(*(ordinal or []), whole)
    fresh = second.groupBy(*alike).agg(F.min_by(whole, place).alias("_row")).join(
        first.select(*alike).distinct(), names, "left_anti")
    return first.unionByName(fresh.select("_row.*"))


def column_medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exact median of each column, one row per column name; nulls do not count."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])).alias("_c"))
    return exact_percentiles(long.select("_c.*"), ["column"], "value", {"median": 0.5})


def align(df: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns in order; missing ones are 0."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(0).cast("float").alias(c) for c in columns])


def present_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[c for c in columns if c in df.columns])


def to_float(df: DataFrame) -> DataFrame:
    """Doubles become floats."""
    return df.select(*[
        F.col(f.name).cast("float").alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name)
        for f in df.schema.fields])


def blank_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[
        text_or_null(F.col(f.name)).alias(f.name) if f.dataType.typeName() == "string" else F.col(f.name)
        for f in df.schema.fields])


def union_feeds(*feeds: DataFrame) -> DataFrame:
    out = feeds[0]
    for feed in feeds[1:]:
        out = out.unionByName(feed, allowMissingColumns=True)
    return out


def frequency(df: DataFrame, column: str, unknown: str = "(unknown)") -> DataFrame:
    """Count per value, most frequent first."""
    return df.groupBy(F.coalesce(text_or_null(F.col(column)), F.lit(unknown)).alias("value")).agg(
        F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Filled count, minimum, maximum and mean of each numeric column, one row per column, in one pass."""
    aggregates = []
    for c in columns:
        v = F.col(c).cast("double")
        aggregates.append(F.struct(
            F.lit(c).alias("column"), F.count(v).alias("filled"), F.min(v).alias("min"), F.max(v).alias("max"),
            F.avg(v).alias("mean")))
    return df.agg(F.array(*aggregates).alias("_c")).select(F.explode("_c").alias("_c")).select("_c.*")


def season_statistics(df: DataFrame, value: str = "risk_score") -> DataFrame:
    """Mean, sample deviation, rows and storms per season."""
    return df.groupBy("season").agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count("*").alias("n"),
        F.count_distinct("storm_id").alias("storms"))


def label_summary(labels: DataFrame) -> DataFrame:
    """One row on a label table: rows, segments, storms, and range, mean and median of the score.

    Scores have six decimals, so their histogram by storm is bounded and the median is exact. The table is read twice, for the
    histogram and for its segments, and need not be stored.
    """
    by_storm = cut_lineage(labels.groupBy("storm_id", "risk_score").agg(F.count("*").alias("n")), "histogram")
    hist = by_storm.groupBy("risk_score").agg(F.sum("n").alias("n"))
    median = bounded_percentiles(hist, [], "risk_score", "n", {"median": 0.5}).scalar()
    segments = labels.select("objectid").distinct().agg(F.count("*")).scalar()
    storms = by_storm.select("storm_id").distinct().agg(F.count("*")).scalar()
    agg = hist.agg(F.sum("n").alias("rows"), F.min("risk_score").alias("min_score"), F.max("risk_score").alias("max_score"),
                   (F.sum(F.col("risk_score") * F.col("n")) / F.sum("n")).alias("mean_score"))
    return agg.select("rows", segments.alias("segments"), storms.alias("storms"), "min_score", "max_score", "mean_score",
                      median.alias("median_score"))
