"""Closures from release texts, and points from location texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.functions.encode import day_of_millis

# Sentence patterns of closures, with the field each group holds, in the order they are tried.
STATUS = r"(Closed|Restricted|Reduced)"
PATTERNS = [
    (r"(?i)Route\s+(\d+)\s*\(([^)]+)\)\s+between\s+(.+?)\s+and\s+(.+?)\s+in\s+(.+?)\s*[–—\-]+\s*" + STATUS,
     ["route_number", "road_name", "from_location", "to_location", "municipality", "status"]),
    (r"(?i)Route\s+(\d+)\s+between\s+(.+?)\s+and\s+(.+?)\s+in\s+(.+?)\s*[–—\-]+\s*" + STATUS,
     ["route_number", "from_location", "to_location", "municipality", "status"]),
    (r"(?i)SR\s+(\d+)\s*\(([^)]+)\).*?" + STATUS, ["route_number", "road_name", "status"]),
    (r"(?i)Route\s+(\d+)\s*\(([^)]+)\).*?" + STATUS, ["route_number", "road_name", "status"]),
]
FIELDS = ["route_number", "road_name", "municipality", "status", "from_location", "to_location"]
LAT_RANGE = (39.0, 42.0)
LNG_RANGE = (-81.0, -79.0)


def plain_text(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", " "), r"\s+", " ")


def _sentences(number: int, pattern: str, groups: list[str]) -> Column:
    """Matches of one pattern as an array of structs with all closure fields; fields it lacks are blank."""
    parts = F.arrays_zip(*[
        F.regexp_extract_all("_t", F.lit(pattern), i + 1).alias(name) for i, name in enumerate(groups)])
    return F.transform(parts, lambda m: F.struct(F.lit(number).alias("pattern"), *[
        (F.trim(m[f]) if f in groups else F.lit("")).alias(f) for f in FIELDS]))


def closures_in_text(releases: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """One row per closure sentence; a sentence that fits several patterns gives a row for each."""
    df = releases.select(*keep, plain_text(F.col(text)).alias("_t"))
    found = [_sentences(number, pattern, groups) for number, (pattern, groups) in enumerate(PATTERNS)]
    rows = df.select(*keep, F.explode(F.concat(*found)).alias("_c"))
    return rows.select(*keep, *[
        (F.initcap(F.col(f"_c.{f}")) if f == "status" else F.col(f"_c.{f}")).alias(f) for f in FIELDS],
        F.lit("penndot_press").alias("data_source"))


def press_closures(releases: DataFrame) -> DataFrame:
    """Closures of press releases (title, excerpt, uri, millis)."""
    df = releases.select(
        "title", F.col("uri").alias("url"), day_of_millis(F.col("millis")).alias("date"),
        F.concat_ws(" ", "title", "excerpt").alias("_text"))
    return closures_in_text(df, "_text", ["date", "title", "url"])


def _in_ranges(lat: Column, lng: Column) -> Column:
    return (lat > LAT_RANGE[0]) & (lat < LAT_RANGE[1]) & (lng > LNG_RANGE[0]) & (lng < LNG_RANGE[1])


def _oriented(a: Column, b: Column) -> Column:
    """(lat, lng) from two numbers in either order, by the region they fall in."""
    return F.when(_in_ranges(a, b), F.struct(a.alias("lat"), b.alias("lng"))).when(
        _in_ranges(b, a), F.struct(b.alias("lat"), a.alias("lng")))


def location_point(text: Column) -> Column:
    """Representative point of a location text as struct(lat, lng), null when there is none.

    Known forms: JSON list of pairs (middle pair), one JSON pair, WKT line of either axis order (middle pair),
    "a, b" of either order, WKT point.
    """
    s = F.trim(text)
    listed = F.when(s.startswith("["), F.from_json(s, "array<array<double>>"))
    single = F.when(s.startswith("["), F.from_json(s, "array<double>"))
    mid = F.try_element_at(listed, F.floor(F.size(listed) / 2).cast("int") + 1)

    def as_is(a, b):
        return F.when(_in_ranges(a, b), F.struct(a.alias("lat"), b.alias("lng")))

    line = F.split(F.nullif(F.regexp_extract(s, r"(?i)^LINESTRING\s*\((.+)\)", 1), F.lit("")), ",")
    words = F.split(F.trim(F.try_element_at(line, F.floor(F.size(line) / 2).cast("int") + 1)), r"\s+")
    pair = r"^(-?\d+\.?\d*)\s*,\s*(-?\d+\.?\d*)$"
    point = r"(?i)^POINT\s*\(\s*(-?\d+\.?\d*)\s+(-?\d+\.?\d*)\s*\)"

    def num(pattern, group):
        return F.regexp_extract(s, pattern, group).try_cast("double")

    found = F.coalesce(
        as_is(F.get(mid, 0), F.get(mid, 1)),
        F.when(F.size(single) == 2, as_is(F.get(single, 0), F.get(single, 1))),
        F.when(F.size(words) == 2, _oriented(F.get(words, 0).try_cast("double"), F.get(words, 1).try_cast("double"))),
        _oriented(num(pair, 1), num(pair, 2)),
        as_is(num(point, 2), num(point, 1)))
    return F.when(found.isNotNull(), F.struct(F.round(found["lat"], 6).alias("lat"), F.round(found["lng"], 6).alias("lng")))


def wkt_point(text: Column) -> Column:
    """First two numbers of a text that names a point, as struct(lat, lng); longitude comes first."""
    pair = r"([-+]?\d+\.?\d*)\s+([-+]?\d+\.?\d*)"
    lng, lat = F.regexp_extract(text, pair, 1).try_cast("double"), F.regexp_extract(text, pair, 2).try_cast("double")
    return F.when(F.upper(text).contains("POINT") & lat.isNotNull() & lng.isNotNull(),
                  F.struct(lat.alias("lat"), lng.alias("lng")))


def with_location(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Latitude and longitude, from the location text where they are missing."""
    point = location_point(F.col(geometry))
    have = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    return df.withColumn("_at", point).withColumns({
        "latitude": F.when(have, F.col("latitude")).otherwise(F.coalesce(F.col("_at.lat"), F.col("latitude"))),
        "longitude": F.when(have, F.col("longitude")).otherwise(F.coalesce(F.col("_at.lng"), F.col("longitude")))}).drop("_at")
