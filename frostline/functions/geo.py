"""Geometry as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Planar projection and sphere that distances are defined on.
METRES_PER_DEGREE = 111320.0
REFERENCE_LATITUDE = 40.44
METRES_PER_DEGREE_LNG = METRES_PER_DEGREE * math.cos(math.radians(REFERENCE_LATITUDE))
EARTH_RADIUS_M = 6371000.0
GRID_DEGREES = 0.002


def metres_north(lat: Column) -> Column:
    return lat * F.lit(METRES_PER_DEGREE)


def metres_east(lng: Column) -> Column:
    return lng * F.lit(METRES_PER_DEGREE_LNG)


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in metres."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lng = F.sin(F.radians(lng2 - lng1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lng * half_lng
    return F.lit(2 * EARTH_RADIUS_M) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def bearing_deg(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Initial bearing, 0 to 360."""
    d = F.radians(lng2 - lng1)
    p1, p2 = F.radians(lat1), F.radians(lat2)
    east = F.sin(d) * F.cos(p2)
    north = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(east, north)) + 360, F.lit(360.0))


def angle_between(a: Column, b: Column) -> Column:
    """Smaller angle between two bearings."""
    d = F.abs(b - a) % 360
    return F.when(d > 180, 360 - d).otherwise(d)


def turn_phrase(previous: Column, current: Column) -> Column:
    """Wording of the turn from one bearing to the next; straight on and U-turns both continue."""
    d = F.pmod(current - previous + 360, F.lit(360.0))
    return (
        F.when((d >= 30) & (d < 150), "Turn right onto")
        .when((d >= 210) & (d < 330), "Turn left onto")
        .otherwise("Continue on")
    )


def grid_cell(degrees: Column, size: float = GRID_DEGREES) -> Column:
    return F.floor(degrees / F.lit(size))


def node_key(lng: Column, lat: Column) -> Column:
    """Graph node of a coordinate: five decimals, about one metre."""
    return F.format_string("%.5f,%.5f", lng, lat)


def middle_vertex(coords: Column) -> Column:
    """Vertex at index floor(n/2) of an array of points."""
    return F.try_element_at(coords, F.floor(F.size(coords) / 2).cast("int") + 1)


def mean_coordinate(coords: Column, field: str) -> Column:
    """Mean of one field over an array of points; null when there is none."""
    total = F.aggregate(coords, F.lit(0.0), lambda acc, p: acc + p[field])
    return F.when(F.size(coords) > 0, total / F.size(coords))


def line_length_m(coords: Column) -> Column:
    """Sum of great-circle legs of a polyline."""
    legs = F.zip_with(
        F.slice(coords, 1, F.greatest(F.size(coords) - 1, F.lit(0))),
        F.slice(coords, 2, F.greatest(F.size(coords) - 1, F.lit(0))),
        lambda p, q: haversine_m(p["lat"], p["lng"], q["lat"], q["lng"]),
    )
    return F.aggregate(legs, F.lit(0.0), lambda acc, d: acc + d)


def line_bounds(coords: Column) -> list[Column]:
    """min_lng, min_lat, max_lng, max_lat of a polyline."""
    lngs = F.transform(coords, lambda p: p["lng"])
    lats = F.transform(coords, lambda p: p["lat"])
    return [
        F.array_min(lngs).alias("min_lng"),
        F.array_min(lats).alias("min_lat"),
        F.array_max(lngs).alias("max_lng"),
        F.array_max(lats).alias("max_lat"),
    ]


def thin_line(coords: Column, interval_m: float) -> Column:
    """Keep a vertex each time ``interval_m`` has accumulated since the last kept one, plus both ends.

    The accumulator restarts at each kept vertex, so it is folded over the vertices of one line.
    """
    last = F.size(coords)
    start = F.struct(F.lit(0.0).alias("since"), F.array(F.lit(1)).alias("kept"))

    def step(acc: Column, i: Column) -> Column:
        p, q = F.element_at(coords, i - 1), F.element_at(coords, i)
        since = acc["since"] + haversine_m(p["lat"], p["lng"], q["lat"], q["lng"])
        reached = since >= interval_m
        return F.struct(
            F.when(reached, F.lit(0.0)).otherwise(since).alias("since"),
            F.when(reached, F.array_append(acc["kept"], i)).otherwise(acc["kept"]).alias("kept"),
        )

    kept = F.aggregate(F.sequence(F.lit(2), last), start, step)["kept"]
    whole = F.when(F.element_at(kept, -1) == last, kept).otherwise(F.array_append(kept, last))
    return F.when(last <= 2, coords).otherwise(F.transform(whole, lambda i: F.element_at(coords, i)))
