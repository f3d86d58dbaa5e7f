"""Feature encodings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordinal codes of road attributes and texts read as true.
ROAD_CLASS = {"": 0, "Alley": 0, "Local": 1, "Collector": 2, "Minor Arterial": 3, "Major Arterial": 4,
              "Principal Arterial": 5}
PAVEMENT = {"": 0, "UNPAVED": 0, "GRAVEL": 1, "BRICK": 2, "ASPHALT": 3, "CONCRETE": 4}
HIGHWAY = {"": 0, "service": 1, "residential": 2, "unclassified": 3, "tertiary": 4, "tertiary_link": 4,
           "secondary": 5, "secondary_link": 5, "primary": 6, "primary_link": 6, "trunk": 7, "trunk_link": 7,
           "motorway": 8, "motorway_link": 8}
SURFACE = {"": 0, "asphalt": 1, "concrete": 2, "paved": 3, "cobblestone": 4, "gravel": 5}
ONEWAY = {"": 0, "N": 0, "FT": 1, "TF": 2, "B": 0}
TRUE_TEXTS = ["true", "1", "yes"]


def text_or_null(c: Column) -> Column:
    """Trimmed text; blanks become null."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def first_filled(*cols: Column) -> Column:
    """First column that is neither null nor blank, else the empty text."""
    return F.coalesce(*[text_or_null(c) for c in cols], F.lit(""))


def number(c: Column) -> Column:
    """Number read from text; what is not written as one is null, infinity and letters behind a number included."""
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))


def is_true(c: Column) -> Column:
    return F.coalesce(F.lower(c.cast("string")).isin(TRUE_TEXTS), F.lit(False))


def code(c: Column, codes: dict[str, int], unknown: int = 0) -> Column:
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.trim(F.coalesce(c, F.lit("")))), F.lit(unknown))


def incline_percent(c: Column) -> Column:
    """Slope from an incline tag: words have fixed values, otherwise the leading number."""
    s = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    leading = F.regexp_extract(s, r"^(-?\d+(?:\.\d+)?)", 1)
    return (
        F.when(s == "up", 5.0).when(s == "down", -5.0).when(s == "steep", 15.0)
        .otherwise(F.coalesce(F.nullif(leading, F.lit("")).try_cast("double"), F.lit(0.0)))
    )


def winter_season(day: Column) -> Column:
    """Season running October to September, such as 2024-25."""
    first = F.year(day) - F.when(F.month(day) >= 10, 0).otherwise(1)
    return F.concat(first.cast("string"), F.lit("-"), F.lpad(((first + 1) % 100).cast("string"), 2, "0"))


def name_key(c: Column) -> Column:
    """Street name as a join key; blank names have none."""
    return F.lower(text_or_null(c))


def day_of_millis(c: Column) -> Column:
    """Date text of epoch milliseconds; blank when there are none."""
    millis = c.try_cast("bigint")
    return F.coalesce(F.date_format(F.timestamp_millis(F.nullif(millis, F.lit(0))), "yyyy-MM-dd"), F.lit(""))
