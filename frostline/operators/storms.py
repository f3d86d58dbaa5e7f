"""Storms from a daily weather series.

Rows are collapsed to one per calendar day before anything is ordered, so the ordered steps work on at most as
many rows as the calendar has days, however many stations or copies the input holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frostline.functions.encode import winter_season

# What counts as a snow day, and how long after the last one a storm is watched.
SNOW_DAY_CM = 1.0
EXTRA_DAYS = 2
THAW_HOURS = 12.0


def by_day(weather: DataFrame, ordinal: str | None = None) -> DataFrame:
    """One row per date. The day's own snow and warmth come from its first row, totals from all of them."""
    snow = F.col("snowfall_cm")
    on_snow_day = F.when(snow >= SNOW_DAY_CM, snow)
    first = F.struct("snowfall_cm", "temp_max_c")
    own = F.min_by(first, F.col(ordinal)) if ordinal else F.min(first)
    return weather.where(F.col("date").isNotNull()).groupBy("date").agg(
        F.sum(on_snow_day).alias("snow_sum"), F.max(on_snow_day).alias("snow_max"),
        F.min("temp_min_c").alias("temp_min_c"), F.max("wind_max_kmh").alias("wind_max_kmh"),
        F.sum("precip_mm").alias("precip_mm"), own.alias("own"),
    ).select("*", F.coalesce("own.snowfall_cm", F.lit(0.0)).alias("day_snow"),
             F.coalesce("own.temp_max_c", F.lit(0.0)).alias("day_warmth")).drop("own")


def storm_events(days: DataFrame) -> DataFrame:
    """One row per run of consecutive snow days, numbered from 0, watched for two more days."""
    in_order = Window.orderBy("date")
    snowy = days.where(F.col("snow_sum").isNotNull())
    gap = F.when(F.datediff("date", F.lag("date").over(in_order)) > 1, 1).otherwise(0)
    runs = snowy.withColumn("_gap", gap).withColumn("storm_id", F.sum("_gap").over(in_order))
    storms = runs.groupBy("storm_id").agg(
        F.min("date").alias("start_date"), F.max("date").alias("end_date"),
        F.round(F.sum("snow_sum"), 2).alias("total_snowfall_cm"),
        F.round(F.max("snow_max"), 2).alias("max_daily_snowfall_cm"),
    ).withColumn("window_end", F.date_add("end_date", EXTRA_DAYS))
    watched = storms.select("storm_id", F.explode(F.sequence("start_date", "window_end")).alias("date"))
    over_window = watched.join(days, "date").groupBy("storm_id").agg(
        F.round(F.min("temp_min_c"), 1).alias("min_temp_c"),
        F.round(F.max("wind_max_kmh"), 1).alias("max_wind_kmh"),
        F.round(F.coalesce(F.sum("precip_mm"), F.lit(0.0)), 1).alias("precip_total_mm"))
    return storms.join(over_window, "storm_id").select(
        F.col("storm_id").cast("bigint"), "start_date", "end_date", "window_end", "total_snowfall_cm",
        "max_daily_snowfall_cm", "min_temp_c", "max_wind_kmh", "precip_total_mm",
        (F.datediff("end_date", "start_date") + 1).cast("bigint").alias("duration_days"),
        winter_season(F.col("start_date")).alias("season"))


def storm_calendar(storms: DataFrame) -> DataFrame:
    """One row per storm and watched day; windows of different storms may share days."""
    return storms.select(
        "storm_id", "start_date", "window_end",
        (F.datediff("window_end", "start_date") + 1).cast("bigint").alias("n_days"),
        F.posexplode(F.sequence("start_date", "window_end")).alias("day_offset", "date"),
    ).withColumn("day_offset", F.col("day_offset").cast("bigint"))


def storm_days(storms: DataFrame, days: DataFrame) -> DataFrame:
    """Storm days with running snow, time since the peak, and thaw since the last snow day."""
    rows = storm_calendar(storms).join(days.select("date", "day_snow", "day_warmth"), "date", "left")
    rows = rows.fillna(0.0, ["day_snow", "day_warmth"])
    so_far = Window.partitionBy("storm_id").orderBy("day_offset").rowsBetween(Window.unboundedPreceding, 0)
    snow_day = F.col("day_snow") >= SNOW_DAY_CM
    peak = F.max(F.when(F.col("day_snow") > 0, F.struct("day_snow", (-F.col("day_offset")).alias("back")))).over(so_far)
    rows = rows.select(
        "*", F.sum("day_snow").over(so_far).alias("_snow"),
        F.coalesce(-peak["back"], F.lit(0)).alias("_peak"),
        F.coalesce(F.max(F.when(snow_day, F.col("day_offset"))).over(so_far), F.lit(0)).alias("_last"),
        F.sum(F.when(snow_day, 1).otherwise(0)).over(so_far).alias("_island"))
    thawing = F.when(~snow_day & (F.col("day_warmth") > 0), F.col("day_warmth") * THAW_HOURS).otherwise(0.0)
    since_snow = Window.partitionBy("storm_id", "_island").orderBy("day_offset").rowsBetween(
        Window.unboundedPreceding, 0)
    return rows.withColumn("_thaw", F.sum(thawing).over(since_snow)).select(
        "storm_id", "day_offset", "date",
        F.round("day_snow", 2).alias("daily_snowfall_cm"),
        F.round("_snow", 2).alias("cumulative_snowfall_cm"),
        (F.col("day_offset") - F.col("_peak")).alias("days_since_peak_snowfall"),
        F.when(~snow_day & (F.col("day_offset") > F.col("_last")), 1).otherwise(0).cast("bigint").alias("is_post_storm"),
        F.round("_thaw", 1).alias("cumulative_thaw_degree_hours"))
