"""Incident measures per segment, storm and day, and the composite risk label.

Incidents are first collapsed to counts per position and time, so that copies and crowded addresses never travel
as single rows. Segments are a table (objectid, mid_lat, mid_lng, ...), storms and days come from ``storms``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from frostline.functions.encode import is_true
from frostline.functions.risk import WEIGHT_PLOW, composite_risk
from frostline.operators.ordered import bounded_percentiles
from frostline.operators.spatial import nearest_rows, totals_within, unpacked, unpacked_totals
from frostline.operators.storms import storm_calendar
from frostline.session import cut_lineage, tasks_for

# Reach of each source in metres, and the points a storm needs before its plow data counts.
COMPLAINT_RADIUS_M = 200.0
CRASH_RADIUS_M = 200.0
PLOW_RADIUS_M = 100.0
CLOSURE_RADIUS_M = 200.0
MIN_PLOW_POINTS = 10
# Kinds of measures, segments whose days are unfolded at once, days of a stored list, and rows of the grid of a task that unfolds them.
COMPLAINTS, CRASHES, PLOWED, CLOSED = range(4)
SEGMENTS_AT_ONCE, DAYS_A_ROW, GRID_ROWS_A_TASK = 256, 64, 5_000_000
DAYS = "array<struct<day_no:int,complaints:bigint,crash_score:double,plowed:bigint,closure:bigint>>"


def _segment_places(segments: DataFrame) -> DataFrame:
    return segments.select("objectid", "mid_lat", "mid_lng")


def _nearest_segment(located: DataFrame, segments: DataFrame, radius_m: float) -> DataFrame:
    """(latitude, longitude, objectid) of each distinct position with a segment in reach."""
    return _nearest(located.select("latitude", "longitude").distinct(), segments, radius_m).drop("distance_m")


def _nearest(points: DataFrame, segments: DataFrame, radius_m: float) -> DataFrame:
    """Distinct points that have a segment in reach, with the id of the nearest."""
    return nearest_rows(points, _segment_places(segments), radius_m, "objectid", ["objectid"],
                        base_at=("latitude", "longitude"), target_at=("mid_lat", "mid_lng")).where(F.col("objectid").isNotNull())


def numbered_calendar(storms: DataFrame) -> DataFrame:
    """The storm calendar, its days numbered from 0 by storm and day."""
    # At most one row per storm and calendar day.
    return storm_calendar(storms).withColumn("day_no", F.row_number().over(Window.orderBy("storm_id", "day_offset")) - 1)


def _rows_of_days(totals: DataFrame, calendar: DataFrame, segments: DataFrame, value: str) -> DataFrame:
    """(objectid, storm_id, day_offset, value) of packed totals; ids that stand at several places are added up once more."""
    rows = unpacked(totals, "objectid", "day_no", value)
    if not _segment_places(segments).dropna(subset=["mid_lat", "mid_lng"]).groupBy("objectid").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        rows = rows.groupBy("objectid", "day_no").agg(F.sum(value).alias(value))
    return rows.join(calendar.select("storm_id", "day_offset", "day_no"), "day_no").select("objectid", "storm_id", "day_offset", value)


def complaint_counts(complaints: DataFrame, storms: DataFrame, segments: DataFrame,
                     inclusive_last_day: bool = False, packed: bool = False) -> DataFrame:
    """Complaints near a segment per storm day; with ``packed`` in the form in which ``storm_measures`` takes most.

    A window ends at midnight starting its last day, so timed complaints of that day do not count unless
    ``inclusive_last_day`` is set.
    """
    calendar = cut_lineage(numbered_calendar(storms), "calendar")
    at = F.to_date("created_date")
    # Days without a storm are left out before anything is shuffled.
    in_storm = complaints.dropna(subset=["latitude", "longitude", "created_date"]).select(
        "latitude", "longitude", at.alias("date"),
        (F.col("created_date") == at.cast(complaints.schema["created_date"].dataType)).alias("at_midnight")).join(calendar, "date")
    if not inclusive_last_day:
        in_storm = in_storm.where((F.col("date") < F.col("window_end")) | F.col("at_midnight"))
    counted = in_storm.groupBy("latitude", "longitude", "day_no").agg(F.count("*").alias("n"))
    totals = totals_within(counted, _segment_places(segments), COMPLAINT_RADIUS_M, "objectid", "day_no", "n", point_at=("latitude", "longitude"))
    return totals if packed else _rows_of_days(totals, calendar, segments, "complaints")


def storm_months(storms: DataFrame) -> DataFrame:
    """Months touched by each storm, with the storm's share of the snow of all storms touching the month."""
    months = storms.withColumn("month_start", F.explode(F.sequence(
        F.trunc("start_date", "month"), F.trunc("window_end", "month"), F.expr("interval 1 month"))))
    snow = F.sum("total_snowfall_cm").over(Window.partitionBy("month_start"))
    days = F.datediff("window_end", "start_date") + 1
    return months.select(
        "storm_id", F.year("month_start").cast("bigint").alias("crash_year"),
        F.month("month_start").cast("bigint").alias("crash_month"), days.cast("bigint").alias("n_days"),
        (F.col("total_snowfall_cm") / F.when(snow > 0, snow).otherwise(1.0) / days).alias("day_weight"))


def crash_counts(crashes: DataFrame, segments: DataFrame) -> DataFrame:
    """Crashes per year, month and nearest segment."""
    grouped = crashes.dropna(subset=["latitude", "longitude", "crash_year", "crash_month"]).groupBy(
        "latitude", "longitude", F.col("crash_year").cast("bigint").alias("crash_year"),
        F.col("crash_month").cast("bigint").alias("crash_month")).agg(F.count("*").alias("n"))
    near = _nearest_segment(grouped, segments, CRASH_RADIUS_M)
    return grouped.join(near, ["latitude", "longitude"]).groupBy("crash_year", "crash_month", "objectid").agg(
        F.sum("n").alias("crashes"))


def crash_scores(crashes: DataFrame, storms: DataFrame, segments: DataFrame) -> DataFrame:
    """Monthly crashes shared out over the storms of the month by snowfall, the same on each watched day."""
    shares = crash_counts(crashes, segments).join(storm_months(storms), ["crash_year", "crash_month"])
    return shares.groupBy("objectid", "storm_id", "n_days").agg(
        F.sum(F.col("crashes") * F.col("day_weight")).alias("crash_score"))


def plow_passes(plow: DataFrame, storms: DataFrame, segments: DataFrame) -> DataFrame:
    """Plow points per storm and nearest segment, for storms with enough of them: (storm_id, objectid).

    An event label may name several dates; a point counts once per storm it falls in.
    """
    plow = plow.dropna(subset=["latitude", "longitude"])
    dates = F.array_distinct(F.regexp_extract_all("event_date", F.lit(r"(\d{4}-\d{2}-\d{2})"), 1))
    dated = plow.select("event_date").distinct().withColumn("date", F.explode(dates)).withColumn("date", F.col("date").try_cast("date"))
    # Labels of storm days, so that points of other days are left out first and the storms are joined to few rows.
    in_storm = cut_lineage(dated.join(storm_calendar(storms).select("storm_id", "date"), "date").select(
        "storm_id", "event_date").distinct(), "plow-labels")
    grouped = plow.join(in_storm.select("event_date").distinct(), "event_date", "left_semi").groupBy(
        "latitude", "longitude", "event_date").agg(F.count("*").alias("n"))
    near = cut_lineage(_nearest(grouped, segments, PLOW_RADIUS_M).select("event_date", "objectid", "n"), "plow-points")
    points = near.groupBy("event_date").agg(F.sum("n").alias("n")).join(in_storm, "event_date")
    enough = cut_lineage(points.groupBy("storm_id").agg(F.sum("n").alias("storm_points")).where(
        F.col("storm_points") >= MIN_PLOW_POINTS), "plow-storms")
    counted = in_storm.join(enough.select("storm_id"), "storm_id")
    return near.select("event_date", "objectid").join(counted, "event_date").select("storm_id", "objectid").distinct()


def plow_gaps(plowed: DataFrame, segments: DataFrame) -> DataFrame:
    """Segments without a plow point in each storm that has plow data: (storm_id, objectid).

    Each segment lists the storms with plow data and drops those it was ploughed in, so only the ploughed pairs
    are shuffled.
    """
    storms = plowed.agg(F.collect_set("storm_id").alias("ids"))
    done = plowed.groupBy("objectid").agg(F.collect_set("storm_id").alias("_done"))
    missed = F.array_except(storms.scalar(), F.coalesce("_done", F.array().cast("array<bigint>")))
    # Dealt out first: a small file of segments unfolds to many rows.
    return segments.select("objectid").repartition("objectid").join(done, "objectid", "left").select(
        F.explode(missed).alias("storm_id"), "objectid")


def closure_days(closures: DataFrame, storms: DataFrame, segments: DataFrame, packed: bool = False) -> DataFrame:
    """Storm days on which a full closure lies near a segment: distinct (objectid, storm_id, day_offset).

    With ``packed`` they come in the form in which ``storm_measures`` takes most.
    Closures and storms meet on the months both touch; a pair that shares several months is kept in the first.
    Days step from the later of the two starts, at its time of day.
    """
    full = closures.where(is_true(F.col("full_closure"))).select(
        "latitude", "longitude", F.col("from_date").cast("timestamp").alias("from_ts"),
        F.coalesce("to_date", "from_date").cast("timestamp").alias("to_ts"),
    ).dropna().distinct()
    month = F.expr("interval 1 month")
    laid = full.where(F.col("to_ts") >= F.col("from_ts")).withColumn("month", F.explode(F.sequence(
        F.trunc("from_ts", "month"), F.trunc("to_ts", "month"), month)))
    windows = storms.select(
        "storm_id", F.col("start_date").cast("timestamp").alias("start_ts"),
        F.col("window_end").cast("timestamp").alias("end_ts"),
        F.explode(F.sequence(F.trunc("start_date", "month"), F.trunc("window_end", "month"), month)).alias("month"))
    low, high = F.greatest("start_ts", "from_ts"), F.least("end_ts", "to_ts")
    met = laid.join(windows, "month").where(
        (F.col("from_ts") <= F.col("end_ts")) & (F.col("to_ts") >= F.col("start_ts"))
        & (F.col("month") == F.trunc(low, "month")))

    def seconds(c):
        return F.unix_timestamp(c)

    first = F.floor((seconds(low) - seconds(F.col("start_ts"))) / 86400)
    count = F.floor((seconds(high) - seconds(low)) / 86400)
    days = met.select("latitude", "longitude", "storm_id", F.explode(F.sequence(first, first + count)).alias("day_offset"))
    calendar = cut_lineage(numbered_calendar(storms), "calendar")
    days = days.distinct().join(calendar.select("storm_id", "day_offset", "day_no"), ["storm_id", "day_offset"]).withColumn("n", F.lit(1))
    totals = totals_within(days, _segment_places(segments), CLOSURE_RADIUS_M, "objectid", "day_no", "n", point_at=("latitude", "longitude"),
                           flags=True)
    return totals if packed else _rows_of_days(totals, calendar, segments, "closure").drop("closure")


def storm_measures(storms: DataFrame, complaints: DataFrame, crash: DataFrame, plowed: DataFrame,
                   closures: DataFrame) -> DataFrame:
    """The four sources by segment: (objectid, kind, first, last, value, packed), spans of days or days packed by segment.

    Complaints and closures may be rows of a day or packed. What holds for all days of a storm is a span, so days are not
    unfolded before they have met their segment.
    """
    calendar = cut_lineage(numbered_calendar(storms), "calendar")
    opening = calendar.where("day_offset = 0").select("storm_id", F.col("day_no").alias("_first"), (F.col("day_no") + F.col("n_days") - 1).alias("_last"))
    no = F.lit(None)

    def shape(df, kind, value=no, first=no, last=no, packed=no):
        return df.select("objectid", F.lit(kind).cast("byte").alias("kind"), first.cast("int").alias("first"), last.cast("int").alias("last"),
                         value.cast("double").alias("value"), packed.cast("binary").alias("packed"))

    def daily(df, kind, value):
        if "packed" in df.columns:
            return shape(df, kind, packed=F.col("packed"))
        rows = df.join(calendar.select("storm_id", "day_offset", "day_no"), ["storm_id", "day_offset"])
        return shape(rows, kind, value, F.col("day_no"), F.col("day_no"))

    def whole(df, kind, value):
        return shape(df.join(opening, "storm_id"), kind, value, F.col("_first"), F.col("_last"))

    return daily(complaints, COMPLAINTS, F.col("complaints") if "complaints" in complaints.columns else no).unionByName(
        whole(crash, CRASHES, F.col("crash_score"))).unionByName(whole(plowed, PLOWED, F.lit(1))).unionByName(daily(closures, CLOSED, F.lit(1)))


def _with_days(df: DataFrame, n_days: int) -> DataFrame:
    """Each row for each stretch of days, ``_first_day`` to ``_last_day``, with its measured ``_days`` in place of its ``_parts``.

    Readers take thousands of rows at once, so a row should not hold the days of a whole calendar.
    """
    names, unfold = [c for c in df.columns if c != "_parts"], unpacked_totals()
    at_once, firsts = SEGMENTS_AT_ONCE, np.arange(0, n_days, DAYS_A_ROW)
    lasts = np.minimum(firsts + DAYS_A_ROW, n_days) - 1

    def merged(parts: pa.ListArray) -> pa.ListArray:
        rows, flat = len(parts), parts.flatten()
        of = np.repeat(np.arange(rows), np.diff(parts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).cumsum(), prepend=0))
        kinds = flat.field("kind").to_numpy(zero_copy_only=False)
        sums, seen = np.zeros((4, rows * n_days)), np.zeros(rows * n_days, bool)
        spans = np.flatnonzero(flat.field("packed").is_null().to_numpy(zero_copy_only=False))
        first, last, value = (flat.field(c).take(pa.array(spans)).to_numpy(zero_copy_only=False) for c in ("first", "last", "value"))
        length = (last - first + 1).astype(np.int64)
        days = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(first.astype(np.int64), length)
        days += np.repeat(of[spans] * n_days, length)
        np.add.at(sums, (np.repeat(kinds[spans], length), days), np.repeat(value, length))
        seen[days] = True
        for k, packed in enumerate(flat.field("packed").to_pylist()):
            if packed is not None:
                slots, totals = unfold(packed)
                slots += of[k] * n_days
                sums[kinds[k], slots] += totals
                seen[slots] = True
        at = np.flatnonzero(seen)
        whole = [pa.array(np.minimum(sums[k, at], top).astype(np.int64)) for k, top in ((0, np.inf), (2, 1), (3, 1))]
        found = pa.StructArray.from_arrays([pa.array((at % n_days).astype(np.int32)), whole[0], pa.array(sums[1, at]), *whole[1:]],
                                           ["day_no", "complaints", "crash_score", "plowed", "closure"])
        starts = np.searchsorted(at, (np.arange(rows)[:, None] * n_days + firsts).ravel())
        return pa.ListArray.from_arrays(pa.array(np.append(starts, len(at)).astype(np.int32)), found)

    def unfolded(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, at_once):
                part = batch.slice(start, at_once)
                each = pa.array(np.repeat(np.arange(part.num_rows), len(firsts)))
                stretch = [pa.array(np.tile(days, part.num_rows).astype(np.int32)) for days in (firsts, lasts)]
                yield pa.RecordBatch.from_arrays([*[part.column(c).take(each) for c in names], *stretch, merged(part.column("_parts"))],
                                                 [*names, "_first_day", "_last_day", "_days"])

    schema = StructType([df.schema[c] for c in names]).add("_first_day", "integer").add("_last_day", "integer")
    return df.mapInArrow(unfolded, schema.add("_days", DataType.fromDDL(DAYS)))


def risk_labels(segments: DataFrame, storms: DataFrame, measures: DataFrame) -> DataFrame:
    """One labelled row per segment, storm and watched day, with every column of ``segments``.

    The measured days of a segment are one list, which meets the segment once; the grid is unfolded from it, measured
    days and the others, so neither is shuffled, nor joined to more than the calendar. Maxima for the log scaling and the
    percentiles of a storm follow from the measured days alone, since every other row of the storm has one known score.
    """
    calendar = cut_lineage(
        numbered_calendar(storms).join(storms.select("storm_id", "season", "total_snowfall_cm"), "storm_id")
        .select("storm_id", "day_offset", "n_days", "season", "total_snowfall_cm", "day_no"), "calendar")
    grid_days = calendar.count()
    # Both sides dealt by segment once; spread by the rows they unfold to, since what is stored is small.
    tasks = tasks_for(segments.sparkSession, segments.count() * grid_days, GRID_ROWS_A_TASK)
    listed = measures.repartition(tasks, "objectid").groupBy("objectid").agg(F.collect_list(
        F.struct("kind", "first", "last", "value", "packed")).alias("_parts"))
    # Ids may repeat; a measured day counts once for the storm. Measured ids without a segment have no copy number.
    copies = segments.repartition(tasks, "objectid").withColumn("_copy", F.row_number().over(Window.partitionBy("objectid").orderBy("objectid")))
    laid = cut_lineage(_with_days(copies.join(listed, "objectid", "full"), grid_days), "laid", compression="zstd")
    counted = laid.where("_copy is null or (_copy = 1 and objectid is not null)").select("objectid", F.inline("_days"))

    # Few measures differ on a day: the days are unfolded once, and maxima and scores follow from their histogram.
    alike = cut_lineage(counted.groupBy("day_no", "complaints", "crash_score", "plowed", "closure").agg(F.count("*").alias("n")), "alike")
    scale = alike.groupBy("day_no").agg(
        F.max(F.log1p("complaints")).alias("top_complaints"), F.max(F.log1p("crash_score")).alias("top_crash"),
        F.max("plowed").alias("plowed"))
    has_plow = F.coalesce(F.max("plowed").over(Window.partitionBy("storm_id")) == 1, F.lit(False))
    days = cut_lineage(calendar.join(scale, "day_no", "left").withColumn("has_plow", has_plow).drop("plowed").fillna(
        0.0, ["top_complaints", "top_crash"]), "days")

    def scaled(value, top):
        return F.when(top > 0, F.log1p(value) / top).otherwise(0.0)

    gap = F.when(F.col("has_plow"), (1 - F.col("plowed")).cast("double"))
    score = composite_risk(
        scaled(F.col("complaints"), F.col("top_complaints")), scaled(F.col("crash_score"), F.col("top_crash")),
        F.coalesce(gap, F.lit(0.0)), F.col("closure").cast("double"), F.col("has_plow"))
    resting = F.when(F.col("has_plow"), F.round(F.lit(WEIGHT_PLOW), 6)).otherwise(0.0)
    seen = alike.join(days, "day_no").groupBy("storm_id", score.alias("risk_score")).agg(F.sum("n").alias("n"))
    n_segments = segments.agg(F.count("*")).scalar()
    rest = days.where(F.col("day_offset") == 0).join(
        seen.groupBy("storm_id").agg(F.sum("n").alias("seen")), "storm_id", "left").select(
        "storm_id", resting.alias("risk_score"), (n_segments * F.col("n_days") - F.coalesce("seen", F.lit(0))).alias("n"))
    top = cut_lineage(bounded_percentiles(seen.unionByName(rest).where(F.col("n") > 0), ["storm_id"], "risk_score", "n",
                                          {"p95": 0.95, "p99": 0.99}), "top")
    # The bounds ride on the days, so that nothing else is joined to the unfolded grid.
    days = cut_lineage(days.join(top, "storm_id"), "bounded-days")

    own = laid.where(F.col("_copy").isNotNull())
    day_columns = [F.col(c) for c in ("storm_id", "day_offset", "season", "total_snowfall_cm")]
    any_incident = F.when((F.col("complaints") > 0) | (F.col("crash_score") > 0) | (F.col("closure") > 0)
                          | F.coalesce(gap > 0, F.lit(False)), 1).otherwise(0).cast("bigint")
    measured_rows = own.select(*segments.columns, F.inline("_days")).join(days, "day_no").select(
        *segments.columns, *day_columns, F.col("complaints").cast("double").alias("storm_311_count"),
        F.round("crash_score", 4).alias("storm_crash_score"), gap.alias("storm_plow_gap"),
        F.col("closure").cast("double").alias("storm_domi_closure"), score.alias("risk_score"),
        any_incident.alias("label_any_incident"), "p95", "p99")
    free = F.array_except(F.sequence("_first_day", "_last_day"), F.transform("_days", lambda d: d["day_no"]))
    resting_rows = own.select(*segments.columns, F.explode(free).alias("day_no")).join(days, "day_no").select(
        *segments.columns, *day_columns,
        F.lit(0.0).alias("storm_311_count"), F.lit(0.0).alias("storm_crash_score"),
        F.when(F.col("has_plow"), 1.0).alias("storm_plow_gap"), F.lit(0.0).alias("storm_domi_closure"),
        resting.alias("risk_score"), F.col("has_plow").cast("bigint").alias("label_any_incident"), "p95", "p99")
    labelled = measured_rows.unionByName(resting_rows)

    def among_top(bound):
        return F.when((F.col("risk_score") >= F.col(bound)) & (F.col("risk_score") > 0), 1).otherwise(0).cast("bigint")

    return labelled.select(
        *[c for c in resting_rows.columns if c not in ("p95", "p99")], among_top("p99").alias("label_top_1pct"),
        among_top("p95").alias("label_top_5pct"))
