import math

import pytest
from pyspark.sql import functions as F

from frostline.functions import encode, geo, risk, weather


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("x")])
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text,value", [
    ("up", 5.0), ("down", -5.0), ("Steep", 15.0), ("10%", 10.0), ("-3.5 %", -3.5), ("nan", 0.0), ("", 0.0), (None, 0.0),
    ("abc", 0.0)])
def test_incline(spark, text, value):
    assert one(spark, encode.incline_percent(F.lit(text).cast("string"))) == value


@pytest.mark.parametrize("day,season", [("2024-10-01", "2024-25"), ("2024-09-30", "2023-24"), ("2000-01-05", "1999-00")])
def test_season(spark, day, season):
    assert one(spark, encode.winter_season(F.lit(day).cast("date"))) == season


def test_codes_and_flags(spark):
    assert one(spark, encode.code(F.lit(" Collector "), encode.ROAD_CLASS, 1)) == 2
    assert one(spark, encode.code(F.lit("Unheard of"), encode.ROAD_CLASS, 1)) == 1
    assert one(spark, encode.code(F.lit(None).cast("string"), encode.ROAD_CLASS, 1)) == 0
    for text, flag in [("TRUE", True), ("1", True), ("yes", True), ("0", False), (None, False)]:
        assert one(spark, encode.is_true(F.lit(text).cast("string"))) is flag
    assert one(spark, encode.number(F.lit("n/a"))) is None
    assert one(spark, encode.number(F.lit("NaN"))) is None
    for text in ("12f", "3d", "Infinity", "0x1p3", "", "1e", "."):
        assert one(spark, encode.number(F.lit(text))) is None
    assert [one(spark, encode.number(F.lit(t))) for t in ("-1.5e3", "+.5", "7.")] == [-1500.0, 0.5, 7.0]
    assert one(spark, encode.number(F.lit(" 4.5 "))) == 4.5
    assert one(spark, encode.first_filled(F.lit(" "), F.lit(None).cast("string"), F.lit("b"))) == "b"
    assert one(spark, encode.day_of_millis(F.lit("1700000000000"))) == "2023-11-14"
    assert one(spark, encode.day_of_millis(F.lit(None).cast("string"))) == ""


def test_geometry(spark):
    def haversine(lat1, lng1, lat2, lng2):
        p1, p2 = math.radians(lat1), math.radians(lat2)
        a = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(lng2 - lng1) / 2) ** 2
        return 2 * 6371000 * math.atan2(math.sqrt(a), math.sqrt(1 - a))

    got = one(spark, geo.haversine_m(F.lit(40.4), F.lit(-80.0), F.lit(40.5), F.lit(-79.9)))
    assert got == pytest.approx(haversine(40.4, -80.0, 40.5, -79.9), abs=1e-6)
    assert one(spark, geo.bearing_deg(F.lit(40.0), F.lit(-80.0), F.lit(40.0), F.lit(-79.9))) == pytest.approx(90, abs=0.1)
    assert one(spark, geo.angle_between(F.lit(350.0), F.lit(20.0))) == 30
    for turn, words in [(29.0, "Continue on"), (30.0, "Turn right onto"), (150.0, "Continue on"), (210.0, "Turn left onto"),
                        (330.0, "Continue on")]:
        assert one(spark, geo.turn_phrase(F.lit(0.0), F.lit(turn))) == words
    assert one(spark, geo.node_key(F.lit(-79.1234567), F.lit(40.0))) == "-79.12346,40.00000"


def line(*pts):
    return F.array(*[F.struct(F.lit(x).alias("lng"), F.lit(y).alias("lat")) for x, y in pts])


def test_thinning_keeps_ends_and_restarts(spark):
    step = 30 / 111194.9
    pts = [(-80.0, 40.0 + i * step) for i in range(6)]
    kept = one(spark, geo.thin_line(line(*pts), 50.0))
    assert [round((p["lat"] - 40.0) / step) for p in kept] == [0, 2, 4, 5]
    assert len(one(spark, geo.thin_line(line(*pts[:2]), 50.0))) == 2
    assert [p["lat"] for p in one(spark, geo.thin_line(line(*pts[:3]), 50.0))] == [pts[0][1], pts[2][1]]


def test_line_measures(spark):
    pts = [(-80.0, 40.0), (-79.9, 40.1), (-79.8, 40.3)]
    assert one(spark, geo.middle_vertex(line(*pts)))["lat"] == 40.1
    assert one(spark, geo.mean_coordinate(line(*pts), "lat")) == pytest.approx(40.1333333)
    assert one(spark, geo.line_length_m(line(pts[0]))) == 0.0


@pytest.mark.parametrize("score,name", [(0.0, "very_low"), (0.05, "low"), (0.15, "moderate"), (0.35, "high"), (0.55, "very_high"),
                                        (1.0, "very_high")])
def test_categories(spark, score, name):
    assert one(spark, risk.risk_category(F.lit(score))) == name


def test_labels_and_bands(spark):
    assert one(spark, risk.status_label(F.lit("high"))) == "high_risk"
    assert one(spark, risk.status_label(F.lit("high"), "four")) == "closed"
    assert one(spark, risk.status_label(F.lit("?"))) == "open"
    assert one(spark, risk.status_label(F.lit("?"), "route")) == "closed"
    for p, name in [(0.1, "open"), (0.25, "low_risk"), (0.5, "moderate_risk"), (0.75, "closed"), (1.0, "closed")]:
        assert one(spark, risk.probability_label(F.lit(p))) == name
    assert one(spark, risk.highway_tier(F.lit("Major Arterial"))) == "primary"
    assert one(spark, risk.highway_tier(F.lit(None).cast("string"))) == "residential"


def test_calibration_limits(spark):
    same = risk.calibrated(F.lit(2.0), F.lit(2.0), F.lit(2.0), F.lit(1.0))
    assert one(spark, same) == 0.5
    low = risk.calibrated(F.lit(2.0), F.lit(2.0), F.lit(3.0), F.lit(0.1))
    assert one(spark, low) == pytest.approx(0.5 ** 5, abs=1e-6)
    assert one(spark, risk.weather_severity(F.lit(0.0), F.lit(5.0), F.lit(0.0), F.lit(0))) == 0.1
    assert one(spark, risk.weather_severity(F.lit(99.0), F.lit(-40.0), F.lit(99.0), F.lit(9))) == 1.0


def test_snow_decay(spark):
    assert one(spark, weather.thermal_rate(F.lit(-10.0))) == 0.02
    assert one(spark, weather.thermal_rate(F.lit(5.0))) == pytest.approx(0.085)
    assert one(spark, weather.plow_factor(F.lit(200.0))) == 0.1
    assert one(spark, weather.lingering_snow(F.lit(10.0), F.lit(0.0), F.lit(0.0))) == 10.0


def test_forecast_texts(spark):
    assert one(spark, weather.wind_kmh(F.lit("5 to 12 mph"))) == pytest.approx(12 * 1.60934)
    assert one(spark, weather.wind_kmh(F.lit("calm"))) is None
    assert one(spark, weather.accumulation_cm(F.lit("1 to 3 inches, then 2 inches"))) == pytest.approx(3 * 2.54)
    assert one(spark, weather.accumulation_cm(F.lit("dry"))) is None
    assert one(spark, weather.alert_severity(F.lit("EXTREME"))) == 5
    assert one(spark, weather.alert_severity(F.lit(None).cast("string"))) == 1
