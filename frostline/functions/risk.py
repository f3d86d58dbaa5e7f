"""Risk scores, categories and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label weights, category bounds, label names, route cost.
WEIGHT_COMPLAINTS = 0.45
WEIGHT_CRASHES = 0.25
WEIGHT_PLOW = 0.15
WEIGHT_CLOSURES = 0.15
CATEGORIES = [("very_low", 0.05), ("low", 0.15), ("moderate", 0.35), ("high", 0.55), ("very_high", None)]
FIVE_LABELS = {
    "very_low": "open",
    "low": "low_risk",
    "moderate": "moderate_risk",
    "high": "high_risk",
    "very_high": "closed",
}
PROBABILITY_BANDS = [("open", 0.25), ("low_risk", 0.5), ("moderate_risk", 0.75), ("closed", None)]
RISK_WEIGHT = 10.0
SPEED_M_PER_S = 30 * 1000 / 3600


def _bands(value: Column, bands: list[tuple[str, float | None]]) -> Column:
    out = None
    for name, upper in bands:
        if upper is None:
            out = out.otherwise(name)
        else:
            out = F.when(value < upper, name) if out is None else out.when(value < upper, name)
    return F.when(value.isNotNull(), out)


def risk_category(score: Column) -> Column:
    return _bands(score, CATEGORIES)


def probability_label(p: Column) -> Column:
    """Label of a closure probability."""
    return _bands(p, PROBABILITY_BANDS)


def status_label(category: Column, variant: str = "five") -> Column:
    """Map label of a category; variant ``four`` folds high into closed, ``route`` sends unknown names to closed."""
    names = dict(FIVE_LABELS)
    if variant == "four":
        names["high"] = "closed"
    default = "closed" if variant == "route" else "open"
    out = None
    for cat, label in names.items():
        out = F.when(category == cat, label) if out is None else out.when(category == cat, label)
    return out.otherwise(default)


def highway_tier(road_class: Column) -> Column:
    """Highway tier of a road class; rules apply in this order."""
    c = F.lower(F.coalesce(road_class, F.lit("")))
    return (
        F.when(c.contains("principal") | c.contains("major arterial"), "primary")
        .when(c.contains("minor arterial"), "secondary")
        .when(c.contains("collector"), "tertiary")
        .when(c.contains("alley"), "service")
        .otherwise("residential")
    )


def condition_score(risk: Column) -> Column:
    return F.round((1 - risk) * 100).cast("bigint")


def edge_cost(length_m: Column, risk: Column) -> Column:
    return length_m * (1 + F.lit(RISK_WEIGHT) * risk)


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def composite_risk(complaints: Column, crashes: Column, plow: Column, closures: Column, has_plow: Column) -> Column:
    """Weighted sum of normalised measures; without plow data the other weights are rescaled to one."""
    rest = WEIGHT_COMPLAINTS + WEIGHT_CRASHES + WEIGHT_CLOSURES
    with_plow = (
        F.lit(WEIGHT_COMPLAINTS) * complaints
        + F.lit(WEIGHT_CRASHES) * crashes
        + F.lit(WEIGHT_PLOW) * plow
        + F.lit(WEIGHT_CLOSURES) * closures
    )
    without = (
        F.lit(WEIGHT_COMPLAINTS / rest) * complaints
        + F.lit(WEIGHT_CRASHES / rest) * crashes
        + F.lit(WEIGHT_CLOSURES / rest) * closures
    )
    return F.round(clip(F.when(has_plow, with_plow).otherwise(without), 0.0, 1.0), 6)


def weather_severity(snow_cm: Column, min_temp_c: Column, wind_kmh: Column, days: Column) -> Column:
    """Severity of a weather scenario, 0.1 to 1."""
    snow = F.least(snow_cm / 25, F.lit(1.0))
    cold = F.least(F.greatest(-min_temp_c, F.lit(0.0)) / 15, F.lit(1.0))
    wind = F.least(wind_kmh / 60, F.lit(1.0))
    duration = F.least(days / 3, F.lit(1.0))
    return clip(0.45 * snow + 0.20 * cold + 0.20 * wind + 0.15 * duration, 0.1, 1.0)


def calibrated(raw: Column, p75: Column, p99: Column, severity: Column) -> Column:
    """Logistic position of a raw score among its scenario-day's scores, bent by the severity."""
    spread = F.greatest(p99 - p75, F.lit(1e-6))
    position = 1 / (1 + F.exp(-((raw - p75) / spread * 3)))
    bend = clip(1 / F.greatest(severity, F.lit(0.1)), 0.3, 5.0)
    return F.round(clip(F.pow(position, bend), 0.0, 1.0), 6)
