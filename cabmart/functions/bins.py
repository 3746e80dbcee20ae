"""Binning of measures into labelled categories."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Weather category rules, tested in order; the last label is
# the ELSE branch (it also takes NULL measurements).  "=" is an equality test,
# "<" a strict upper bound.
BINS = {
    "temperature_category": ("temperature", [
        ("<", -10, "Extreme Cold"),
        ("<", 0, "Freezing"),
        ("<", 10, "Cold"),
        ("<", 20, "Mild"),
        ("<", 30, "Warm"),
        ("<", 35, "Hot"),
    ], "Extreme Heat"),
    "apparent_temperature_category": ("apparent_temperature", [
        ("<", 0, "Feels Freezing"),
        ("<", 10, "Feels Cold"),
        ("<", 20, "Feels Mild"),
        ("<", 30, "Feels Warm"),
    ], "Feels Hot"),
    "rain_intensity": ("rain", [
        ("=", 0, "No Rain"),
        ("<", 2.5, "Light Rain"),
        ("<", 10, "Moderate Rain"),
        ("<", 50, "Heavy Rain"),
    ], "Violent Rain"),
    "snow_intensity": ("snowfall", [
        ("=", 0, "No Snow"),
        ("<", 0.5, "Light Snow"),
        ("<", 4, "Moderate Snow"),
    ], "Heavy Snow"),
    "wind_intensity": ("wind_speed", [
        ("=", 0, "No Wind"),
        ("<", 19, "Light Wind"),
        ("<", 38, "Moderate Wind"),
        ("<", 61, "Strong Wind"),
    ], "Very Strong Wind"),
}

# Time-of-day bands by pickup hour (inclusive ranges).
TIME_OF_DAY = [
    (5, 11, "Morning Rush"),
    (12, 15, "Midday"),
    (16, 19, "Evening Rush"),
    (20, 23, "Night"),
]
TIME_OF_DAY_ELSE = "Late Night"


def bin_column(c, rules, else_label: str, null_label: str | None = None) -> Column:
    """CASE WHEN chain over ``rules`` [(op, bound, label)], first match wins.

    NULL fails every test and so lands in ``else_label`` unless
    ``null_label`` is given.
    """
    x = _col(c)
    expr = None
    if null_label is not None:
        expr = F.when(x.isNull(), F.lit(null_label))
    for op, bound, label in rules:
        cond = (x == F.lit(bound)) if op == "=" else (x < F.lit(bound))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(else_label))


def category_labels(name: str) -> list[str]:
    """All labels of one bin rule in their natural order (used for chart ordering)."""
    _, rules, else_label = BINS[name]
    return [label for _, _, label in rules] + [else_label]


def weather_bins() -> list[Column]:
    """All category columns of the weather dimension."""
    return [bin_column(src, rules, other).alias(name)
            for name, (src, rules, other) in BINS.items()]


def positive_flag(c) -> Column:
    """COALESCE(x, 0) > 0."""
    return F.coalesce(_col(c), F.lit(0.0)) > F.lit(0.0)


def time_of_day(hour) -> Column:
    h = _col(hour)
    expr = None
    for lo, hi, label in TIME_OF_DAY:
        cond = h.between(lo, hi)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(TIME_OF_DAY_ELSE))
