"""Date and time attributes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The four holidays of the date dimension (month-day, name).
HOLIDAYS = [
    ("01-01", "New Year's Day"),
    ("07-04", "Independence Day"),
    ("11-11", "Veterans Day"),
    ("12-25", "Christmas Day"),
]

# Season by month (northern hemisphere).
SEASONS = [
    ((12, 1, 2), "Winter"),
    ((3, 4, 5), "Spring"),
    ((6, 7, 8), "Summer"),
    ((9, 10, 11), "Fall"),
]


def ntz_lit(value) -> Column:
    """A TIMESTAMP_NTZ literal from a naive datetime or text, with no time-zone round trip.

    (A Python datetime literal would pass through the session and process time
    zones on its way to a zone-free timestamp.)"""
    if value is None:
        return F.lit(None).cast("timestamp_ntz")
    if hasattr(value, "isoformat"):
        value = value.isoformat(sep=" ")
    return F.lit(str(value)).cast("timestamp_ntz")


def date_key(d) -> Column:
    """yyyymmdd as INT."""
    return F.date_format(_col(d), "yyyyMMdd").cast("int")


def day_name(d) -> Column:
    return F.lower(F.date_format(_col(d), "EEEE"))


def month_name(d) -> Column:
    return F.lower(F.date_format(_col(d), "MMMM"))


def iso_week(d) -> Column:
    return F.weekofyear(_col(d)).cast("int")


def day_of_week0(d) -> Column:
    """0 = Sunday .. 6 = Saturday (Spark's dayofweek is 1 = Sunday)."""
    return F.dayofweek(_col(d)) - 1


def is_weekend(d) -> Column:
    return F.dayofweek(_col(d)).isin(1, 7)


def season(d) -> Column:
    m = F.month(_col(d))
    expr = None
    for months, label in SEASONS:
        expr = (F.when(m.isin(*months), F.lit(label)) if expr is None
                else expr.when(m.isin(*months), F.lit(label)))
    return expr


def holiday_name(d) -> Column:
    md = F.date_format(_col(d), "MM-dd")
    expr = None
    for day, label in HOLIDAYS:
        expr = (F.when(md == day, F.lit(label)) if expr is None
                else expr.when(md == day, F.lit(label)))
    return expr.otherwise(F.lit(None).cast("string"))


def is_holiday(d) -> Column:
    return F.date_format(_col(d), "MM-dd").isin(*[day for day, _ in HOLIDAYS])


def time_text(ts) -> Column:
    """Time of day as HH:mm:ss text (Spark has no default TIME type)."""
    return F.date_format(_col(ts), "HH:mm:ss")


def hour_of(ts) -> Column:
    return F.hour(_col(ts)).cast("short")


def minutes_between(start, end) -> Column:
    """(end - start) in minutes as DOUBLE, like EXTRACT(EPOCH FROM end - start) / 60."""
    micros = F.timestamp_diff("MICROSECOND", _col(start), _col(end))
    return micros.cast("double") / F.lit(1_000_000.0) / F.lit(60.0)


def truncate_to_hour(ts) -> Column:
    """Start of the hour as TIMESTAMP_NTZ, with no time-zone round trip."""
    t = _col(ts)
    return F.make_timestamp_ntz(F.year(t), F.month(t), F.dayofmonth(t), F.hour(t),
                                F.lit(0), F.lit(0))
