"""Column-level building blocks (all built-in Spark expressions, no UDFs)."""

from .text import normalize_text, clean_name
from .numeric import dec2, int_half_even, clamp_zero, safe_div, as_double
from .calendar import (date_key, day_name, month_name, iso_week, day_of_week0, is_weekend,
                       season, holiday_name, is_holiday, time_text, hour_of,
                       minutes_between, truncate_to_hour, ntz_lit)
from .bins import bin_column, BINS, weather_bins, time_of_day, positive_flag
from .keys import hash_key, UNKNOWN, unknown_hash, trip_id, weather_id

__all__ = [
    "normalize_text", "clean_name", "dec2", "int_half_even", "clamp_zero", "safe_div", "as_double",
    "date_key", "day_name", "month_name", "iso_week", "day_of_week0", "is_weekend", "season",
    "holiday_name", "is_holiday", "time_text", "hour_of", "minutes_between", "truncate_to_hour", "ntz_lit",
    "bin_column", "BINS", "weather_bins", "time_of_day", "positive_flag",
    "hash_key", "UNKNOWN", "unknown_hash", "trip_id", "weather_id",
]
