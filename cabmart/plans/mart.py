"""Datamart models (M8-M12): date dimension, type-2 dimensions, weather dimension, trip fact."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import (date_key, day_name, month_name, iso_week, is_weekend, season,
                         holiday_name, is_holiday, weather_bins, positive_flag, time_text,
                         hour_of, minutes_between, dec2, time_of_day)
from ..operators.lookup import DEFAULT_BROADCAST_LIMIT
from ..operators import (number_in_buckets, lookup, lookup_many, broadcast_if_small, scd2_apply, upsert_by_key,
                         read_mark, after_process_mark, high_water)

# The reference range of the date dimension.
DATE_START = "2024-01-01"
DATE_END = "2050-12-31"


def _days(start: str, end: str) -> int:
    return (_dt.date.fromisoformat(end) - _dt.date.fromisoformat(start)).days + 1


def dm_date(spark: SparkSession, start: str = DATE_START, end: str = DATE_END) -> DataFrame:
    """M8: one row per day, both ends included."""
    days = spark.range(1).select(F.explode(F.sequence(
        F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("INTERVAL 1 DAY")))
        .alias("d"))
    return days.select(
        date_key("d").alias("key_date"), F.col("d").alias("date"),
        day_name("d").alias("day_name"), month_name("d").alias("month_name"),
        F.year("d").cast("short").alias("year"), iso_week("d").alias("week"),
        is_weekend("d").alias("is_weekend"), season("d").alias("season"),
        is_holiday("d").alias("is_holiday"), holiday_name("d").alias("holiday_name"))


def date_bounds(first: DataFrame, first_col: str, last: DataFrame, last_col: str):
    """(earliest date of ``first_col``, latest date of ``last_col``): two aggregates, read
    as driver values, to size a date dimension to the data."""
    lo = first.agg(F.min(F.to_date(first_col))).first()[0]
    hi = last.agg(F.max(F.to_date(last_col))).first()[0]
    return lo.isoformat(), hi.isoformat()


def _mark_filter(batch, marks, name, col):
    if marks is None:
        return batch
    return after_process_mark(batch, col, read_mark(marks, name))


def dm_vendor(ods_vendor: DataFrame, target: DataFrame | None = None,
              marks: DataFrame | None = None, stored: bool = False) -> DataFrame:
    """M9: type-2 vendor dimension keyed by id_vendor, tracking the name.

    ``stored=True`` says the ODS input is a stored table (no extra write)."""
    batch = ods_vendor.select("id_vendor", "vendor_name",
                              F.col("last_update").alias("ods_update_time"))
    if target is not None:
        batch = _mark_filter(batch, marks, "dm_vendor", "ods_update_time")
    return scd2_apply(target, batch, ["id_vendor"], ["vendor_name"], key_col="key_vendor",
                      stored_batch=stored)


def zone_source(ods_borough: DataFrame, ods_neighborhood: DataFrame) -> DataFrame:
    """Zones with their borough name (inner join parent-child)."""
    b = ods_borough.select("id_borough", "borough_name")
    b = broadcast_if_small(b)
    return (ods_neighborhood.join(b, ods_neighborhood["borough_fk"] == b["id_borough"])
            .select("id_neighborhood", "neighborhood_name", "service_zone", "borough_name",
                    F.col("last_update").alias("ods_update_time")))


def dm_zone(ods_borough: DataFrame, ods_neighborhood: DataFrame,
            target: DataFrame | None = None, marks: DataFrame | None = None,
            stored: bool = False) -> DataFrame:
    """Type-2 zone dimension keyed by id_neighborhood (the name pair is not unique)."""
    batch = zone_source(ods_borough, ods_neighborhood)
    if target is not None:
        batch = _mark_filter(batch, marks, "dm_zone", "ods_update_time")
    out = scd2_apply(target, batch, ["id_neighborhood"],
                     ["neighborhood_name", "borough_name", "service_zone"], key_col="key_zone",
                     stored_batch=stored)
    return out.select("key_zone", "id_neighborhood", "neighborhood_name", "borough_name",
                      "service_zone", "valid_from", "valid_to", "is_current")


WEATHER_DIM_COLUMNS = [
    "key_weather", "id_weather", "weather_date", "weather_time", "temperature",
    "apparent_temperature", "rain", "snowfall", "wind_speed", "humidity", "borough_name",
    "temperature_category", "apparent_temperature_category", "rain_intensity",
    "snow_intensity", "is_rainy", "is_snowy", "wind_intensity",
]


def weather_attributes(ods_weather: DataFrame, ods_borough: DataFrame) -> DataFrame:
    """Borough name by key ('unknown' when missing) and the category bins."""
    w = lookup(ods_weather, ods_borough, [("borough_fk", "id_borough")],
               {"borough_name": ("borough_name", "unknown")})
    return w.select("id_weather", "weather_date", "weather_time", "temperature",
                    "apparent_temperature", "rain", "snowfall", "wind_speed", "humidity",
                    "borough_name", *weather_bins(),
                    positive_flag("rain").alias("is_rainy"),
                    positive_flag("snowfall").alias("is_snowy"))


def dm_weather_dt(ods_weather: DataFrame, ods_borough: DataFrame,
                  target: DataFrame | None = None, marks: DataFrame | None = None,
                  last_key: int | None = None) -> DataFrame:
    """Weather dimension; new readings get fresh keys, a re-read reading keeps the key it
    had (facts hold it) and has its other columns replaced.

    ``target`` may be the part of the dimension that the readings' months are in; then
    ``last_key`` is the largest key of the whole."""
    src = ods_weather
    if target is not None:
        src = _mark_filter(src, marks, "dm_weather_dt", "last_update")
    attrs = weather_attributes(src, ods_borough)
    # Ids begin with the hex digits of a hash: two of them make 256 even buckets.
    bucket = [F.substring("id_weather", 1, 2)]
    order = ["id_weather", "weather_date", "weather_time", "temperature",
             "apparent_temperature", "rain", "snowfall", "wind_speed", "humidity"]
    if target is None:
        return number_in_buckets(attrs, bucket, order, "key_weather").select(*WEATHER_DIM_COLUMNS)
    known = target.select("id_weather", "key_weather")
    fresh = number_in_buckets(attrs.join(known, "id_weather", "left_anti"), bucket, order, "key_weather",
                              start=(high_water(target, "key_weather") or 0) if last_key is None else last_key)
    again = attrs.join(known, "id_weather")
    batch = fresh.select(*WEATHER_DIM_COLUMNS).unionByName(again.select(*WEATHER_DIM_COLUMNS))
    return upsert_by_key(target, batch, ["id_weather"])


FACT_COLUMNS = [
    "key_taxi_trip", "id_trip", "key_vendor", "key_zone_pickup", "key_zone_dropoff",
    "key_date_pickup", "key_date_dropoff", "key_weather", "pickup_time", "dropoff_time",
    "payment_type", "ratecode_name", "store_and_fwd_flag", "passenger_count", "trip_distance",
    "fare_amount", "extra", "mta_tax", "tip_amount", "tolls_amount", "improvement_surcharge",
    "congestion_surcharge", "airport_fee", "total_amount", "trip_duration_minutes",
    "tip_percentage", "is_cross_borough", "time_of_day_category",
]

# Partition column of the stored fact: the month of the pickup itself, so a
# trip stays in its month whatever the date dimension covers.
PICKUP_MONTH = "pickup_month"

# Total order for fact keys: pickup day first (keys grow with time) and two hex
# digits of the trip id's hash (buckets that are numbered side by side), then
# every column, so reruns number identical input identically.
FACT_KEY_ORDER = [c for c in FACT_COLUMNS if c not in ("key_taxi_trip", "id_trip", "key_date_pickup")]
FACT_KEY_ORDER = ["id_trip"] + FACT_KEY_ORDER


def fact_key_buckets():
    return [F.col("key_date_pickup"), F.substring(F.sha2("id_trip", 256), 1, 2)]


def trip_month(c="pickup_datetime"):
    return F.date_format(F.col(c), "yyyyMM").cast("int")


def _frame(dim):
    """A dimension, or a function that builds it (called only where it is joined)."""
    return dim() if callable(dim) else dim


def fact_rows(ods_trip: DataFrame, vendors, zones, dates, weather, payments, ratecodes,
              date_rows: int | None = None, only: list[str] | None = None,
              month: bool = False, limit: int = DEFAULT_BROADCAST_LIMIT) -> DataFrame:
    """M12 without the key: date/time split, eight lookups with unknown members, measures.

    ``only`` names the fact columns that are needed: lookups that none of them
    comes from are not joined, and dimensions given as functions not built.
    ``month`` adds the pickup month.  Weather beyond the broadcast ``limit`` is looked up
    a few months at a time, so that the fact is not shuffled for it.
    """
    wanted = [c for c in FACT_COLUMNS if c != "key_taxi_trip" and (only is None or c in only)]
    need = set(wanted)
    by_borough = bool(need & {"key_weather", "is_cross_borough"})
    o = ods_trip.select(
        (F.col(PICKUP_MONTH) if PICKUP_MONTH in ods_trip.columns else trip_month()).alias(PICKUP_MONTH),
        "id_trip",
        F.to_date("pickup_datetime").alias("_pickup_date"),
        F.to_date("dropoff_datetime").alias("_dropoff_date"),
        time_text("pickup_datetime").alias("pickup_time"),
        time_text("dropoff_datetime").alias("dropoff_time"),
        hour_of("pickup_datetime").alias("_pickup_hour"),
        minutes_between("pickup_datetime", "dropoff_datetime").alias("_minutes"),
        "passenger_count", "trip_distance", "fare_amount", "extra", "mta_tax", "tip_amount",
        "tolls_amount", "improvement_surcharge", "congestion_surcharge", "airport_fee",
        "total_amount", "pickup_neighborhood_fk", "dropoff_neighborhood_fk", "rate_code_fk",
        "vendor_fk", "store_and_fwd_flag", "payment_type_fk")
    current = F.col("is_current")
    zoned = _frame(zones) if by_borough or need & {"key_zone_pickup", "key_zone_dropoff"} else None
    dated = _frame(dates) if need & {"key_date_pickup", "key_date_dropoff"} else None
    specs = []
    if "key_vendor" in need:
        specs.append(dict(dim=_frame(vendors), on=[("vendor_fk", "id_vendor")],
                          take={"key_vendor": ("key_vendor", -1)}, dim_filter=current))
    for side, borough in (("pickup", "_pu_borough"), ("dropoff", "_do_borough")):
        # the weather lookup needs the pickup borough, the cross-borough flag both
        if f"key_zone_{side}" in need or "is_cross_borough" in need or by_borough and side == "pickup":
            specs.append(dict(dim=zoned, on=[(f"{side}_neighborhood_fk", "id_neighborhood")],
                              take={f"key_zone_{side}": ("key_zone", -1), borough: ("borough_name", None)},
                              dim_filter=current))
        if f"key_date_{side}" in need:
            specs.append(dict(dim=dated, on=[(f"_{side}_date", "date")],
                              take={f"key_date_{side}": ("key_date", -1)}, max_rows=date_rows))
    if "key_weather" in need:
        # the weather hour of the trip's pickup borough (borough from the pickup zone above)
        w = _frame(weather).select("key_weather", "borough_name", "weather_date",
                                   F.substring("weather_time", 1, 2).cast("int").alias("_hour"))
        specs.append(dict(dim=w, on=[("_pu_borough", "borough_name"), ("_pickup_date", "weather_date"),
                                     ("_pickup_hour", "_hour")], take={"key_weather": ("key_weather", -1)},
                          slices=(PICKUP_MONTH, trip_month("weather_date"))))
    if "payment_type" in need:
        specs.append(dict(dim=_frame(payments), on=[("payment_type_fk", "id_payment_type")],
                          take={"payment_type": ("payment_type", "Unknown")}))
    if "ratecode_name" in need:
        specs.append(dict(dim=_frame(ratecodes), on=[("rate_code_fk", "id_ratecode")],
                          take={"ratecode_name": ("ratecode_name", "Unknown")}))
    o = lookup_many(o, specs, limit=limit) if specs else o
    fare, tip = F.col("fare_amount"), F.col("tip_amount")
    made = {
        "trip_duration_minutes": lambda: dec2("_minutes"),
        "tip_percentage": lambda: F.when(fare > 0, dec2(tip / fare * 100))
                                   .otherwise(F.lit(0).cast("decimal(10,2)")),
        "is_cross_borough": lambda: F.coalesce(F.col("_pu_borough") != F.col("_do_borough"), F.lit(False)),
        "time_of_day_category": lambda: time_of_day("_pickup_hour"),
    }
    return o.select(*[made[c]().alias(c) if c in made else F.col(c) for c in wanted],
                    *([PICKUP_MONTH] if month else []))


def dm_fact_taxi_trip(ods_trip: DataFrame, vendors: DataFrame, zones: DataFrame,
                      dates: DataFrame, weather: DataFrame, payments: DataFrame,
                      ratecodes: DataFrame, start: int = 0, marks: DataFrame | None = None,
                      date_rows: int | None = None, month: bool = False) -> DataFrame:
    """The trip fact with dense keys after ``start``."""
    src = ods_trip
    if marks is not None:
        src = _mark_filter(src, marks, "dm_fact_taxi_trip", "last_update")
    rows = fact_rows(src, vendors, zones, dates, weather, payments, ratecodes, date_rows, month=month)
    keyed = number_in_buckets(rows, fact_key_buckets(), FACT_KEY_ORDER, "key_taxi_trip", start=start)
    return keyed.select(*FACT_COLUMNS, *([PICKUP_MONTH] if month else []))


def date_rows_between(start: str, end: str) -> int:
    return _days(start, end)
