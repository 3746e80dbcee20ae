"""ODS models (M1-M7): raw roles -> cleaned, deduplicated, keyed tables.

Each model is a pure function of DataFrames and a run timestamp; loading
strategies (full refresh, upsert) are applied by the caller.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import (normalize_text, clean_name, hash_key, unknown_hash, UNKNOWN,
                         int_half_even, clamp_zero, trip_id, weather_id, time_text, ntz_lit)
from ..operators import (keep_first, lookup, lookup_many, stamp, upsert_by_key, high_water,
                         after_event_mark, sync_schema)
from ..operators.incremental import EVENT_TIME_FLOOR

# Measured raw weather columns -> ODS names.
WEATHER_MEASURES = [
    ("temperature_2m (°C)", "temperature"),
    ("apparent_temperature (°C)", "apparent_temperature"),
    ("rain (mm)", "rain"),
    ("snowfall (cm)", "snowfall"),
    ("wind_speed_10m (km/h)", "wind_speed"),
    ("relative_humidity_2m (%)", "humidity"),
]


def ods_borough(raw: DataFrame, run_ts, first_only: bool = False) -> DataFrame:
    """M1: normalised distinct borough names + the 'unknown' member, keyed by SHA-256."""
    names = (raw.select("boroughname").distinct()
                .select(normalize_text("boroughname", lower=True, first_only=first_only)
                        .alias("borough_name"))
                .filter(F.col("borough_name").isNotNull()
                        & (F.col("borough_name") != F.lit(UNKNOWN)))
                .distinct())
    default = raw.sparkSession.range(1).select(unknown_hash().alias("id_borough"),
                                               F.lit(UNKNOWN).alias("borough_name"))
    rows = default.unionByName(names.select(hash_key("borough_name").alias("id_borough"),
                                            "borough_name"))
    return stamp(rows, run_ts)


def ods_neighborhood(raw: DataFrame, boroughs: DataFrame, run_ts) -> DataFrame:
    """M2: one row per zone id (first by borough, name, service zone), borough by hash."""
    raw = raw.select("LocationID", "Borough", "Zone", "service_zone").distinct()
    src = raw.select(F.col("LocationID").cast("int").alias("id_neighborhood"),
                     clean_name("Borough", lower=True).alias("borough_name"),
                     clean_name("Zone").alias("neighborhood_name"),
                     clean_name("service_zone").alias("service_zone"))
    first = keep_first(src, ["id_neighborhood"],
                       ["borough_name", "neighborhood_name", "service_zone"])
    hashed = first.select("id_neighborhood", "neighborhood_name", "service_zone",
                          hash_key("borough_name").alias("_fk"))
    joined = lookup(hashed, boroughs, on=[("_fk", "id_borough")],
                    take={"borough_fk": ("id_borough", unknown_hash())})
    return stamp(joined.select("id_neighborhood", "borough_fk", "neighborhood_name",
                               "service_zone"), run_ts)


def ods_code_lookup(raw: DataFrame, id_col: str, name_col: str, out_id: str, out_name: str,
                    run_ts, lower: bool = False, first_only: bool = False,
                    require_id: bool = True) -> DataFrame:
    """M3-M5: code -> name lookups: cleaned text, non-NULL, smallest name per code.

    Raw (code, name) pairs are made distinct first (a map-side hash
    aggregate), so the text cleaning and the MIN run over a handful of rows
    however many raw rows repeat them.
    """
    src = raw.select(id_col, name_col).distinct().select(
                     F.col(id_col).cast("int").alias(out_id),
                     normalize_text(name_col, lower=lower, first_only=first_only).alias(out_name))
    cond = F.col(out_name).isNotNull()
    if require_id:
        cond = cond & F.col(out_id).isNotNull()
    dedup = src.filter(cond).groupBy(out_id).agg(F.min(out_name).alias(out_name))
    return stamp(dedup, run_ts)


def ods_vendor(raw, run_ts, first_only=False):
    return ods_code_lookup(raw, "id", "vendor", "id_vendor", "vendor_name", run_ts,
                           first_only=first_only)


def ods_ratecode(raw, run_ts, first_only=False):
    return ods_code_lookup(raw, "id", "ratecode", "id_ratecode", "ratecode_name", run_ts,
                           first_only=first_only)


def ods_payment_type(raw, run_ts, first_only=False):
    # The payment model tests only the name for NULL (the id may be NULL).
    return ods_code_lookup(raw, "id", "type", "id_payment_type", "payment_type", run_ts,
                           lower=True, first_only=first_only, require_id=False)


def valid_trips(raw: DataFrame, min_pickup=EVENT_TIME_FLOOR) -> DataFrame:
    """both times present, dropoff after pickup, pickup on or after the floor."""
    p, d = F.col("tpep_pickup_datetime"), F.col("tpep_dropoff_datetime")
    return raw.filter(p.isNotNull() & d.isNotNull() & (d > p)
                      & (p >= ntz_lit(min_pickup)))


TRIP_COLUMNS = [
    "id_trip", "pickup_datetime", "dropoff_datetime", "vendor_fk", "pickup_neighborhood_fk",
    "dropoff_neighborhood_fk", "rate_code_fk", "store_and_fwd_flag", "passenger_count",
    "trip_distance", "payment_type_fk", "fare_amount", "extra", "mta_tax", "tip_amount",
    "tolls_amount", "improvement_surcharge", "congestion_surcharge", "airport_fee",
    "total_amount", "last_update",
]


def transform_trips(valid: DataFrame, zones: DataFrame | None, run_ts) -> DataFrame:
    """Trip record -> ODS row: id, casts, clamps, zone ids checked against the zone table.

    Without ``zones`` the ids stay unchecked: for a fact that looks its zones up
    anyway, where an unknown id becomes the unknown member all the same.
    """
    t = valid.select(
        trip_id("VendorID", "tpep_pickup_datetime", "tpep_dropoff_datetime").alias("id_trip"),
        F.col("tpep_pickup_datetime").alias("pickup_datetime"),
        F.col("tpep_dropoff_datetime").alias("dropoff_datetime"),
        F.col("VendorID").cast("int").alias("vendor_fk"),
        F.col("PULocationID").cast("int").alias("_pu"),
        F.col("DOLocationID").cast("int").alias("_do"),
        int_half_even("RatecodeID").alias("rate_code_fk"),
        "store_and_fwd_flag",
        int_half_even("passenger_count").alias("passenger_count"),
        "trip_distance",
        F.col("payment_type").cast("int").alias("payment_type_fk"),
        clamp_zero("fare_amount").alias("fare_amount"),
        clamp_zero("extra").alias("extra"),
        "mta_tax",
        clamp_zero("tip_amount").alias("tip_amount"),
        clamp_zero("tolls_amount").alias("tolls_amount"),
        "improvement_surcharge", "congestion_surcharge", "airport_fee", "total_amount")
    if zones is None:
        t = t.withColumnsRenamed({"_pu": "pickup_neighborhood_fk", "_do": "dropoff_neighborhood_fk"})
        return t.select(*[c for c in TRIP_COLUMNS if c != "last_update"], ntz_lit(run_ts).alias("last_update"))
    ids = zones.select("id_neighborhood")
    t = lookup_many(t, [
        dict(dim=ids, on=[("_pu", "id_neighborhood")],
             take={"pickup_neighborhood_fk": ("id_neighborhood", -1)}),
        dict(dim=ids, on=[("_do", "id_neighborhood")],
             take={"dropoff_neighborhood_fk": ("id_neighborhood", -1)})])
    return t.select(*[c for c in TRIP_COLUMNS if c != "last_update"],
                    ntz_lit(run_ts).alias("last_update"))


def ods_taxi_trip(raw: DataFrame, zones: DataFrame, run_ts, target: DataFrame | None = None,
                  min_pickup=EVENT_TIME_FLOOR, lookback: str = "1 day") -> DataFrame:
    """M6: valid trips newer than the target's pickup mark minus the lookback, upserted on id_trip."""
    valid = valid_trips(raw, min_pickup)
    if target is not None:
        mark = high_water(target, "pickup_datetime")
        valid = after_event_mark(valid, "tpep_pickup_datetime", mark, lookback=lookback,
                                 floor=min_pickup)
    batch = transform_trips(valid, zones, run_ts)
    return batch if target is None else upsert_by_key(target, batch, ["id_trip"])


WEATHER_COLUMNS = ["id_weather", "borough_fk", "weather_date", "weather_time", "temperature",
                   "apparent_temperature", "rain", "snowfall", "wind_speed", "humidity",
                   "last_update", "weather_datetime"]


def weather_source(raw: DataFrame) -> DataFrame:
    """Typed raw readings with lower-cased borough names."""
    cols = [F.lower(F.trim("borough_name")).alias("borough_name"),
            F.col("time").cast("timestamp_ntz").alias("weather_datetime")]
    cols += [F.col(f"`{src}`").cast("double").alias(dst) for src, dst in WEATHER_MEASURES]
    return raw.filter(F.col("time").isNotNull()).select(*cols)


def best_reading(src: DataFrame) -> DataFrame:
    """Per borough and hour the reading with the highest temperature (NULLs last)."""
    return keep_first(src, ["borough_name", "weather_datetime"], ["temperature"],
                      descending=True)


def ods_weather_dt(raw: DataFrame, boroughs: DataFrame, run_ts, target: DataFrame | None = None,
                   policy: str = "fail", mark: bool = True) -> DataFrame:
    """M7: typed, deduplicated hourly readings per borough, upserted on id_weather.

    With ``mark`` only readings newer than the target's newest are taken (the
    whole source is read in every run); a batch of new files is taken whole.
    """
    src = weather_source(raw)
    if target is not None and mark:
        src = after_event_mark(src, "weather_datetime", high_water(target, "weather_datetime"),
                               strict=True)
    best = best_reading(src)
    j = lookup(best, boroughs, [("borough_name", "borough_name")],
               {"borough_fk": ("id_borough", None)})
    rows = j.select(
        weather_id("borough_fk", "weather_datetime").alias("id_weather"), "borough_fk",
        F.to_date("weather_datetime").alias("weather_date"),
        time_text("weather_datetime").alias("weather_time"),
        *[dst for _, dst in WEATHER_MEASURES], "weather_datetime")
    batch = stamp(rows, run_ts).select(*WEATHER_COLUMNS)
    if target is None:
        return batch
    return upsert_by_key(*sync_schema(target, batch, policy), ["id_weather"])
