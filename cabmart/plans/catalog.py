"""Registered queries over the driver tables: name -> fn(spark, sf_dir) -> DataFrame.

Every query reads the given parquet tables through the stand-in roles and
runs the library's operators over the whole tables.  The two-run scenarios
(upserts, high-water marks, SCD2 changes, appends) split the same source by
event time or derive the second batch from the whole table, so both runs
grow with the data.
"""

from __future__ import annotations

import datetime as _dt
import os
import uuid

from pyspark.sql import functions as F

from ..functions import normalize_text, ntz_lit
from ..functions.calendar import day_of_week0
from ..operators import (materialize, scd2_apply, scd2_changed, scd2_closed, scd2_new, quality_summary, check_models,
                         unique_violations, not_null_violations, empty_watermarks, set_mark, sync_schema,
                         append, high_water, after_event_mark, upsert_by_key as upsert)
from ..session import ensure_checkpoint_dir
from ..sources import standins as S
from ..sources.files import register_views
from ..sources.raw import FileRoles
from ..sources.standins import Tables
from . import ods, mart, reports, charts, warehouse
from .star import LazyStar, RUN_TS

RUN_TS2 = _dt.datetime(2024, 7, 1)
# First-load boundary of the two-run scenarios over the events table.
CUT = _dt.datetime(2024, 1, 20)
# The second run of some scenarios reads from here on, a few days before.
CUT_BACK = _dt.datetime(2024, 1, 15)
NEW_VENDOR_OFFSET = 1_000_000


def _t(spark, sf_dir) -> Tables:
    return Tables(spark, sf_dir)


def _star(spark, sf_dir, trips="money", **dates):
    """Tables are built when a query first asks for them."""
    return LazyStar(_t(spark, sf_dir), trips, **dates)


def _folder(spark, name):
    """A fresh folder under the shared checkpoint folder."""
    return os.path.join(ensure_checkpoint_dir(spark), "cabmart", f"{name}-{uuid.uuid4().hex}")


# ------------------------------------------------------------------ cleaning
def clean_borough(spark, d):
    return ods.ods_borough(S.raw_borough(_t(spark, d)), RUN_TS)


def clean_zone_dedup(spark, d):
    t = _t(spark, d)
    b = ods.ods_borough(S.raw_borough(t), RUN_TS)
    return ods.ods_neighborhood(S.raw_neighborhood(t), b, RUN_TS)


def clean_vendor(spark, d):
    return ods.ods_vendor(S.raw_vendor(_t(spark, d)), RUN_TS)


def clean_lookup_min(spark, d):
    return ods.ods_ratecode(S.raw_ratecode(_t(spark, d)), RUN_TS)


def clean_payment_type(spark, d):
    return ods.ods_payment_type(S.raw_payment_type(_t(spark, d)), RUN_TS)


def _docs(spark, d):
    return _t(spark, d)("documents").select("doc_id", "text")


def normalize_all(spark, d):
    return _docs(spark, d).select("doc_id", normalize_text("text", lower=True).alias("text_clean"))


def normalize_first_only(spark, d):
    return _docs(spark, d).select(
        "doc_id", normalize_text("text", lower=True, first_only=True).alias("text_clean"))


def borough_first_only(spark, d):
    return ods.ods_borough(S.raw_borough(_t(spark, d)), RUN_TS, first_only=True)


# ------------------------------------------------------------------ trips
def trip_filter_valid(spark, d):
    return ods.valid_trips(S.raw_trip_money(_t(spark, d)))


def _zones(t):
    """Stored ODS borough and zone tables (small; written once)."""
    b = materialize(ods.ods_borough(S.raw_borough(t), RUN_TS), "ods_borough")
    return b, materialize(ods.ods_neighborhood(S.raw_neighborhood(t), b, RUN_TS),
                          "ods_neighborhood")


def trip_transform(spark, d):
    t = _t(spark, d)
    _, n = _zones(t)
    return ods.ods_taxi_trip(S.raw_trip_money(t), n, RUN_TS, min_pickup=S.MIN_PICKUP)


def trip_transform_events(spark, d):
    t = _t(spark, d)
    _, n = _zones(t)
    return ods.ods_taxi_trip(S.raw_trip_events(t), n, RUN_TS)


def trip_id_dups(spark, d):
    return unique_violations(trip_transform(spark, d), "id_trip")


# ------------------------------------------------------------------ weather
# Files have no name for these stand-in boroughs in the fixed list, so their folders are named after them.
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


def _weather_files(spark, d) -> str:
    """The stand-in readings as hourly files: one folder per borough, three preamble lines and a header.

    The column order differs from folder to folder, as the headers say.  Every task
    writes its own file, with the preamble and header in front of its first row.
    """
    root = _folder(spark, "raw")
    raw = S.raw_weather(_t(spark, d))
    names = [c for c in raw.columns if c != "borough_name"]
    for i, region in enumerate(REGIONS):
        own = [names[0], *names[1 + i:], *names[1:1 + i]]
        line = F.concat_ws(
            ",", *[F.coalesce(F.date_format(c, "yyyy-MM-dd'T'HH:mm") if c == "time" else F.col(f"`{c}`").cast("string"),
                              F.lit("")) for c in own])
        head = ["latitude,longitude,elevation", "1.0,2.0,3.0", "", ",".join(own)]
        # The id has the row's number within its partition in the lower 33 bits.
        begins = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
        value = F.when(begins, F.concat(F.lit("\n".join(head) + "\n"), line)).otherwise(line)
        # A file without its header would not be read, so a task's rows stay in one file.
        (raw.filter(F.col("borough_name") == region).select(value.alias("value")).write.option("maxRecordsPerFile", 0)
         .text(os.path.join(root, "weather_dt", f"Weather_{region}", "hourly.csv")))
    return root


def weather_union_tagged(spark, d):
    """Preamble files of all borough folders in one scan, tagged by folder, columns by each file's header."""
    return ods.weather_source(FileRoles(spark, _weather_files(spark, d)).weather())


def lookup_files(spark, d):
    """Code lists and zones as header CSV files, read back through the file roles and cleaned."""
    t = _t(spark, d)
    root = _folder(spark, "raw")
    for name, frame in (("zones/borough.csv", S.raw_borough(t)), ("zones/taxi_zone_lookup.csv", S.raw_neighborhood(t)),
                        ("taxi_trip/vendor_id.csv", S.raw_vendor(t)), ("taxi_trip/ratecode_id.csv", S.raw_ratecode(t)),
                        ("taxi_trip/payment_type.csv", S.raw_payment_type(t))):
        frame.write.option("header", True).csv(os.path.join(root, name))
    r = FileRoles(spark, root)
    b = ods.ods_borough(r.borough(), RUN_TS)
    parts = [b.select(F.lit("borough").alias("kind"), F.col("id_borough").alias("id"), F.col("borough_name").alias("name")),
             ods.ods_neighborhood(r.neighborhood(), b, RUN_TS).select(
                 F.lit("zone"), F.col("id_neighborhood").cast("string"),
                 F.concat_ws("|", "neighborhood_name", "service_zone", "borough_fk"))]
    for kind, frame, key, name in (("vendor", ods.ods_vendor(r.vendor(), RUN_TS), "id_vendor", "vendor_name"),
                                   ("ratecode", ods.ods_ratecode(r.ratecode(), RUN_TS), "id_ratecode", "ratecode_name"),
                                   ("payment", ods.ods_payment_type(r.payment_type(), RUN_TS), "id_payment_type",
                                    "payment_type")):
        parts.append(frame.select(F.lit(kind), F.col(key).cast("string"), F.col(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def trip_files_mixed(spark, d):
    """Trip files of two kinds (a count as INT64 or DOUBLE, other column case) read as one table."""
    t = _t(spark, d)
    root = _folder(spark, "raw")
    raw = S.raw_trip_events(t)
    early = F.col("tpep_pickup_datetime") < ntz_lit(CUT)
    (raw.filter(early).withColumn("RatecodeID", F.col("RatecodeID").cast("bigint"))
        .withColumnRenamed("airport_fee", "Airport_fee")
        .write.parquet(os.path.join(root, "taxi_trip", "a.parquet")))
    raw.filter(~early).write.parquet(os.path.join(root, "taxi_trip", "b.parquet"))
    return ods.valid_trips(FileRoles(spark, root).trips())


def weather_dedup_best(spark, d):
    t = _t(spark, d)
    b, _ = _zones(t)
    return ods.ods_weather_dt(S.raw_weather(t), b, RUN_TS)


def weather_bins(spark, d):
    t = _t(spark, d)
    b, _ = _zones(t)
    return mart.dm_weather_dt(ods.ods_weather_dt(S.raw_weather(t), b, RUN_TS), b)


# ------------------------------------------------------------------ dates
def _trip_dates(spark, d):
    """Date dimension spanning the trips: first order date to last ship date."""
    t = _t(spark, d)
    lo, hi = mart.date_bounds(t("orders"), "o_orderdate", t("lineitem"), "l_shipdate")
    return mart.dm_date(spark, lo, hi)


def date_dim(spark, d):
    return _trip_dates(spark, d)


def views_by_weekday(spark, d):
    """Trips per weekday (0 = Sunday) and pickup borough, read from named views over the raw roles."""
    t = _t(spark, d)
    register_views({"weekday_trips": S.raw_trip_events(t), "weekday_zones": S.raw_neighborhood(t)})
    zones = spark.table("weekday_zones").groupBy(F.col("LocationID").alias("PULocationID")).agg(F.min("Borough").alias("borough"))
    trips = spark.table("weekday_trips").withColumn("weekday", day_of_week0("tpep_pickup_datetime"))
    by_zone = trips.groupBy("weekday", "PULocationID").agg(
        F.count("*").alias("trips"), F.max("fare_amount").alias("top_fare"))
    return (by_zone.join(zones, "PULocationID", "left").groupBy("weekday", "borough")
            .agg(F.sum("trips").alias("trips"), F.max("top_fare").alias("top_fare")))


def date_dim_flags(spark, d):
    dd = _trip_dates(spark, d)
    return dd.filter(F.col("is_holiday") | (F.col("week") == 53)).select(
        "key_date", "date", "day_name", "week", "is_weekend", "season", "holiday_name")


# ------------------------------------------------------------------ fact
def fact_star(spark, d):
    return _star(spark, d, "money").fact


def fact_keys(spark, d):
    """The keys alone: copies and buckets are decided by all columns, so the numbering is fact_star's."""
    return fact_star(spark, d).select("key_taxi_trip", "id_trip", "key_date_pickup")


def fact_unknown_dates(spark, d):
    """Trips outside a narrow date dimension get the unknown member."""
    s = _star(spark, d, date_start="1996-01-01", date_end="1997-12-31")
    f = s.fact_with("key_date_pickup", "key_date_dropoff", "total_amount")
    return (f.groupBy((F.col("key_date_pickup") == -1).alias("unknown_pickup"),
                      (F.col("key_date_dropoff") == -1).alias("unknown_dropoff"))
             .agg(F.count(F.lit(1)).alias("trips"), F.sum("total_amount").alias("revenue")))


def scd2_zone_apply(spark, d):
    """Second zone load where some zones changed service zone: closed + new versions."""
    t = _t(spark, d)
    b, n = _zones(t)
    target = materialize(mart.dm_zone(b, n, stored=True), "dm_zone")
    raw2 = S.raw_neighborhood(t)
    raw2 = raw2.withColumn("service_zone", F.when(F.col("LocationID") % 3 == 0,
                                                  F.lower("service_zone"))
                                            .otherwise(F.col("service_zone")))
    n2 = materialize(ods.ods_neighborhood(raw2, b, RUN_TS2), "ods_neighborhood2")
    return mart.dm_zone(b, n2, target=target, stored=True)


def fact_weather_join(spark, d):
    return _star(spark, d, "events").fact


def fact_measures(spark, d):
    f = _star(spark, d, "money").fact_with("time_of_day_category", "is_cross_borough", "payment_type",
                                           "trip_duration_minutes", "tip_percentage")
    return (f.groupBy("time_of_day_category", "is_cross_borough", "payment_type")
             .agg(F.count(F.lit(1)).alias("trips"),
                  # widest decimal for sums of DECIMAL(10,2), as the SQL engine gives
                  F.sum("trip_duration_minutes").cast("decimal(38,2)").alias("sum_duration"),
                  F.sum("tip_percentage").cast("decimal(38,2)").alias("sum_tip_percentage"),
                  F.max("trip_duration_minutes").alias("max_duration")))


def dim_zone(spark, d):
    t = _t(spark, d)
    b, n = _zones(t)
    return mart.dm_zone(b, n)


# ------------------------------------------------------------------ SCD2 (vendors)
def _vendor_runs(spark, d):
    t = _t(spark, d)
    target = mart.dm_vendor(ods.ods_vendor(S.raw_vendor(t), RUN_TS))
    s = t("supplier")
    renamed = s.select(F.col("s_suppkey").cast("int").alias("id"),
                       F.when(F.col("s_suppkey") % 7 == 0, F.concat("s_name", F.lit(" v2")))
                        .otherwise(F.col("s_name")).alias("vendor"))
    fresh = s.filter(F.col("s_acctbal") < 0).select(
        (F.col("s_suppkey") + NEW_VENDOR_OFFSET).cast("int").alias("id"), F.col("s_name").alias("vendor"))
    batch = (ods.ods_vendor(renamed.unionByName(fresh), RUN_TS2)
             .select("id_vendor", "vendor_name", F.col("last_update").alias("ods_update_time")))
    return target, batch


_SCD = dict(keys=["id_vendor"], tracked=["vendor_name"], key_col="key_vendor")


def scd2_initial(spark, d):
    return _vendor_runs(spark, d)[0]


def q_scd2_changed(spark, d):
    target, batch = _vendor_runs(spark, d)
    return scd2_changed(target, batch, **_SCD)


def q_scd2_closed(spark, d):
    target, batch = _vendor_runs(spark, d)
    return scd2_closed(target, batch, **_SCD)


def q_scd2_new(spark, d):
    target, batch = _vendor_runs(spark, d)
    start = target.agg(F.max("key_vendor")).first()[0]
    return scd2_new(target, batch, start=start, **_SCD)


def q_scd2_apply(spark, d):
    target, batch = _vendor_runs(spark, d)
    return scd2_apply(target, batch, **_SCD)


def scd2_noop(spark, d):
    t = _t(spark, d)
    v = ods.ods_vendor(S.raw_vendor(t), RUN_TS)
    target, _ = _vendor_runs(spark, d)
    return mart.dm_vendor(v, target=target)


# ------------------------------------------------------------------ incremental
def _trip_runs(spark, d):
    t = _t(spark, d)
    _, n = _zones(t)
    raw = S.raw_trip_events(t)
    first = ods.ods_taxi_trip(raw.filter(F.col("tpep_pickup_datetime") < ntz_lit(CUT)), n, RUN_TS)
    return t, n, raw, first


def high_water_lookback(spark, d):
    t, n, raw, first = _trip_runs(spark, d)
    mark = high_water(first, "pickup_datetime")
    valid = after_event_mark(ods.valid_trips(raw), "tpep_pickup_datetime", mark, lookback="1 day")
    return ods.transform_trips(valid, n, RUN_TS2)


def upsert_by_key(spark, d):
    t, n, raw, first = _trip_runs(spark, d)
    return ods.ods_taxi_trip(raw, n, RUN_TS2, target=first)


def high_water_strict(spark, d):
    t = _t(spark, d)
    b, _ = _zones(t)
    raw = S.raw_weather(t)
    first = ods.ods_weather_dt(raw.filter(F.col("time") < ntz_lit(CUT)), b, RUN_TS)
    return ods.ods_weather_dt(raw, b, RUN_TS2, target=first)


def append_after_mark(spark, d):
    t, n, raw, first = _trip_runs(spark, d)
    dims = LazyStar(t, "events").build_dims()
    fact1 = mart.dm_fact_taxi_trip(first, *dims)
    marks = set_mark(empty_watermarks(spark), "dm_fact_taxi_trip", RUN_TS)
    second = ods.ods_taxi_trip(raw, n, RUN_TS2, target=first)
    start = fact1.agg(F.max("key_taxi_trip")).first()[0] or 0
    batch = mart.dm_fact_taxi_trip(second, *dims, start=start, marks=marks)
    return append(fact1, batch)


def watermark_upsert(spark, d):
    t, n, raw, first = _trip_runs(spark, d)
    marks = empty_watermarks(spark)
    marks = set_mark(marks, "ods_taxi_trip", high_water(first, "pickup_datetime"))
    v = ods.ods_vendor(S.raw_vendor(t), RUN_TS)
    marks = set_mark(marks, "dm_vendor", high_water(v, "last_update"))
    second = ods.ods_taxi_trip(raw, n, RUN_TS2, target=first)
    return set_mark(marks, "ods_taxi_trip", high_water(second, "pickup_datetime"))


def fact_two_runs_upsert(spark, d):
    """Two stored warehouse runs over a growing source; the fact is loaded by delete+insert."""
    t = _t(spark, d)
    root = _folder(spark, "warehouse")
    warehouse.run_warehouse(t, root, RUN_TS, trips="events", raw_filter=lambda trips, weather: (
        trips.filter(F.col("tpep_pickup_datetime") < ntz_lit(CUT)), weather))
    # another first day of the date dimension moves no stored trip
    return warehouse.run_warehouse(t, root, RUN_TS2, trips="events", date_start="1999-01-01",
                                   date_end="2050-12-31").fact


def weather_dim_second_run(spark, d):
    """Weather dimension after a run with re-read and new readings: known readings keep their keys."""
    t = _t(spark, d)
    b, _ = _zones(t)
    raw = S.raw_weather(t)
    first = ods.ods_weather_dt(raw.filter(F.col("time") < ntz_lit(CUT)), b, RUN_TS)
    dim = materialize(mart.dm_weather_dt(first, b), "dm_weather")
    again = ods.ods_weather_dt(raw.filter(F.col("time") >= ntz_lit(CUT_BACK)), b, RUN_TS2)
    return mart.dm_weather_dt(again, b, target=dim)


def schema_two_runs(spark, d):
    """A second load that brings a new column and lacks an old one, under both policies."""
    t, n, raw, first = _trip_runs(spark, d)
    keep = ["id_trip", "pickup_datetime", "total_amount", "mta_tax"]
    target = first.select(*keep)
    batch = (ods.transform_trips(ods.valid_trips(raw.filter(F.col("tpep_pickup_datetime") >= ntz_lit(CUT_BACK))), n, RUN_TS2)
             .select("id_trip", "pickup_datetime", "total_amount", "airport_fee"))
    merged = upsert(*sync_schema(target, batch, "merge"), ["id_trip"])
    synced = upsert(*sync_schema(target, batch, "sync_all_columns"), ["id_trip"])
    assert synced.columns == batch.columns and merged.columns == keep + ["airport_fee"]
    return merged.select(F.lit("merge").alias("policy"), *merged.columns).unionByName(
        synced.select(F.lit("sync_all_columns").alias("policy"), *synced.columns), allowMissingColumns=True)


# ------------------------------------------------------------------ reports
def report_multidim(spark, d):
    s = _star(spark, d, "events")
    f = s.fact_with("key_zone_pickup", "key_date_pickup", "total_amount", "trip_distance", "trip_duration_minutes",
                    "tip_amount")
    return reports.weather_multidim(f, s.dm_zone, s.dm_date)


def report_zone_dropoff(spark, d):
    s = _star(spark, d)
    return reports.trips_by_zone(s.fact_with("key_zone_dropoff"), s.dm_zone, "dropoff")


def report_zone_pickup(spark, d):
    s = _star(spark, d)
    return reports.trips_by_zone(s.fact_with("key_zone_pickup"), s.dm_zone, "pickup")


def report_vendor_avg(spark, d):
    s = _star(spark, d)
    return reports.avg_revenue_by_vendor(s.fact_with("key_vendor", "total_amount"), s.dm_vendor)


def report_temp_trips(spark, d):
    s = _star(spark, d, "events")
    return reports.trips_by_weather_category(s.fact_with("key_weather"), s.dm_weather)


def _revenue(s):
    return s.fact_with("key_date_pickup", "total_amount")


def report_best_day(spark, d):
    s = _star(spark, d)
    return reports.best_revenue_day(_revenue(s), s.dm_date, 2001, "january")


def report_month_alpha(spark, d):
    s = _star(spark, d)
    return reports.revenue_by_year_month(_revenue(s), s.dm_date)


def report_month_calendar(spark, d):
    s = _star(spark, d)
    return reports.revenue_by_year_month(_revenue(s), s.dm_date, with_month_number=True)


def _holiday(role, name):
    def q(spark, d):
        s = _star(spark, d)
        f = s.fact_with(f"key_date_{role}", f"key_zone_{role}")
        return reports.holiday_trips(f, s.dm_zone, s.dm_date, role, name)
    return q


def _rate(category, label=None, by_borough=False, value="trips_per_weather", out=None):
    def q(spark, d):
        s = _star(spark, d, "events")
        f = s.fact_with("key_weather", *(["key_zone_pickup"] if by_borough else []))
        r = reports.trips_per_weather_record(f, s.dm_weather, category,
                                             zones=s.dm_zone if by_borough else None,
                                             value_name=value, out_category=out)
        if label:
            r = reports.with_condition_label(r, category, *label,
                                             out="condition" if by_borough else "label")
        return r
    return q


def distance_by_borough(spark, d):
    s = _star(spark, d)
    return reports.distance_by_borough(s.fact_with("key_zone_pickup", "trip_distance", "airport_fee"), s.dm_zone)


def tip_rate_by_temp(spark, d):
    s = _star(spark, d, "events")
    return reports.tip_rate_by_temperature(s.fact_with("key_weather", "tip_amount", "total_amount"), s.dm_weather)


def chart_topn_label(spark, d):
    s = _star(spark, d)
    return charts.top_n_with_label(reports.trips_by_zone(s.fact_with("key_zone_dropoff"), s.dm_zone, "dropoff"), 10)


def chart_category_order(spark, d):
    s = _star(spark, d, "events")
    return charts.rate_by_borough_chart(s.fact_with("key_weather", "key_zone_pickup"), s.dm_weather, s.dm_zone,
                                        "wind_intensity")


def chart_month_order(spark, d):
    s = _star(spark, d)
    return charts.month_order(reports.revenue_by_year_month(_revenue(s), s.dm_date, True))


def chart_revenue_lines(spark, d):
    s = _star(spark, d)
    return charts.revenue_lines(reports.revenue_by_year_month(_revenue(s), s.dm_date, True))


def chart_vendor_bars(spark, d):
    s = _star(spark, d)
    return charts.bars(reports.avg_revenue_by_vendor(s.fact_with("key_vendor", "total_amount"), s.dm_vendor),
                       "vendor_name", "avg_revenue")


def chart_temperature_bars(spark, d):
    s = _star(spark, d, "events")
    r = reports.trips_by_weather_category(s.fact_with("key_weather"), s.dm_weather)
    return charts.bars(r, "apparent_temperature_category", "total_trips")


def chart_holiday_top(spark, d):
    s = _star(spark, d)
    f = s.fact_with("key_date_pickup", "key_zone_pickup")
    return charts.top_bars(reports.holiday_trips(f, s.dm_zone, s.dm_date, "pickup"), 10, "neighborhood_name", "trips")


def chart_rate_binary(spark, d):
    return charts.bars_with_text(_rate("is_rainy", ("Rainy", "Not rainy"))(spark, d), "label", "trips_per_weather",
                                 ["Not rainy", "Rainy"])


# ------------------------------------------------------------------ quality
def quality_not_null(spark, d):
    return not_null_violations(trip_transform(spark, d), "mta_tax")


def quality_unique(spark, d):
    t = _t(spark, d)
    return unique_violations(ods.ods_ratecode(S.raw_ratecode(t), RUN_TS).unionByName(
        ods.ods_ratecode(S.raw_ratecode(t), RUN_TS2)), "id_ratecode")


def quality_summary_q(spark, d):
    t = _t(spark, d)
    b, n = _zones(t)
    trips = ods.ods_taxi_trip(S.raw_trip_money(t), n, RUN_TS, min_pickup=S.MIN_PICKUP)
    models = {"ods_borough": b, "ods_neighborhood": n, "ods_taxi_trip": trips,
              "ods_weather_dt": ods.ods_weather_dt(S.raw_weather(t), b, RUN_TS),
              "ods_ratecode": ods.ods_ratecode(S.raw_ratecode(t), RUN_TS),
              "ods_payment_type": ods.ods_payment_type(S.raw_payment_type(t), RUN_TS),
              "ods_vendor": ods.ods_vendor(S.raw_vendor(t), RUN_TS)}
    return check_models(models).unionByName(quality_summary(trips, "ods_taxi_trip", ["mta_tax"]))


def quality_watermark(spark, d):
    """The watermark table keeps one non-NULL time per target."""
    return quality_summary(watermark_upsert(spark, d), "last_execution_times",
                           ["target_table", "time"])


QUERIES = {
    "clean_borough": clean_borough,
    "clean_zone_dedup": clean_zone_dedup,
    "clean_vendor": clean_vendor,
    "clean_lookup_min": clean_lookup_min,
    "clean_payment_type": clean_payment_type,
    "normalize_all": normalize_all,
    "normalize_first_only": normalize_first_only,
    "borough_first_only": borough_first_only,
    "trip_filter_valid": trip_filter_valid,
    "trip_transform": trip_transform,
    "trip_transform_events": trip_transform_events,
    "trip_id_dups": trip_id_dups,
    "weather_union_tagged": weather_union_tagged,
    "weather_dedup_best": weather_dedup_best,
    "weather_bins": weather_bins,
    "lookup_files": lookup_files,
    "trip_files_mixed": trip_files_mixed,
    "date_dim": date_dim,
    "date_dim_flags": date_dim_flags,
    "views_by_weekday": views_by_weekday,
    "fact_star": fact_star,
    "fact_keys": fact_keys,
    "fact_unknown_dates": fact_unknown_dates,
    "scd2_zone_apply": scd2_zone_apply,
    "fact_weather_join": fact_weather_join,
    "fact_measures": fact_measures,
    "dim_zone": dim_zone,
    "scd2_initial": scd2_initial,
    "scd2_changed": q_scd2_changed,
    "scd2_closed": q_scd2_closed,
    "scd2_new": q_scd2_new,
    "scd2_apply": q_scd2_apply,
    "scd2_noop": scd2_noop,
    "high_water_lookback": high_water_lookback,
    "upsert_by_key": upsert_by_key,
    "high_water_strict": high_water_strict,
    "append_after_mark": append_after_mark,
    "watermark_upsert": watermark_upsert,
    "fact_two_runs_upsert": fact_two_runs_upsert,
    "weather_dim_second_run": weather_dim_second_run,
    "schema_two_runs": schema_two_runs,
    "report_multidim": report_multidim,
    "report_zone_dropoff": report_zone_dropoff,
    "report_zone_pickup": report_zone_pickup,
    "report_vendor_avg": report_vendor_avg,
    "report_temp_trips": report_temp_trips,
    "report_best_day": report_best_day,
    "report_month_alpha": report_month_alpha,
    "report_month_calendar": report_month_calendar,
    "report_holiday_named_pu": _holiday("pickup", "Christmas Day"),
    "report_holiday_named_do": _holiday("dropoff", "Christmas Day"),
    "report_holiday_any_pu": _holiday("pickup", None),
    "report_holiday_any_do": _holiday("dropoff", None),
    "rate_rainy": _rate("is_rainy", ("Rainy", "Not rainy")),
    "rate_snowy": _rate("is_snowy", ("Snowy", "Not snowy")),
    "rate_rain_bin": _rate("rain_intensity"),
    "rate_wind_bin": _rate("wind_intensity"),
    "rate_snow_bin": _rate("snow_intensity"),
    "rate_rainy_by_borough": _rate("is_rainy", ("Rainy", "Not rainy"), by_borough=True),
    "rate_snowy_by_borough": _rate("is_snowy", ("Snowy", "Not snowy"), by_borough=True),
    "rate_bin_by_borough": _rate("temperature_category", by_borough=True,
                                 value="trips_per_category", out="intensity"),
    "rate_rain_bin_by_borough": _rate("rain_intensity", by_borough=True,
                                      value="trips_per_category", out="intensity"),
    "rate_snow_bin_by_borough": _rate("snow_intensity", by_borough=True,
                                      value="trips_per_category", out="intensity"),
    "distance_by_borough": distance_by_borough,
    "tip_rate_by_temp": tip_rate_by_temp,
    "chart_topn_label": chart_topn_label,
    "chart_category_order": chart_category_order,
    "chart_month_order": chart_month_order,
    "chart_revenue_lines": chart_revenue_lines,
    "chart_vendor_bars": chart_vendor_bars,
    "chart_temperature_bars": chart_temperature_bars,
    "chart_holiday_top": chart_holiday_top,
    "chart_rate_binary": chart_rate_binary,
    "quality_not_null": quality_not_null,
    "quality_unique": quality_unique,
    "quality_summary": quality_summary_q,
    "quality_watermark": quality_watermark,
}
