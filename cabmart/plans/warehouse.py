"""One warehouse run over stored tables (the model build of the original, as Spark jobs).

Each table gets its load strategy:

* full refresh (ODS lookups, date dimension): a new version folder;
* upsert on a key (ODS trips, ODS weather): rows of the batch replace rows
  with the same key; both are partitioned by month, and only the months
  present in the batch are read and written anew;
* type-2 (vendor and zone dimensions): closed + new versions, new version folder;
* weather dimension: upsert on id_weather by month; re-read readings keep their
  keys, new ones get keys after the largest one;
* fact: delete + insert by id_trip inside the batch's pickup months
  (``fact_mode="upsert"``), or a pure append (``fact_mode="append"``); it is
  partitioned by the month of the pickup itself, so another date range of the
  date dimension moves no row;
* watermarks: one row per target with the newest load time actually read; a
  run whose load time is not later than all of them is refused;
* the declared checks of all seven ODS models, stored as ``quality_summary``; of trips
  and weather the counts are kept by month (``quality_months``), as a key holds
  its time, and a run counts only the months it has touched.

A run publishes all its tables in one snapshot (``sources.snapshots``): until
then, or if it breaks off, readers have the tables of the run before, and frames
read earlier stay valid.  Of two runs that began from one snapshot the second to
end gets ``ConcurrentRunError``.

Schema changes follow each table's policy, applied to target and batch before
they are merged: trips gain new columns (``merge``), weather follows the source
(``sync_all_columns``), all others refuse.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, functions as F

from ..operators import (materialize, read_mark, set_mark, empty_watermarks, high_water, after_event_mark,
                         after_process_mark, sync_schema, require_newer, scratch_scope, check_models, upsert_by_key,
                         monthly_counts, replace_months, summary_of_months)
from ..operators.quality import ODS_KEYS
from ..sources.raw import roles as raw_roles
from ..sources.snapshots import Build
from . import ods, mart
from .star import Star, parallel, STAR_DATE_START, STAR_DATE_END

MONTH = mart.PICKUP_MONTH
WEATHER_MONTH = "weather_month"
#: Property of a snapshot: the largest key handed out by a table so far.
LAST_KEY = "last key of "


def upsert_months(build: Build, name: str, batch: DataFrame, key: str, by: str = MONTH, policy: str = "fail") -> list[int]:
    """delete+insert by ``key`` inside the months (column ``by``) of the batch only; returns these months."""
    prev = build.stored(name)
    batch = batch.select(*[c for c in batch.columns if c != by], by)
    if prev is None:
        return build.save_months(batch, name, by)
    _, batch = sync_schema(prev, batch, policy)
    batch = materialize(batch, f"batch-{name}")
    months = [r[0] for r in batch.select(by).distinct().collect()]    # a few month numbers
    prev, batch = sync_schema(build.stored(name, months), batch, policy)
    return build.save_months(upsert_by_key(prev, batch, [key]), name, by)


def weather_month(c="weather_date"):
    return mart.trip_month(c)


def run_warehouse(t, root: str, run_ts, trips: str = "money", fact_mode: str = "upsert",
                  date_start: str | None = None, date_end: str | None = None, raw_filter=None) -> Star:
    """Build or update every table under ``root``; returns the stored tables.

    ``run_ts`` (naive UTC) stamps the run's rows and must be later than that of
    every run before.  ``raw_filter`` optionally restricts the raw trip and
    weather roles (used to play a source that grows between runs).
    """
    r = raw_roles(t, trips)
    with scratch_scope(r.spark):
        _run(r, root, run_ts, fact_mode, date_start, date_end, raw_filter)
    return read_stored(r.spark, root)


def _run(r, root, run_ts, fact_mode, date_start, date_end, raw_filter) -> None:
    spark = r.spark
    build = Build(spark, root)
    marks = build.stored("last_execution_times") or empty_watermarks(spark)
    require_newer(marks, run_ts)
    if date_start is None or date_end is None:
        date_start, date_end = r.date_range() or (STAR_DATE_START, STAR_DATE_END)
    raw_trips = r.trips()
    raw_weather = r.weather()
    if raw_filter is not None:
        raw_trips, raw_weather = raw_filter(raw_trips, raw_weather)
    build.number                                         # claimed once, before the threads below

    def unchanged(df, prev):
        """Type-2 tables refuse a schema change."""
        return df if prev is None else sync_schema(prev, df, "fail")[1]

    # Stage A, side by side: ODS lookups (full refresh) and the date dimension.
    b, v, rc, pt, dates = parallel(
        lambda: build.save(ods.ods_borough(r.borough(), run_ts), "ods_borough"),
        lambda: build.save(ods.ods_vendor(r.vendor(), run_ts), "ods_vendor"),
        lambda: build.save(ods.ods_ratecode(r.ratecode(), run_ts), "ods_ratecode"),
        lambda: build.save(ods.ods_payment_type(r.payment_type(), run_ts), "ods_payment_type"),
        lambda: build.save(mart.dm_date(spark, date_start, date_end), "dm_date"))

    # Stage B, three independent chains side by side.
    def zones_and_trips():
        n = build.save(ods.ods_neighborhood(r.neighborhood(), b, run_ts), "ods_neighborhood")
        # ODS trips: incremental with a one-day lookback, upsert on id_trip by month.
        valid = ods.valid_trips(raw_trips, r.min_pickup)
        if build.months("ods_taxi_trip"):
            # the newest pickup lies in the newest month: read that partition only
            newest = build.stored("ods_taxi_trip", build.months("ods_taxi_trip")[-1:])
            valid = after_event_mark(valid, "tpep_pickup_datetime", high_water(newest, "pickup_datetime"), lookback="1 day")
        rows = ods.transform_trips(valid, n, run_ts).withColumn(MONTH, mart.trip_month())
        touched = upsert_months(build, "ods_taxi_trip", rows, "id_trip", policy="merge")
        prev_z = build.stored("dm_zone")
        dz = build.save(unchanged(mart.dm_zone(b, n, target=prev_z, marks=marks, stored=True), prev_z), "dm_zone")
        return n, touched, dz

    def weather():
        # ODS weather: strict event-time mark, so new readings touch the newest months only.
        raw, newest = raw_weather, build.months("ods_weather_dt")[-1:]
        target = build.stored("ods_weather_dt", newest) if newest else None
        if target is not None:
            mark = high_water(target, "weather_datetime")
            raw = after_event_mark(raw, "time", mark, strict=True)
        rows = ods.ods_weather_dt(raw, b, run_ts).withColumn(WEATHER_MONTH, weather_month())
        touched = upsert_months(build, "ods_weather_dt", rows, "id_weather", WEATHER_MONTH, policy="sync_all_columns")
        src = build.current("ods_weather_dt", touched).drop(WEATHER_MONTH)
        target = build.stored("dm_weather_dt", touched)
        if target is None:
            dim = mart.dm_weather_dt(src, b)
        else:
            src = after_process_mark(src, "last_update", read_mark(marks, "dm_weather_dt"))
            dim = mart.dm_weather_dt(src, b, target=target.drop(WEATHER_MONTH), last_key=build.properties.get(LAST_KEY + "dm_weather_dt", 0))
        build.save_months(dim.withColumn(WEATHER_MONTH, weather_month()), "dm_weather_dt", WEATHER_MONTH)
        newest = high_water(build.current("dm_weather_dt", touched), "key_weather")
        last = build.properties.get(LAST_KEY + "dm_weather_dt", 0)
        build.properties[LAST_KEY + "dm_weather_dt"] = max(last, newest or 0)
        return touched, build.current("dm_weather_dt").drop(WEATHER_MONTH)

    def vendors():
        prev_v = build.stored("dm_vendor")
        return build.save(unchanged(mart.dm_vendor(v, target=prev_v, marks=marks, stored=True), prev_v), "dm_vendor")

    (n, trip_months, dz), (weather_months, dw), dv = parallel(zones_and_trips, weather, vendors)

    # The fact: trips stamped after the fact's mark (they lie in the months just written), by month.
    trip_src = build.current("ods_taxi_trip", trip_months)
    if build.stored("dm_fact_taxi_trip") is not None:
        trip_src = after_process_mark(trip_src, "last_update", read_mark(marks, "dm_fact_taxi_trip"))
    start = build.properties.get(LAST_KEY + "dm_fact_taxi_trip", 0)
    n_dates = mart.date_rows_between(date_start, date_end)
    fact = mart.dm_fact_taxi_trip(trip_src, dv, dz, dates, dw, pt, rc, start=start, date_rows=n_dates, month=True)
    if fact_mode == "append" and build.stored("dm_fact_taxi_trip") is not None:
        old = build.stored("dm_fact_taxi_trip")
        fact = materialize(unchanged(fact.select(*old.columns), old), "append")
        months = [row[0] for row in fact.select(MONTH).distinct().collect()]
        build.save_months(build.stored("dm_fact_taxi_trip", months).unionByName(fact), "dm_fact_taxi_trip", MONTH)
    else:
        upsert_months(build, "dm_fact_taxi_trip", fact, "id_trip")
    # Every trip became one fact row.
    build.properties[LAST_KEY + "dm_fact_taxi_trip"] = start + trip_src.count()

    # Watermarks: the newest load time each datamart table actually read.
    new_marks = marks
    for name, src in (("dm_vendor", v), ("dm_zone", n), ("dm_weather_dt", build.current("ods_weather_dt", weather_months)),
                      ("dm_fact_taxi_trip", trip_src)):
        m = high_water(src, "last_update")
        if m is not None:
            new_marks = set_mark(new_marks, name, m)
    build.save(new_marks, "last_execution_times")
    counts = build.stored("quality_months")
    for name, key, by, months in (("ods_taxi_trip", "id_trip", MONTH, trip_months),
                                  ("ods_weather_dt", "id_weather", WEATHER_MONTH, weather_months)):
        counts = replace_months(counts, monthly_counts(build.current(name, months), name, key, by), name, months)
    counts = build.save(counts, "quality_months")
    small = {"ods_borough": b, "ods_neighborhood": n, "ods_ratecode": rc, "ods_payment_type": pt, "ods_vendor": v}
    checks = check_models(small, {name: ODS_KEYS[name] for name in small})
    build.save(checks.unionByName(summary_of_months(counts)), "quality_summary")
    build.publish()


def read_stored(spark, root: str) -> Star:
    """The tables of the newest snapshot under ``root``."""
    cur = Build(spark, root).stored
    return Star(cur("ods_borough"), cur("ods_neighborhood"), cur("ods_vendor"), cur("ods_ratecode"),
                cur("ods_payment_type"), cur("ods_taxi_trip").drop(MONTH), cur("ods_weather_dt").drop(WEATHER_MONTH),
                cur("dm_date"), cur("dm_vendor"), cur("dm_zone"), cur("dm_weather_dt").drop(WEATHER_MONTH),
                cur("dm_fact_taxi_trip").drop(MONTH))
