"""Micro-batch trip loads give the same ODS table as the batch upsert."""

import datetime as dt
import os

from pyspark.sql import functions as F

from cabmart.functions import ntz_lit
from cabmart.plans import ods
from cabmart.plans.star import stored_lookups
from cabmart.sources import Tables, standins as S
from cabmart.sources import tables as T
from cabmart.streaming import stream_trips
from conftest import SF_SMALL

CUT = dt.datetime(2024, 1, 20)


def test_stream_two_arrivals(spark, tmpdir_path):
    t = Tables(spark, SF_SMALL)
    _, zones, _, _, _ = stored_lookups(t)
    raw = S.raw_trip_events(t)
    src = os.path.join(tmpdir_path, "incoming")
    trip_root = os.path.join(tmpdir_path, "ods_taxi_trip")
    run_ts = dt.datetime(2024, 6, 1)
    raw.filter(F.col("tpep_pickup_datetime") < ntz_lit(CUT)).write.parquet(os.path.join(src, "a"))
    stream_trips(spark, os.path.join(src, "*"), zones, trip_root, run_ts, checkpoint=os.path.join(tmpdir_path, "progress"))
    first = T.read_partitioned(spark, trip_root).count()
    raw.filter(F.col("tpep_pickup_datetime") >= ntz_lit(CUT)).write.parquet(os.path.join(src, "b"))
    stream_trips(spark, os.path.join(src, "*"), zones, trip_root, run_ts, checkpoint=os.path.join(tmpdir_path, "progress"))
    got = T.read_partitioned(spark, trip_root).drop("pickup_month")
    want = ods.ods_taxi_trip(raw, zones, run_ts)
    assert first < got.count()
    assert sorted(got.collect()) == sorted(want.select(*got.columns).collect())


def test_stream_weather_files(spark, tmpdir_path):
    from test_file_layout import make_layout
    from cabmart.sources.raw import FileRoles
    from cabmart.streaming import stream_weather
    raw_root = os.path.join(tmpdir_path, "data")
    make_layout(spark, raw_root)
    roles = FileRoles(spark, raw_root)
    b = ods.ods_borough(roles.borough(), dt.datetime(2024, 6, 1))
    header = ["time", "temperature_2m (°C)", "relative_humidity_2m (%)", "apparent_temperature (°C)",
              "rain (mm)", "snowfall (cm)", "wind_speed_10m (km/h)"]
    root = os.path.join(tmpdir_path, "ods_weather_dt")
    stream_weather(spark, os.path.join(raw_root, "weather_dt", "Weather_*", "*.csv"), b, root,
                   dt.datetime(2024, 6, 1), header, checkpoint=os.path.join(tmpdir_path, "progress"))
    got = T.read_current(spark, root)
    want = ods.ods_weather_dt(roles.weather(), b, dt.datetime(2024, 6, 1))
    assert got.count() == want.count() == 3 * 24 * 30
    assert sorted(got.collect()) == sorted(want.select(*got.columns).collect())


def test_stream_takes_late_files_in_small_batches_and_goes_on_after_a_restart(spark, tmpdir_path):
    t = Tables(spark, SF_SMALL)
    _, zones, _, _, _ = stored_lookups(t)
    raw = S.raw_trip_events(t)
    src, progress = os.path.join(tmpdir_path, "incoming"), os.path.join(tmpdir_path, "progress")
    trip_root = os.path.join(tmpdir_path, "ods_taxi_trip")
    run_ts = dt.datetime(2024, 6, 1)
    raw.filter(F.col("tpep_pickup_datetime") >= ntz_lit(CUT)).coalesce(1).write.parquet(os.path.join(src, "new"))
    load = lambda: stream_trips(spark, os.path.join(src, "*"), zones, trip_root, run_ts, progress,
                                max_files_per_trigger=1)
    load()
    raw.filter(F.col("tpep_pickup_datetime") < ntz_lit(CUT)).coalesce(1).write.parquet(os.path.join(src, "old"))
    load()                                               # another stream over the same progress: old file only
    got = T.read_partitioned(spark, trip_root).drop("pickup_month")
    want = ods.ods_taxi_trip(raw, zones, run_ts)
    assert sorted(got.collect()) == sorted(want.select(*got.columns).collect())


def test_stream_weather_boroughs_one_after_another(spark, tmpdir_path):
    from test_file_layout import make_layout
    from cabmart.sources.raw import FileRoles
    from cabmart.streaming import load_weather_batch
    raw_root = os.path.join(tmpdir_path, "data")
    make_layout(spark, raw_root)
    roles = FileRoles(spark, raw_root)
    ts = dt.datetime(2024, 6, 1)
    b = ods.ods_borough(roles.borough(), ts)
    root = os.path.join(tmpdir_path, "ods_weather_dt")
    for name in ("Bronx", "Queens", "Staten Island"):    # the same hours each
        load_weather_batch(roles.weather().filter(F.col("borough_name") == name), b, root, ts)
    assert T.read_current(spark, root).count() == 3 * 24 * 30
