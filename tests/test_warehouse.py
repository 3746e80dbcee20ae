"""Stored warehouse: two runs over a growing source, replay, fact load modes."""

import datetime as dt
import os

from pyspark.sql import functions as F

import pytest

from cabmart.functions import ntz_lit
from cabmart.operators import monthly_counts, quality_summary
from cabmart.plans import warehouse, reports, ods
from cabmart.sources import standins as S
from cabmart.sources import tables as T
from cabmart.sources import Tables
from cabmart.sources.snapshots import Build, ConcurrentRunError, Snapshots
from conftest import SF_SMALL

CUT = dt.datetime(2024, 1, 20)


def _first_part(trips, weather):
    return (trips.filter(F.col("tpep_pickup_datetime") < ntz_lit(CUT)),
            weather.filter(F.col("time") < ntz_lit(CUT)))


def test_two_runs_then_replay(spark, tmpdir_path):
    t = Tables(spark, SF_SMALL)
    root = os.path.join(tmpdir_path, "wh")
    s1 = warehouse.run_warehouse(t, root, dt.datetime(2024, 6, 1), trips="events",
                                 raw_filter=_first_part)
    n1 = s1.fact.count()
    s2 = warehouse.run_warehouse(t, root, dt.datetime(2024, 7, 1), trips="events")
    fact2 = s2.fact
    ids = fact2.select("id_trip").distinct().count()
    # every valid trip is in the fact once per raw row; nothing lost between the runs
    full = ods.valid_trips(S.raw_trip_events(t)).count()
    assert fact2.count() == full and n1 < full
    keys = [r[0] for r in fact2.select("key_taxi_trip").collect()]
    assert len(set(keys)) == len(keys)
    assert ids <= full
    # replay of the same source: same content (keys may be renumbered for re-read rows)
    cols = [c for c in fact2.columns if c != "key_taxi_trip"]
    before = sorted(fact2.select(cols).collect())   # files of run 2 are replaced by run 3
    s3 = warehouse.run_warehouse(t, root, dt.datetime(2024, 8, 1), trips="events")
    assert sorted(s3.fact.select(cols).collect()) == before
    marks = {r.target_table: r.time for r in
             spark.read.parquet(os.path.join(root, "last_execution_times", "v=2")).collect()}
    assert marks["dm_fact_taxi_trip"] == dt.datetime(2024, 8, 1)
    # dimension versions: unchanged sources give no new versions
    assert s3.dm_zone.count() == s3.dm_zone.filter("is_current").count()
    r = reports.trips_by_zone(s3.fact, s3.dm_zone).collect()
    assert sum(x.total_trips for x in r) <= s3.fact.count()


def test_append_mode(spark, tmpdir_path):
    t = Tables(spark, SF_SMALL)
    root = os.path.join(tmpdir_path, "wh")
    warehouse.run_warehouse(t, root, dt.datetime(2024, 6, 1), trips="events", fact_mode="append",
                            raw_filter=_first_part)
    s2 = warehouse.run_warehouse(t, root, dt.datetime(2024, 7, 1), trips="events",
                                 fact_mode="append")
    # the lookback re-reads a day of trips and append keeps both copies
    full = ods.valid_trips(S.raw_trip_events(t)).count()
    assert s2.fact.count() >= full


def test_same_load_time_is_refused_and_moved_dates_keep_the_fact(spark, tmpdir_path):
    t = Tables(spark, SF_SMALL)
    root = os.path.join(tmpdir_path, "wh")
    first = warehouse.run_warehouse(t, root, dt.datetime(2024, 6, 1), trips="events", raw_filter=_first_part,
                                    date_start="2024-01-31", date_end="2050-12-31")
    n1 = first.fact.count()
    with pytest.raises(ValueError, match="not later"):
        warehouse.run_warehouse(t, root, dt.datetime(2024, 6, 1), trips="events")
    assert warehouse.read_stored(spark, root).fact.count() == n1
    s = warehouse.run_warehouse(t, root, dt.datetime(2024, 7, 1), trips="events", date_start="2024-01-01",
                                date_end="2050-12-31")
    trips = ods.valid_trips(S.raw_trip_events(t)).count()
    assert s.ods_trip.count() == s.fact.count() == trips
    keys = [r[0] for r in s.fact.select("key_taxi_trip").collect()]
    assert len(set(keys)) == len(keys)
    checks = spark.read.parquet(os.path.join(root, "quality_summary", "v=1")).collect()
    assert len(checks) == 7 and all(c.passed for c in checks if c.table_name != "ods_taxi_trip")


def test_a_run_leaves_no_scratch(spark, tmpdir_path):
    from cabmart.session import ensure_checkpoint_dir
    folder = os.path.join(ensure_checkpoint_dir(spark).removeprefix("file:"), "cabmart")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    warehouse.run_warehouse(Tables(spark, SF_SMALL), os.path.join(tmpdir_path, "wh"), dt.datetime(2024, 6, 1), trips="events")
    assert set(os.listdir(folder)) <= before


def test_weather_keys_survive_a_re_read(spark):
    from cabmart.plans import mart
    t = Tables(spark, SF_SMALL)
    b = ods.ods_borough(S.raw_borough(t), dt.datetime(2024, 6, 1))
    w1 = ods.ods_weather_dt(S.raw_weather(t).filter(F.col("time") < ntz_lit(CUT)), b, dt.datetime(2024, 6, 1))
    first = mart.dm_weather_dt(w1, b)
    old = {r.id_weather: r.key_weather for r in first.collect()}
    w2 = ods.ods_weather_dt(S.raw_weather(t), b, dt.datetime(2024, 7, 1))
    new = {r.id_weather: r.key_weather for r in mart.dm_weather_dt(w2, b, target=first).collect()}
    assert len(new) > len(old) and all(new[i] == k for i, k in old.items()) and len(set(new.values())) == len(new)


def _build(spark, root, ts, **kw):
    return warehouse.run_warehouse(Tables(spark, SF_SMALL), root, ts, trips="events", **kw)


def test_frames_read_before_a_run_stay_valid_and_a_broken_run_changes_nothing(spark, tmpdir_path, monkeypatch):
    root = os.path.join(tmpdir_path, "wh")
    s1 = _build(spark, root, dt.datetime(2024, 6, 1), raw_filter=_first_part)
    n, trips = s1.fact.count(), sorted(s1.ods_trip.collect())
    monkeypatch.setattr(warehouse, "summary_of_months", lambda counts: 1 / 0)      # breaks off after all tables are written
    with pytest.raises(ZeroDivisionError):
        _build(spark, root, dt.datetime(2024, 7, 1))
    assert warehouse.read_stored(spark, root).fact.count() == n
    monkeypatch.undo()
    s2 = _build(spark, root, dt.datetime(2024, 7, 1))
    assert s2.fact.count() > n and s1.fact.count() == n and sorted(s1.ods_trip.collect()) == trips
    keys = [r[0] for r in s2.fact.select("key_taxi_trip").collect()]
    assert len(set(keys)) == len(keys)
    # folders of the broken run are named by no snapshot
    gone = Snapshots(spark, root).vacuum(keep=1)
    assert gone and warehouse.read_stored(spark, root).fact.count() == len(keys)


def test_of_two_runs_from_one_snapshot_one_wins(spark, tmpdir_path, monkeypatch):
    root = os.path.join(tmpdir_path, "wh")
    _build(spark, root, dt.datetime(2024, 6, 1), raw_filter=_first_part)
    publish, other = warehouse.Build.publish, []

    def late(self):
        if not other:
            other.append(1)
            _build(spark, root, dt.datetime(2024, 7, 1))                           # another run ends in between
        return publish(self)

    monkeypatch.setattr(warehouse.Build, "publish", late)
    with pytest.raises(ConcurrentRunError):
        _build(spark, root, dt.datetime(2024, 8, 1))
    assert Snapshots(spark, root).numbers() == [0, 1]
    s = warehouse.read_stored(spark, root)
    assert {r[0] for r in s.ods_vendor.select("last_update").distinct().collect()} == {dt.datetime(2024, 7, 1)}
    assert s.fact.count() == ods.valid_trips(S.raw_trip_events(Tables(spark, SF_SMALL))).count()


def test_a_snapshot_that_was_not_finished_is_passed_over(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "t")
    T.write_version(spark.range(3).toDF("a"), root)
    with open(os.path.join(root, "_snapshots", "s=1.json"), "w") as f:
        f.write('{"tables": {"": ')
    assert T.read_current(spark, root).count() == 3
    T.write_version(spark.range(5).toDF("a"), root)
    assert T.read_current(spark, root).count() == 5 and T.versions(spark, root) == [0, 1, 2]
    held = Build(spark, root)
    T.write_version(spark.range(7).toDF("a"), root)
    with pytest.raises(ConcurrentRunError):
        T.write_version(spark.range(9).toDF("a"), root, build=held)
    assert T.read_current(spark, root).count() == 7


def test_a_second_run_touches_its_months_only(spark, tmpdir_path, monkeypatch):
    """Trips, weather, fact and the key checks: months without new rows are neither read nor written."""
    root = os.path.join(tmpdir_path, "wh")
    counted = []

    def spy(df, table, col, month):
        counted.append((table, {int(f.split(f"{month}=")[1].split("/")[0]) for f in df.inputFiles()}))
        return monthly_counts(df, table, col, month)

    monkeypatch.setattr(warehouse, "monthly_counts", spy)
    cut = dt.datetime(2024, 3, 10)

    def spread(trips, weather):                          # the events' month, dealt over three
        far = F.make_interval(months=F.day("tpep_pickup_datetime") % 3)
        return (trips.withColumns({c: F.col(c) + far for c in ("tpep_dropoff_datetime", "tpep_pickup_datetime")}),
                weather.withColumn("time", F.col("time") + F.make_interval(months=F.day("time") % 3)))

    def early(trips, weather):
        trips, weather = spread(trips, weather)
        return trips.filter(F.col("tpep_pickup_datetime") < ntz_lit(cut)), weather.filter(F.col("time") < ntz_lit(cut))

    _build(spark, root, dt.datetime(2024, 6, 1), raw_filter=early)
    before = Snapshots(spark, root).latest()[1]["tables"]
    counted.clear()
    s = _build(spark, root, dt.datetime(2024, 7, 1), raw_filter=spread)
    after = Snapshots(spark, root).latest()[1]["tables"]
    for name in ("ods_taxi_trip", "dm_fact_taxi_trip", "ods_weather_dt", "dm_weather_dt"):
        old = {m for m in before[name]["months"] if int(m) < 202403}
        assert old and all(after[name]["months"][m] == before[name]["months"][m] for m in old), name
        assert after[name]["months"]["202403"] == 1, name
    assert {t for t, _ in counted} == {"ods_taxi_trip", "ods_weather_dt"} and all(min(months) == 202403 for _, months in counted)
    got = {r.table_name: tuple(r)[2:] for r in Build(spark, root).stored("quality_summary").collect()}
    for name, df, col in (("ods_taxi_trip", s.ods_trip, "id_trip"), ("ods_weather_dt", s.ods_weather, "id_weather")):
        assert got[name] == tuple(quality_summary(df, name, [col]).first())[2:]
    keys = [r[0] for r in s.dm_weather.select("key_weather").collect()]
    assert len(keys) == len(set(keys)) == s.ods_weather.count()


def test_a_large_month_is_written_by_many_tasks(spark, tmpdir_path):
    build = Build(spark, os.path.join(tmpdir_path, "t"))
    df = spark.range(200_000).select(F.when(F.col("id") % 10 < 9, 202401).otherwise(202402).alias("m"), F.sha2(F.col("id").cast("string"), 256).alias("x"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        assert build.save_months(df, "", "m") == [202401, 202402]
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = build.current("").filter("m = 202401").inputFiles()
    assert len([f for f in files if "m=202401" in f]) >= 4 and build.current("").count() == 200_000
