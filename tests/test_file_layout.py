"""The warehouse on the original raw file layout (CSV lookups, trip parquet, weather folders)."""

import datetime as dt
import os

from pyspark.sql import functions as F

from cabmart.plans import warehouse, reports, ods
from cabmart.sources import Tables, standins as S
from cabmart.sources.raw import FileRoles
from conftest import SF_SMALL


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def make_layout(spark, root):
    _write(f"{root}/zones/borough.csv", "boroughname\nManhattan\nBrooklyn\nQueens\nBronx\nStaten Island\nEWR\n")
    _write(f"{root}/zones/taxi_zone_lookup.csv",
           '"LocationID","Borough","Zone","service_zone"\n'
           '1,"EWR","Runway North","EWR"\n2,"Queens","Salt Marsh","Boro Zone"\n'
           '3,"Bronx","Rose/Elm Gardens","Boro Zone"\n4,"Manhattan","Letter Row","Yellow Zone"\n'
           '5,"Staten Island","Fern Heights","Boro Zone"\n6,"Brooklyn","Pier Ridge","Boro Zone"\n'
           '264,"Unknown","N/A","N/A"\n265,"N/A","Elsewhere","N/A"\n')
    _write(f"{root}/taxi_trip/vendor_id.csv",
           'id,vendor\n1, "Yellow Wheels, Ltd"\n2, "Kerb Riders, Ltd"\n6, "Mile Works"\n7, "Spiral"\n')
    _write(f"{root}/taxi_trip/ratecode_id.csv",
           'id,ratecode\n1, "Plain rate"\n2, "Airport east"\n3, "Airport west"\n99, "Not known"\n')
    _write(f"{root}/taxi_trip/payment_type.csv",
           'id,type\n0, "app fare"\n1, "by card"\n2, "in coins"\n5, "not known"\n')
    # trip records in the original column names, from the driver's events
    trips = S.raw_trip_events(Tables(spark, SF_SMALL))
    trips = trips.select(
        F.col("VendorID").cast("long").alias("VendorID"), "tpep_pickup_datetime", "tpep_dropoff_datetime",
        "passenger_count", "trip_distance", "RatecodeID", "store_and_fwd_flag",
        ((F.col("PULocationID") % 8) + 1).cast("long").alias("PULocationID"),
        ((F.col("DOLocationID") % 8) + 1).cast("long").alias("DOLocationID"),
        (F.col("payment_type") % 3).alias("payment_type"), "fare_amount", "extra", "mta_tax", "tip_amount",
        "tolls_amount", "improvement_surcharge", "congestion_surcharge",
        F.col("airport_fee").alias("Airport_fee"), "total_amount")
    trips.coalesce(2).write.parquet(f"{root}/taxi_trip/trips.parquet")   # matched by *.parquet
    # hourly weather per borough folder: 3 preamble lines, header, data
    folders = {"Bronx": "Weather_Bronx", "Queens": "Weather_Queens", "Staten Island": "Weather_StatenIsland"}
    for b, folder in folders.items():
        rows = []
        for h in range(0, 24 * 30):
            t = dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
            temp = (h % 40) - 10
            rows.append(f"{t:%Y-%m-%dT%H:%M},{temp},{50 + h % 50},{temp - 2},{(h % 7) * 0.8},{(h % 11) * 0.1},{h % 70}")
        _write(f"{root}/weather_dt/{folder}/open-meteo.csv",
               "latitude,longitude,elevation\n40.8,-73.9,20.0\n\n"
               "time,temperature_2m (°C),relative_humidity_2m (%),apparent_temperature (°C),rain (mm),"
               "snowfall (cm),wind_speed_10m (km/h)\n" + "\n".join(rows) + "\n")


def test_warehouse_on_file_layout(spark, tmpdir_path):
    raw_root = os.path.join(tmpdir_path, "data")
    make_layout(spark, raw_root)
    roles = FileRoles(spark, raw_root)
    v = {r.id: r.vendor for r in roles.vendor().collect()}
    assert v[2] == "Kerb Riders, Ltd"
    w = roles.weather()
    assert sorted(r.borough_name for r in w.select("borough_name").distinct().collect()) == [
        "Bronx", "Queens", "Staten Island"]
    assert w.count() == 3 * 24 * 30
    star = warehouse.run_warehouse(roles, os.path.join(tmpdir_path, "wh"), dt.datetime(2024, 6, 1),
                                   date_start="2024-01-01", date_end="2024-12-31")
    valid = ods.valid_trips(roles.trips()).count()
    assert star.fact.count() == valid
    assert star.dm_zone.filter("is_current").count() == 8
    matched = star.fact.filter("key_weather <> -1").count()
    assert 0 < matched < valid                      # trips from boroughs with weather get a key
    rate = reports.trips_per_weather_record(star.fact, star.dm_weather, "rain_intensity",
                                            zones=star.dm_zone).collect()
    assert {r.borough for r in rate} <= {"bronx", "queens", "staten island"}
    top = reports.trips_by_zone(star.fact, star.dm_zone).collect()
    assert sum(r.total_trips for r in top) == star.fact.filter("key_zone_dropoff <> -1").count()


def test_command_line(spark, tmpdir_path):
    from cabmart.__main__ import main
    raw_root = os.path.join(tmpdir_path, "data")
    make_layout(spark, raw_root)
    wh = os.path.join(tmpdir_path, "wh")
    assert main(["build", "--raw", raw_root, "--out", wh, "--run-ts", "2024-06-01T00:00:00"]) == 0
    dest = os.path.join(tmpdir_path, "out")
    assert main(["report", "rate", "--out", wh, "--param", "category=wind_intensity",
                 "--param", "by_borough=true", "--dest", dest]) == 0
    assert spark.read.parquet(dest).count() > 0
    assert main(["report", "month_calendar", "--out", wh, "--dest", dest + "2"]) == 0
    assert spark.read.parquet(dest + "2").count() == 1       # January 2024


def test_report_sql_on_registered_catalog(spark, tmpdir_path):
    from cabmart.sources.catalog import register_catalog
    raw_root = os.path.join(tmpdir_path, "data")
    make_layout(spark, raw_root)
    wh = os.path.join(tmpdir_path, "wh")
    star = warehouse.run_warehouse(FileRoles(spark, raw_root), wh, dt.datetime(2024, 6, 1),
                                   date_start="2024-01-01", date_end="2024-12-31")
    made = register_catalog(spark, wh, raw_roles=FileRoles(spark, raw_root))
    assert "dwh_datamart.dm_fact_taxi_trip" in made and "raw_weather" in made
    got = spark.sql("""
        WITH quarter AS (SELECT key_date FROM dwh_datamart.dm_date WHERE key_date BETWEEN 20240101 AND 20240331),
             per_zone AS (SELECT key_zone_pickup AS key_zone, count(*) AS n FROM dwh_datamart.dm_fact_taxi_trip
                          WHERE key_date_pickup IN (SELECT key_date FROM quarter) GROUP BY key_zone_pickup)
        SELECT borough_name, sum(n) AS n FROM per_zone NATURAL JOIN dwh_datamart.dm_zone GROUP BY borough_name""").collect()
    want = reports.weather_multidim(star.fact, star.dm_zone, star.dm_date).groupBy("pickup_borough") \
        .sum("total_trips").collect()
    assert sorted((r.borough_name.lower(), r.n) for r in got) == sorted(tuple(r) for r in want)


def test_weather_files_are_written_by_many_tasks(spark, tmpdir_path):
    from cabmart.plans import catalog
    given = Tables(spark, SF_SMALL)
    given("events").repartition(6).write.parquet(f"{tmpdir_path}/events.parquet")
    given("region").write.parquet(f"{tmpdir_path}/region.parquet")
    size = "spark.sql.files.openCostInBytes"
    spark.conf.set(size, "1g")                            # one file is one partition
    try:
        root = catalog._weather_files(spark, tmpdir_path)
    finally:
        spark.conf.unset(size)
    text = spark.read.text(f"{root}/weather_dt/*/hourly.csv").select("value", F.col("_metadata.file_path").alias("path"))
    by_file = text.groupBy("path").agg(F.sum(F.col("value").startswith("time,").cast("int")).alias("heads")).collect()
    assert len(by_file) == 6 * len(catalog.REGIONS) and all(r.heads == 1 for r in by_file)
    got = FileRoles(spark, root).weather()
    want = S.raw_weather(given).select(got.columns)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
