"""Models on hand-made edge rows (FIXTURES.md section 4)."""

import datetime as dt

from pyspark.sql import functions as F

from cabmart.functions import unknown_hash, hash_key
from cabmart.plans import ods, mart, reports

TS = dt.datetime(2024, 6, 1)


def test_borough_default_member_and_unmatched_zone(spark):
    raw = spark.createDataFrame([(" Manhattan ",), ("manhattan",), ("Unknown",), ("Staten  Island",),
                                 ("",), (None,)], "boroughname string")
    b = ods.ods_borough(raw, TS)
    names = sorted(r.borough_name for r in b.collect())
    assert names == ["manhattan", "staten island", "unknown"]          # one default member
    zones = spark.createDataFrame([(1, "Manhattan", "A", "Yellow Zone"), (264, "Unknown", "NV", "N/A"),
                                   (265, "N/A", "Outside", "N/A"), (1, "Manhattan", "B", "Boro Zone")],
                                  "LocationID int, Borough string, Zone string, service_zone string")
    n = {r.id_neighborhood: r for r in ods.ods_neighborhood(zones, b, TS).collect()}
    unk = spark.range(1).select(unknown_hash()).first()[0]
    assert n[1].neighborhood_name == "A" and n[1].service_zone == "Yellow Zone"   # first by name
    assert n[264].borough_fk == unk and n[265].borough_fk == unk


def test_vendor_lookup_min_and_blank(spark):
    raw = spark.createDataFrame([(2, " Curb  Mobility, LLC "), (2, "Alpha"), (7, "  "), (None, "x")],
                                "id int, vendor string")
    rows = sorted((r.id_vendor, r.vendor_name) for r in ods.ods_vendor(raw, TS).collect())
    assert rows == [(2, "Alpha")]


def _trip(vendor, pu, do, start, minutes, rate=1.0, pay=1, fare=10.0, tip=1.0):
    return (vendor, start, start + dt.timedelta(minutes=minutes), 1.0, 2.0, rate, "N", pu, do, pay,
            fare, 0.5, 0.5, tip, 0.0, 0.3, 2.5, 0.0, fare + tip)


TRIP_DDL = ("VendorID int, tpep_pickup_datetime timestamp_ntz, tpep_dropoff_datetime timestamp_ntz, "
            "passenger_count double, trip_distance double, RatecodeID double, store_and_fwd_flag string, "
            "PULocationID int, DOLocationID int, payment_type bigint, fare_amount double, extra double, "
            "mta_tax double, tip_amount double, tolls_amount double, improvement_surcharge double, "
            "congestion_surcharge double, airport_fee double, total_amount double")


def test_fact_unknown_members_and_weather_hour(spark):
    b = ods.ods_borough(spark.createDataFrame([("Bronx",), ("Queens",)], "boroughname string"), TS)
    zones_raw = spark.createDataFrame([(1, "Bronx", "Z1", "Boro Zone"), (2, "Queens", "Z2", "Boro Zone")],
                                      "LocationID int, Borough string, Zone string, service_zone string")
    n = ods.ods_neighborhood(zones_raw, b, TS)
    t0 = dt.datetime(2024, 1, 5, 8, 15)
    trips = spark.createDataFrame([
        _trip(1, 1, 2, t0, 30),                      # all known, weather at 08:00 in the bronx
        _trip(9, 99, 1, t0, 30, rate=42.0, pay=42),  # unknown vendor, zone, rate code, payment
        _trip(1, 2, 2, dt.datetime(2023, 12, 31, 23, 0), 90, fare=0.0),  # date before the range
    ], TRIP_DDL)
    trip = ods.ods_taxi_trip(trips, n, TS)
    vendors = mart.dm_vendor(spark.createDataFrame([(1, "V", TS)], "id_vendor int, vendor_name string, last_update timestamp_ntz"))
    dz = mart.dm_zone(b, n)
    dates = mart.dm_date(spark, "2024-01-01", "2024-12-31")
    wx_raw = spark.createDataFrame([("Bronx", dt.datetime(2024, 1, 5, 8), 5.0, 60.0, 3.0, 1.0, 0.0, 10.0)],
                                   "borough_name string, time timestamp_ntz, `temperature_2m (°C)` double, "
                                   "`relative_humidity_2m (%)` double, `apparent_temperature (°C)` double, "
                                   "`rain (mm)` double, `snowfall (cm)` double, `wind_speed_10m (km/h)` double")
    dw = mart.dm_weather_dt(ods.ods_weather_dt(wx_raw, b, TS), b)
    pays = ods.ods_payment_type(spark.createDataFrame([(1, "Credit Card")], "id int, type string"), TS)
    rates = ods.ods_ratecode(spark.createDataFrame([(1, "Standard rate")], "id int, ratecode string"), TS)
    rows = mart.dm_fact_taxi_trip(trip, vendors, dz, dates, dw, pays, rates).collect()
    assert sorted(r.key_taxi_trip for r in rows) == [1, 2, 3]
    known = [r for r in rows if r.key_vendor == 1 and r.key_date_pickup == 20240105][0]
    assert known.key_weather == 1 and known.payment_type == "credit card"
    assert known.ratecode_name == "Standard rate" and known.is_cross_borough is True
    assert str(known.trip_duration_minutes) == "30.00" and str(known.tip_percentage) == "10.00"
    assert known.time_of_day_category == "Morning Rush" and known.pickup_time == "08:15:00"
    unk = [r for r in rows if r.key_vendor == -1][0]
    assert (unk.key_zone_pickup, unk.key_weather, unk.payment_type, unk.ratecode_name) == (-1, -1, "Unknown", "Unknown")
    assert unk.is_cross_borough is False                       # NULL borough compares as not crossing
    early = [r for r in rows if r.key_date_pickup == -1][0]
    assert early.key_date_dropoff == 20240101 and str(early.tip_percentage) == "0.00"
    assert early.time_of_day_category == "Night"


def test_rates_null_category_and_best_day_ties(spark):
    weather = spark.createDataFrame([(1, "No Rain"), (2, "No Rain"), (3, None), (4, "Light Rain")],
                                    "key_weather long, rain_intensity string")
    fact = spark.createDataFrame([(1,), (1,), (2,), (3,), (-1,)], "key_weather long")
    r = {x.rain_intensity: x for x in reports.trips_per_weather_record(fact, weather, "rain_intensity").collect()}
    assert set(r) == {"No Rain"} and str(r["No Rain"].trips_per_weather) == "1.50"   # NULL never joins
    dates = mart.dm_date(spark, "2025-01-01", "2025-01-31")
    f = spark.createDataFrame([(20250102, 10.0), (20250103, 4.0), (20250103, 6.0), (20250104, 1.0)],
                              "key_date_pickup int, total_amount double")
    best = sorted(str(x.date) for x in reports.best_revenue_day(f, dates, 2025, "january").collect())
    assert best == ["2025-01-02", "2025-01-03"]
