"""Declared source catalogue (S9): explicit schemas of the raw roles and layer tables."""

from __future__ import annotations

from pyspark.sql.types import StructType

RAW = {
    "borough": "boroughname string",
    "neighborhood": "LocationID int, Borough string, Zone string, service_zone string",
    "vendor_id": "id int, vendor string",
    "ratecode_id": "id int, ratecode string",
    "payment_type": "id int, type string",
    "taxi_trip": (
        "VendorID int, tpep_pickup_datetime timestamp_ntz, tpep_dropoff_datetime timestamp_ntz, "
        "passenger_count double, trip_distance double, RatecodeID double, "
        "store_and_fwd_flag string, PULocationID int, DOLocationID int, payment_type bigint, "
        "fare_amount double, extra double, mta_tax double, tip_amount double, "
        "tolls_amount double, improvement_surcharge double, congestion_surcharge double, "
        "airport_fee double, total_amount double"),
    # Column names carry units, so they are back-quoted.
    "weather": (
        "time timestamp_ntz, `temperature_2m (°C)` double, `relative_humidity_2m (%)` double, "
        "`apparent_temperature (°C)` double, `rain (mm)` double, `snowfall (cm)` double, "
        "`wind_speed_10m (km/h)` double"),
}

ODS = {
    "ods_borough": "id_borough string, borough_name string, last_update timestamp_ntz",
    "ods_neighborhood": ("id_neighborhood int, borough_fk string, neighborhood_name string, "
                         "service_zone string, last_update timestamp_ntz"),
    "ods_vendor": "id_vendor int, vendor_name string, last_update timestamp_ntz",
    "ods_ratecode": "id_ratecode int, ratecode_name string, last_update timestamp_ntz",
    "ods_payment_type": "id_payment_type int, payment_type string, last_update timestamp_ntz",
    "ods_taxi_trip": (
        "id_trip string, pickup_datetime timestamp_ntz, dropoff_datetime timestamp_ntz, vendor_fk int, "
        "pickup_neighborhood_fk int, dropoff_neighborhood_fk int, rate_code_fk int, store_and_fwd_flag string, "
        "passenger_count int, trip_distance double, payment_type_fk int, fare_amount double, extra double, "
        "mta_tax double, tip_amount double, tolls_amount double, improvement_surcharge double, "
        "congestion_surcharge double, airport_fee double, total_amount double, last_update timestamp_ntz"),
    "ods_weather_dt": (
        "id_weather string, borough_fk string, weather_date date, weather_time string, temperature double, "
        "apparent_temperature double, rain double, snowfall double, wind_speed double, humidity double, "
        "last_update timestamp_ntz, weather_datetime timestamp_ntz"),
}

MART = {
    "dm_vendor": ("key_vendor bigint, id_vendor int, vendor_name string, valid_from timestamp_ntz, "
                  "valid_to timestamp_ntz, is_current boolean"),
    "dm_zone": ("key_zone bigint, id_neighborhood int, neighborhood_name string, "
                "borough_name string, service_zone string, valid_from timestamp_ntz, "
                "valid_to timestamp_ntz, is_current boolean"),
    "dm_date": ("key_date int, date date, day_name string, month_name string, year smallint, week int, "
                "is_weekend boolean, season string, is_holiday boolean, holiday_name string"),
    "dm_weather_dt": (
        "key_weather bigint, id_weather string, weather_date date, weather_time string, temperature double, "
        "apparent_temperature double, rain double, snowfall double, wind_speed double, humidity double, "
        "borough_name string, temperature_category string, apparent_temperature_category string, "
        "rain_intensity string, snow_intensity string, is_rainy boolean, is_snowy boolean, wind_intensity string"),
    "dm_fact_taxi_trip": (
        "key_taxi_trip bigint, id_trip string, key_vendor bigint, key_zone_pickup bigint, key_zone_dropoff bigint, "
        "key_date_pickup int, key_date_dropoff int, key_weather bigint, pickup_time string, dropoff_time string, "
        "payment_type string, ratecode_name string, store_and_fwd_flag string, passenger_count int, "
        "trip_distance double, fare_amount double, extra double, mta_tax double, tip_amount double, "
        "tolls_amount double, improvement_surcharge double, congestion_surcharge double, airport_fee double, "
        "total_amount double, trip_duration_minutes decimal(10,2), tip_percentage decimal(10,2), "
        "is_cross_borough boolean, time_of_day_category string"),
    "last_execution_times": "target_table string, time timestamp_ntz",
}


def schema(name: str) -> StructType:
    for cat in (RAW, ODS, MART):
        if name in cat:
            return StructType.fromDDL(cat[name])
    raise KeyError(name)
