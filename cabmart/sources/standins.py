"""Stand-in raw roles over the driver's parquet tables.

The warehouse's own raw files (trip records, zone and code lookups, weather
readings) are not available, so each role is a projection of the given
tables; every role grows with its source table.

money trips   lineitem x orders: pickup = order date, dropoff = ship date
event trips   events of type click / purchase / signup: pickup = ts
weather       events of type view / error, one reading each, per region and hour
boroughs      region names
zones         customer x nation x region (many rows per zone id: the dedup keeps one)
vendors       supplier
rate codes    lineitem line number -> return flag and line status
payment types order priority digit -> priority text
"""

from __future__ import annotations

import datetime as _dt
import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import truncate_to_hour
from ..operators import broadcast_if_small

TABLE_COLUMNS = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
               "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                 "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                 "l_shipdate"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
}


class Tables:
    """Lazy readers for the driver tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._frames: dict[str, DataFrame] = {}

    def __call__(self, name: str) -> DataFrame:
        # One reader per table and folder: the file listing and footers are read once.
        if name not in self._frames:
            path = os.path.join(self.sf_dir, f"{name}.parquet")
            self._frames[name] = self.spark.read.parquet(path)
        return self._frames[name]


# Stand-in trips are as old as the tables' orders; the floor of real trip records would drop most of them.
MIN_PICKUP = _dt.datetime(1900, 1, 1)

TRIP_EVENT_TYPES = ["click", "purchase", "signup"]
WEATHER_EVENT_TYPES = ["view", "error"]


def raw_borough(t: Tables) -> DataFrame:
    return t("region").select(F.col("r_name").alias("boroughname"))


def _nation_region(t: Tables) -> DataFrame:
    n, r = t("nation"), t("region")
    return (n.join(broadcast_if_small(r), n["n_regionkey"] == r["r_regionkey"])
             .select("n_nationkey", "n_name", "r_name"))


def raw_neighborhood(t: Tables) -> DataFrame:
    c = t("customer").select("c_nationkey", "c_mktsegment")
    z = broadcast_if_small(_nation_region(t))
    return (c.join(z, c["c_nationkey"] == z["n_nationkey"])
             .select(F.col("c_nationkey").alias("LocationID"), F.col("r_name").alias("Borough"),
                     F.col("n_name").alias("Zone"), F.col("c_mktsegment").alias("service_zone")))


def raw_vendor(t: Tables) -> DataFrame:
    return t("supplier").select(F.col("s_suppkey").cast("int").alias("id"),
                                F.col("s_name").alias("vendor"))


def raw_ratecode(t: Tables) -> DataFrame:
    return t("lineitem").select(
        F.col("l_linenumber").alias("id"),
        F.concat_ws("  ", "l_returnflag", "l_linestatus").alias("ratecode"))


def raw_payment_type(t: Tables) -> DataFrame:
    p = F.col("o_orderpriority")
    return t("orders").select(F.substring(p, 1, 1).cast("int").alias("id"),
                              F.expr("substr(o_orderpriority, 3)").alias("type"))


def raw_trip_money(t: Tables) -> DataFrame:
    li = t("lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_quantity",
                              "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
                              "l_linestatus", "l_shipdate")
    o = t("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"])
    price, disc, tax = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    return j.select(
        F.col("l_suppkey").cast("int").alias("VendorID"),
        F.col("o_orderdate").alias("tpep_pickup_datetime"),
        F.col("l_shipdate").alias("tpep_dropoff_datetime"),
        (F.col("l_quantity") / 4).alias("passenger_count"),
        F.col("l_quantity").alias("trip_distance"),
        F.col("l_linenumber").cast("double").alias("RatecodeID"),
        F.col("l_linestatus").alias("store_and_fwd_flag"),
        (F.col("o_custkey") % 27).cast("int").alias("PULocationID"),
        (F.col("l_suppkey") % 26).cast("int").alias("DOLocationID"),
        F.substring("o_orderpriority", 1, 1).cast("bigint").alias("payment_type"),
        price.alias("fare_amount"),
        (tax * 100 - 4).alias("extra"),
        F.nullif(tax, F.lit(0.0)).alias("mta_tax"),
        (F.nullif(disc, F.lit(0.0)) * price).alias("tip_amount"),
        ((disc - 0.05) * 100).alias("tolls_amount"),
        (tax * 10).alias("improvement_surcharge"),
        F.when(F.col("l_returnflag") == "R", F.lit(2.5)).otherwise(F.lit(0.0))
         .alias("congestion_surcharge"),
        F.when(F.col("l_linenumber") == 1, F.lit(1.75)).otherwise(F.lit(0.0)).alias("airport_fee"),
        (price * (1 - disc) * (1 + tax)).alias("total_amount"))


def raw_trip_events(t: Tables) -> DataFrame:
    e = t("events").filter(F.col("event_type").isin(*TRIP_EVENT_TYPES))
    v, uid, eid = F.col("value"), F.col("user_id"), F.col("event_id")
    return e.select(
        (uid % 12).cast("int").alias("VendorID"),
        F.col("ts").alias("tpep_pickup_datetime"),
        F.timestamp_add("SECOND", F.floor(v * 60), F.col("ts")).alias("tpep_dropoff_datetime"),
        (v / 50).alias("passenger_count"),
        (v / 10).alias("trip_distance"),
        (eid % 9).cast("double").alias("RatecodeID"),
        F.when(eid % 2 == 0, F.lit("N")).otherwise(F.lit("Y")).alias("store_and_fwd_flag"),
        (uid % 25).cast("int").alias("PULocationID"),
        ((uid + eid) % 25).cast("int").alias("DOLocationID"),
        (uid % 7).alias("payment_type"),
        v.alias("fare_amount"),
        (v % 3 - 1).alias("extra"),
        F.lit(0.5).alias("mta_tax"),
        (v * 0.15).alias("tip_amount"),
        (v % 7 - 3).alias("tolls_amount"),
        F.lit(0.3).alias("improvement_surcharge"),
        F.when(F.col("event_type") == "purchase", F.lit(2.5)).otherwise(F.lit(0.0))
         .alias("congestion_surcharge"),
        F.when(uid % 10 == 0, F.lit(1.75)).otherwise(F.lit(0.0)).alias("airport_fee"),
        (v * 1.2 + 3).alias("total_amount"))


def raw_weather(t: Tables) -> DataFrame:
    e = t("events").filter(F.col("event_type").isin(*WEATHER_EVENT_TYPES))
    r = broadcast_if_small(t("region").select("r_regionkey", "r_name"))
    j = e.join(r, (e["user_id"] % 5) == r["r_regionkey"])
    v, eid = F.col("value"), F.col("event_id")
    temp = v % 55 - 15
    return j.select(
        F.col("r_name").alias("borough_name"),
        truncate_to_hour("ts").alias("time"),
        F.when(eid % 13 == 0, F.lit(None).cast("double")).otherwise(temp)
         .alias("temperature_2m (°C)"),
        (v % 100).alias("relative_humidity_2m (%)"),
        (temp - eid % 9).alias("apparent_temperature (°C)"),
        F.when(eid % 4 == 0, F.lit(0.0)).otherwise(v / 5).alias("rain (mm)"),
        F.when(v < 10, F.lit(0.0)).otherwise(v / 40).alias("snowfall (cm)"),
        F.when(eid % 11 == 0, F.lit(0.0)).otherwise(v % 70).alias("wind_speed_10m (km/h)"))
