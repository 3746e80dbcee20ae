"""Report queries (Q1-Q22) over the star.

Every report is a lazy DataFrame; only the caller collects.  Dimensions are
joined with a checked broadcast; aggregates have few groups, so partial
aggregation keeps the shuffles small.  Aggregates are pre-computed on each
side before a join of two aggregates (J12).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import dec2, safe_div
from ..functions.bins import BINS
from ..operators import broadcast_if_small

def _join(fact, dim, fact_key, dim_key, cols, how="inner"):
    """Inner join on a dimension key; the dimension side is broadcast when its size
    estimate is under the limit (stored dimensions carry their file size)."""
    d = broadcast_if_small(dim.select(F.col(dim_key).alias(f"_{fact_key}"), *cols))
    # No dimension holds the unknown member, so its facts (which can be many, all
    # with one key) need not reach the join.
    fact = fact.filter(F.col(fact_key) != -1)
    return fact.join(d, fact[fact_key] == d[f"_{fact_key}"], how)


def weather_multidim(fact, zones, dates, start_date="2024-01-01", end_date="2024-04-01"):
    """Q1: borough x day name x weekend x season KPIs over a half-open date range
    (current zones only; the weather join of the original adds nothing and is left out)."""
    z = zones.filter(F.col("is_current"))
    d = dates.filter((F.col("date") >= F.lit(start_date).cast("date"))
                     & (F.col("date") < F.lit(end_date).cast("date")))
    j = _join(fact, z, "key_zone_pickup", "key_zone", ["borough_name"])
    j = _join(j, d, "key_date_pickup", "key_date", ["day_name", "is_weekend", "season"])
    n = F.count(F.lit(1))
    agg = j.groupBy("borough_name", "day_name", "is_weekend", "season").agg(
        n.alias("total_trips"),
        F.sum("total_amount").alias("total_revenue"),
        F.avg("total_amount").alias("avg_fare"),
        F.avg("trip_distance").alias("avg_distance"),
        F.avg(F.col("trip_duration_minutes").cast("double")).alias("avg_duration"),
        F.sum("tip_amount").alias("total_tips"),
        safe_div(F.sum("total_amount"), n).alias("revenue_per_trip"),
        safe_div(F.sum("trip_distance"), n).alias("distance_per_trip"))
    return agg.select(F.lower("borough_name").alias("pickup_borough"), "day_name", "is_weekend",
                      "season", "total_trips", "total_revenue", "avg_fare", "avg_distance",
                      "avg_duration", "total_tips", "revenue_per_trip", "distance_per_trip")


def trips_by_zone(fact, zones, role="dropoff"):
    """Q2 (dropoff) / Q21 (pickup): trips per zone name and borough, most first."""
    key = "key_zone_dropoff" if role == "dropoff" else "key_zone_pickup"
    j = _join(fact, zones, key, "key_zone", ["neighborhood_name", "borough_name"])
    return (j.groupBy("neighborhood_name", "borough_name")
             .agg(F.count(F.lit(1)).alias("total_trips"))
             .orderBy(F.desc("total_trips"), "neighborhood_name", "borough_name"))


def avg_revenue_by_vendor(fact, vendors):
    """Q3."""
    j = _join(fact, vendors, "key_vendor", "key_vendor", ["vendor_name"])
    return (j.groupBy("vendor_name").agg(F.avg("total_amount").alias("avg_revenue"))
             .orderBy(F.desc("avg_revenue")))


def trips_by_weather_category(fact, weather, category="apparent_temperature_category"):
    """Q4: trips per weather category, most first."""
    j = _join(fact, weather, "key_weather", "key_weather", [category])
    return (j.groupBy(category).agg(F.count(F.lit(1)).alias("total_trips"))
             .orderBy(F.desc("total_trips")))


def best_revenue_day(fact, dates, year=2025, month_name="january"):
    """Q5: the day(s) of a month with the highest revenue; ties are all kept."""
    d = dates.filter((F.col("year") == year) & (F.col("month_name") == month_name))
    j = _join(fact, d, "key_date_pickup", "key_date", ["date"])
    daily = j.groupBy("date").agg(F.sum("total_amount").alias("daily_revenue"))
    # One row per day of one month: a global window over it is tiny.
    w = Window.orderBy(F.desc("daily_revenue"))
    return (daily.withColumn("_r", F.rank().over(w)).filter(F.col("_r") == 1)
                 .select("date", "daily_revenue"))


def revenue_by_year_month(fact, dates, with_month_number=False):
    """Q6 (month names alphabetical) / Q7 (calendar order with the month number)."""
    j = _join(fact, dates, "key_date_pickup", "key_date", ["year", "month_name", "date"])
    if with_month_number:
        j = j.withColumn("month_num", F.month("date"))
        return (j.groupBy("year", "month_num", "month_name")
                 .agg(F.sum("total_amount").alias("revenue")).orderBy("year", "month_num"))
    return (j.groupBy("year", "month_name").agg(F.sum("total_amount").alias("revenue"))
             .orderBy("year", "month_name"))


def holiday_trips(fact, zones, dates, role="pickup", holiday: str | None = None):
    """Q8-Q11: trips per zone name on holidays (one named holiday, or any)."""
    dk, zk = (("key_date_pickup", "key_zone_pickup") if role == "pickup"
              else ("key_date_dropoff", "key_zone_dropoff"))
    cond = F.col("is_holiday") == F.lit(True)
    if holiday is not None:
        cond = cond & (F.col("holiday_name") == F.lit(holiday))
    j = _join(fact, dates.filter(cond), dk, "key_date", [])
    j = _join(j, zones, zk, "key_zone", ["neighborhood_name"])
    return (j.groupBy("neighborhood_name").agg(F.count(F.lit(1)).alias("trips"))
             .orderBy(F.desc("trips"), "neighborhood_name"))


RATE_COLUMNS = {"is_rainy", "is_snowy", "rain_intensity", "snow_intensity", "wind_intensity",
                "temperature_category", "apparent_temperature_category"}


def trips_per_weather_record(fact, weather, category: str, zones=None,
                             value_name: str = "trips_per_weather", out_category: str | None = None):
    """Q12-Q19: trips per category divided by the category's number of weather records.

    With ``zones`` the trips are split by pickup borough; the denominator stays
    the count over all boroughs.  A NULL category never matches (inner join).
    """
    if category not in RATE_COLUMNS:
        raise ValueError(f"not a weather category column: {category}")
    totals = weather.groupBy(category).agg(F.count_distinct("key_weather").alias("total_weather"))
    j = _join(fact, weather, "key_weather", "key_weather", [category])
    keys = [category]
    if zones is not None:
        j = _join(j, zones, "key_zone_pickup", "key_zone", [F.col("borough_name").alias("borough")])
        keys.append("borough")
    trips = j.groupBy(*keys).agg(F.count(F.lit(1)).alias("taxi_trips"))
    r = trips.join(F.broadcast(totals), category)
    rate = dec2(F.col("taxi_trips").cast("double") / F.col("total_weather")).alias(value_name)
    cols = [F.col(category).alias(out_category or category), "taxi_trips"]
    if zones is not None:
        cols.append("borough")
    out = r.select(*cols, rate)
    # ordered like the original reports: by category, or by borough when split
    return out.orderBy("borough" if zones is not None else (out_category or category))


def with_condition_label(df, flag_col: str, yes: str, no: str, out: str = "label"):
    """D-1: boolean -> text label."""
    return df.withColumn(out, F.when(F.col(flag_col), F.lit(yes))
                                .when(~F.col(flag_col), F.lit(no)))


def distance_by_borough(fact, zones):
    """Q20: average trip distance per pickup borough among trips with no airport fee."""
    f = fact.filter(F.col("airport_fee") == 0)
    j = _join(f, zones, "key_zone_pickup", "key_zone", ["borough_name"])
    agg = j.groupBy("borough_name").agg(F.avg("trip_distance").alias("trips_per_category"))
    return agg.select(F.col("borough_name").alias("borough"), "trips_per_category",
                      F.lit("Avg trip distance (airport_fee=0)").alias("intensity"))


def tip_rate_by_temperature(fact, weather):
    """Q22: tips / total per apparent temperature category."""
    j = _join(fact, weather, "key_weather", "key_weather", ["apparent_temperature_category"])
    return (j.groupBy("apparent_temperature_category")
             .agg(safe_div(F.sum("tip_amount"), F.sum("total_amount")).alias("tip_rate")))


def category_order(name: str) -> list[str]:
    """Natural label order of a weather category (all labels, from the bin rules)."""
    _, rules, other = BINS[name]
    return [label for _, _, label in rules] + [other]
