"""Command line: build the warehouse from raw files, then run reports on it.

    python -m cabmart build  --raw DATA_DIR --out WAREHOUSE_DIR [--run-ts 2024-06-01T00:00:00]
    python -m cabmart report NAME --out WAREHOUSE_DIR [--param key=value ...] [--dest PARQUET_DIR]

The session comes from ``SparkSession.builder.getOrCreate()`` (spark-submit
settings apply); the checkpoint folder is the cluster's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import argparse
import datetime as dt
import sys

from pyspark.sql import SparkSession

from .plans import reports, charts, warehouse
from .sources.raw import FileRoles


def _reports(s, p):
    def i(k, d):
        return int(p.get(k, d))

    return {
        "multidim": lambda: reports.weather_multidim(s.fact, s.dm_zone, s.dm_date,
                                                     p.get("start_date", "2024-01-01"),
                                                     p.get("end_date", "2024-04-01")),
        "zone_dropoff": lambda: reports.trips_by_zone(s.fact, s.dm_zone, "dropoff"),
        "zone_pickup": lambda: reports.trips_by_zone(s.fact, s.dm_zone, "pickup"),
        "vendor_avg": lambda: reports.avg_revenue_by_vendor(s.fact, s.dm_vendor),
        "temp_trips": lambda: reports.trips_by_weather_category(s.fact, s.dm_weather),
        "best_day": lambda: reports.best_revenue_day(s.fact, s.dm_date, i("year", 2025),
                                                     p.get("month", "january")),
        "month_alpha": lambda: reports.revenue_by_year_month(s.fact, s.dm_date),
        "month_calendar": lambda: reports.revenue_by_year_month(s.fact, s.dm_date, True),
        "holiday": lambda: reports.holiday_trips(s.fact, s.dm_zone, s.dm_date,
                                                 p.get("role", "pickup"), p.get("holiday")),
        "rate": lambda: reports.trips_per_weather_record(
            s.fact, s.dm_weather, p.get("category", "is_rainy"),
            zones=s.dm_zone if p.get("by_borough") == "true" else None),
        "distance_by_borough": lambda: reports.distance_by_borough(s.fact, s.dm_zone),
        "tip_rate_by_temp": lambda: reports.tip_rate_by_temperature(s.fact, s.dm_weather),
        "top_dropoff": lambda: charts.top_n_with_label(
            reports.trips_by_zone(s.fact, s.dm_zone, "dropoff"), i("n", 20)),
        "top_pickup": lambda: charts.top_n_with_label(
            reports.trips_by_zone(s.fact, s.dm_zone, "pickup"), i("n", 20)),
    }


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="cabmart")
    sub = ap.add_subparsers(dest="cmd", required=True)
    b = sub.add_parser("build")
    b.add_argument("--raw", required=True)
    b.add_argument("--out", required=True)
    b.add_argument("--run-ts", default=None)
    b.add_argument("--fact-mode", default="upsert", choices=["upsert", "append"])
    b.add_argument("--date-start", default="2024-01-01")
    b.add_argument("--date-end", default="2050-12-31")
    r = sub.add_parser("report")
    r.add_argument("name")
    r.add_argument("--out", required=True)
    r.add_argument("--param", action="append", default=[])
    r.add_argument("--dest", default=None)
    a = ap.parse_args(argv)

    spark = SparkSession.builder.appName("cabmart").getOrCreate()
    if a.cmd == "build":
        run_ts = dt.datetime.fromisoformat(a.run_ts) if a.run_ts else dt.datetime.now(dt.UTC).replace(tzinfo=None)
        warehouse.run_warehouse(FileRoles(spark, a.raw), a.out, run_ts, fact_mode=a.fact_mode,
                                date_start=a.date_start, date_end=a.date_end)
        return 0
    params = dict(kv.split("=", 1) for kv in a.param)
    table = _reports(warehouse.read_stored(spark, a.out), params)
    if a.name not in table:
        print(f"unknown report {a.name}; one of {sorted(table)}", file=sys.stderr)
        return 2
    df = table[a.name]()
    if a.dest:
        df.write.mode("overwrite").parquet(a.dest)
    else:
        df.show(50, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
