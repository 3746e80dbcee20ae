"""Expose a stored warehouse as SQL tables, so report SQL runs through ``spark.sql``.

Tables are external (``USING parquet LOCATION``) over the folders of the newest
snapshot; nothing is copied.  Schemas follow the original's names: ``dwh_ods`` for the
operational layer and ``dwh_datamart`` for the star (with ``dm_weather`` as
a second name of ``dm_weather_dt``, the name its reports use).
"""

from __future__ import annotations

import json
import os

from pyspark.sql import SparkSession
from pyspark.sql.types import StructType

from .files import register_views
from .snapshots import Snapshots, folders

ODS_TABLES = ["ods_borough", "ods_neighborhood", "ods_vendor", "ods_ratecode",
              "ods_payment_type", "ods_weather_dt", "ods_taxi_trip"]
MART_TABLES = ["dm_date", "dm_vendor", "dm_zone", "dm_weather_dt", "dm_fact_taxi_trip",
               "last_execution_times", "quality_summary"]


def _create(spark: SparkSession, table: str, root: str, entry: dict) -> None:
    """An external table over the folders of a snapshot's entry."""
    schema = StructType.fromJson(json.loads(entry["schema"]))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    if "path" in entry:
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet LOCATION '{root}/{entry['path']}'")
        return
    spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet PARTITIONED BY ({entry['by']}) LOCATION '{root}'")
    parts = " ".join(f"PARTITION ({entry['by']}={month}) LOCATION '{root}/{f}'"
                     for month, f in zip(sorted(entry["months"]), folders(entry)))
    spark.sql(f"ALTER TABLE {table} ADD {parts}")


def register_catalog(spark: SparkSession, root: str, ods_schema: str = "dwh_ods",
                     mart_schema: str = "dwh_datamart", raw_roles=None) -> list[str]:
    """Create (or refresh) the schemas and one external table per stored table."""
    made = []
    _, content = Snapshots(spark, root).latest()
    for schema, names in ((ods_schema, ODS_TABLES), (mart_schema, MART_TABLES)):
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {schema}")
        for name in names:
            entry = content.get("tables", {}).get(name)
            if entry is None:
                continue
            spark.sql(f"DROP TABLE IF EXISTS {schema}.{name}")
            _create(spark, f"{schema}.{name}", os.path.join(root, name), entry)
            made.append(f"{schema}.{name}")
    spark.sql(f"DROP VIEW IF EXISTS {mart_schema}.dm_weather")
    spark.sql(f"CREATE VIEW {mart_schema}.dm_weather AS SELECT * FROM {mart_schema}.dm_weather_dt")
    made.append(f"{mart_schema}.dm_weather")
    if raw_roles is not None:
        views = {"raw_borough": raw_roles.borough(), "raw_neighborhood": raw_roles.neighborhood(),
                 "raw_vendor_id": raw_roles.vendor(), "raw_ratecode_id": raw_roles.ratecode(),
                 "raw_payment_type": raw_roles.payment_type(), "raw_taxi_trip": raw_roles.trips(),
                 "raw_weather": raw_roles.weather()}
        register_views(views)
        made += views
    return made
