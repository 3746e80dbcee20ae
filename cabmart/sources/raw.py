"""Raw roles of the warehouse: the original file layout, or stand-ins over driver tables.

Both expose the same methods (``borough``, ``neighborhood``, ``vendor``,
``ratecode``, ``payment_type``, ``trips``, ``weather``), so every model and
the warehouse run take either.

File layout (as the original registers it)::

    <root>/zones/borough.csv                 <root>/taxi_trip/vendor_id.csv
    <root>/zones/taxi_zone_lookup.csv        <root>/taxi_trip/ratecode_id.csv
    <root>/taxi_trip/*.parquet               <root>/taxi_trip/payment_type.csv
    <root>/weather_dt/Weather_<Name>/*.csv   (3 preamble lines, then a header)
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..operators.incremental import EVENT_TIME_FLOOR
from . import files, schemas
from . import standins as S

# Weather folder name -> borough name.
WEATHER_FOLDERS = {
    "Weather_Bronx": "Bronx",
    "Weather_Brooklyn": "Brooklyn",
    "Weather_Manhattan": "Manhattan",
    "Weather_StatenIsland": "Staten Island",
    "Weather_Queens": "Queens",
    "Weather_EWR": "EWR",
}


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Columns of ``schema`` by case-insensitive name, cast to its types; missing ones NULL."""
    have = {c.lower(): c for c in df.columns}
    cols = []
    for f in schema.fields:
        src = have.get(f.name.lower())
        col = F.col(f"`{src}`") if src else F.lit(None)
        cols.append(col.cast(f.dataType).alias(f.name))
    return df.select(*cols)


class FileRoles:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root

    def _p(self, *parts):
        return os.path.join(self.root, *parts)

    def borough(self):
        return files.read_csv(self.spark, self._p("zones", "borough.csv"), "borough")

    def neighborhood(self):
        return files.read_csv(self.spark, self._p("zones", "taxi_zone_lookup.csv"), "neighborhood")

    def vendor(self):
        return files.read_csv(self.spark, self._p("taxi_trip", "vendor_id.csv"), "vendor_id")

    def ratecode(self):
        return files.read_csv(self.spark, self._p("taxi_trip", "ratecode_id.csv"), "ratecode_id")

    def payment_type(self):
        return files.read_csv(self.spark, self._p("taxi_trip", "payment_type.csv"), "payment_type")

    def _files(self, *parts) -> list[str]:
        """Paths that match a glob, by the file system of the root."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self._p(*parts))
        found = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
        return sorted(st.getPath().toString() for st in found or [])

    def trips(self):
        """All trip files.  A column's physical type may differ between files (a count as INT64 or
        DOUBLE), so files are grouped by their types, and each group is cast."""
        want = schemas.schema("taxi_trip")
        out = None
        for schema, paths in files.same_types(self.spark, self._files("taxi_trip", "*.parquet")):
            part = conform(self.spark.read.schema(schema).parquet(*paths), want)
            out = part if out is None else out.unionByName(part)
        return self.spark.createDataFrame([], want) if out is None else out

    def weather(self):
        """Readings of all borough folders; each file's columns go by its own header line."""
        return files.read_headed_folders(
            self.spark, self._p("weather_dt", "Weather_*", "*.csv"), schemas.schema("weather"),
            "borough_name", r"(Weather_[^/]+)/", WEATHER_FOLDERS, r"^Weather_")

    @property
    def min_pickup(self):
        return EVENT_TIME_FLOOR

    def date_range(self):
        return None                          # the declared range of the date dimension


class StandInRoles:
    """Roles over the driver tables (see ``standins``)."""

    def __init__(self, t: S.Tables, trips: str = "money"):
        self.t = t
        self.spark = t.spark
        self.kind = trips

    def borough(self):
        return S.raw_borough(self.t)

    def neighborhood(self):
        return S.raw_neighborhood(self.t)

    def vendor(self):
        return S.raw_vendor(self.t)

    def ratecode(self):
        return S.raw_ratecode(self.t)

    def payment_type(self):
        return S.raw_payment_type(self.t)

    def trips(self):
        return S.raw_trip_money(self.t) if self.kind == "money" else S.raw_trip_events(self.t)

    def weather(self):
        return S.raw_weather(self.t)

    @property
    def min_pickup(self):
        return S.MIN_PICKUP

    def date_range(self):
        """First and last day of the trips (read from the tables), or None for the events."""
        if self.kind != "money":
            return None
        lo = self.t("orders").agg(F.min(F.to_date("o_orderdate"))).first()[0]
        hi = self.t("lineitem").agg(F.max(F.to_date("l_shipdate"))).first()[0]
        return (lo.isoformat(), hi.isoformat()) if lo and hi else None


def roles(src, trips: str = "money"):
    """Accept a roles object, or driver ``Tables`` (wrapped as stand-ins)."""
    if isinstance(src, S.Tables):
        return StandInRoles(src, trips)
    return src
