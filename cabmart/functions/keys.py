"""Hash keys and composite text ids."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: name of the unknown member.
UNKNOWN = "unknown"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_key(c) -> Column:
    """Lower-case hex SHA-256 of a text column."""
    return F.sha2(_col(c).cast("string"), 256)


def unknown_hash() -> Column:
    return F.sha2(F.lit(UNKNOWN), 256)


def trip_id(vendor, pickup, dropoff) -> Column:
    """vendor_pickup_dropoff; NULL parts are skipped by concat_ws."""
    return F.concat_ws("_", _col(vendor).cast("string"), _col(pickup).cast("string"),
                       _col(dropoff).cast("string"))


def weather_id(borough_fk, weather_datetime) -> Column:
    return F.concat_ws("_", F.coalesce(_col(borough_fk), unknown_hash()),
                       _col(weather_datetime).cast("string"))
