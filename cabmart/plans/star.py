"""The whole warehouse over one set of raw roles: ODS tables, dimensions and the fact.

The small ODS tables (code lists, zones, hourly weather) are written once,
as the warehouse stores them; their scans then carry a real size, so the
fact's lookups are planned as broadcast joins from the start instead of
shuffling the fact.  Independent tables are built concurrently (Spark runs
jobs submitted from several threads side by side).
"""

from __future__ import annotations

import datetime as _dt
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from ..operators import materialize
from ..sources.raw import roles as raw_roles
from . import ods, mart

# Fixed load time of the driver-table runs, so reruns give equal tables.
RUN_TS = _dt.datetime(2024, 6, 1, 0, 0, 0)
# Date dimension bounds where neither the caller nor the trips' own tables give them.
STAR_DATE_START = "2000-01-01"
STAR_DATE_END = "2050-12-31"


@dataclass
class Star:
    ods_borough: DataFrame
    ods_neighborhood: DataFrame
    ods_vendor: DataFrame
    ods_ratecode: DataFrame
    ods_payment_type: DataFrame
    ods_trip: DataFrame
    ods_weather: DataFrame
    dm_date: DataFrame
    dm_vendor: DataFrame
    dm_zone: DataFrame
    dm_weather: DataFrame
    fact: DataFrame


def parallel(*thunks):
    """Run independent table builds concurrently; returns their results in order."""
    with ThreadPoolExecutor(max_workers=len(thunks)) as pool:
        futures = [pool.submit(f) for f in thunks]
        return [f.result() for f in futures]


def stored_lookups(t, run_ts=RUN_TS):
    """ODS borough, zone, vendor, rate code and payment tables, written once."""
    r = raw_roles(t)
    b, v, rc, pt = parallel(
        lambda: materialize(ods.ods_borough(r.borough(), run_ts), "ods_borough"),
        lambda: materialize(ods.ods_vendor(r.vendor(), run_ts), "ods_vendor"),
        lambda: materialize(ods.ods_ratecode(r.ratecode(), run_ts), "ods_ratecode"),
        lambda: materialize(ods.ods_payment_type(r.payment_type(), run_ts), "ods_payment"))
    n = materialize(ods.ods_neighborhood(r.neighborhood(), b, run_ts), "ods_neighborhood")
    return b, n, v, rc, pt


class LazyStar:
    """The tables of a star over raw roles, each built (and written, where small) when first asked for.

    A report names the fact columns it needs (``fact_with``): only their lookups
    are joined, and only those dimensions are built.
    """

    def __init__(self, t, trips: str = "money", run_ts=RUN_TS, date_start: str | None = None,
                 date_end: str | None = None):
        self.roles = raw_roles(t, trips)
        self.spark = self.roles.spark
        self.run_ts = run_ts
        self._range = (date_start, date_end) if date_start else None

    @cached_property
    def date_range(self):
        return self._range or self.roles.date_range() or (STAR_DATE_START, STAR_DATE_END)

    # The borough table is a handful of names from a tiny scan: kept lazy (no
    # job of its own); its plan is small and broadcast where it is used.
    @cached_property
    def ods_borough(self):
        return ods.ods_borough(self.roles.borough(), self.run_ts)

    @cached_property
    def ods_neighborhood(self):
        return materialize(ods.ods_neighborhood(self.roles.neighborhood(), self.ods_borough, self.run_ts),
                           "ods_neighborhood")

    @cached_property
    def ods_vendor(self):
        return materialize(ods.ods_vendor(self.roles.vendor(), self.run_ts), "ods_vendor")

    @cached_property
    def ods_ratecode(self):
        return materialize(ods.ods_ratecode(self.roles.ratecode(), self.run_ts), "ods_ratecode")

    @cached_property
    def ods_payment_type(self):
        return materialize(ods.ods_payment_type(self.roles.payment_type(), self.run_ts), "ods_payment")

    @cached_property
    def ods_weather(self):
        return materialize(ods.ods_weather_dt(self.roles.weather(), self.ods_borough, self.run_ts), "ods_weather")

    @cached_property
    def dm_date(self):
        return mart.dm_date(self.spark, *self.date_range)

    @cached_property
    def dm_vendor(self):
        return materialize(mart.dm_vendor(self.ods_vendor, stored=True), "dm_vendor")

    @cached_property
    def dm_zone(self):
        return materialize(mart.dm_zone(self.ods_borough, self.ods_neighborhood, stored=True), "dm_zone")

    @cached_property
    def dm_weather(self):
        return materialize(mart.dm_weather_dt(self.ods_weather, self.ods_borough), "dm_weather")

    def _dims(self):
        return [lambda n=n: getattr(self, n) for n in
                ("dm_vendor", "dm_zone", "dm_date", "dm_weather", "ods_payment_type", "ods_ratecode")]

    def _date_rows(self):
        return mart.date_rows_between(*self.date_range)

    @cached_property
    def ods_trip(self):
        return ods.ods_taxi_trip(self.roles.trips(), self.ods_neighborhood, self.run_ts,
                                 min_pickup=self.roles.min_pickup)

    def fact_with(self, *columns: str) -> DataFrame:
        """Fact rows with these columns (all but the key, if none is named)."""
        valid = ods.valid_trips(self.roles.trips(), self.roles.min_pickup)
        rows = ods.transform_trips(valid, None, self.run_ts)     # zones are looked up in the fact
        dated = not columns or {"key_date_pickup", "key_date_dropoff"} & set(columns)
        return mart.fact_rows(rows, *self._dims(), date_rows=self._date_rows() if dated else None,
                              only=list(columns) or None)

    @cached_property
    def fact(self) -> DataFrame:
        """The fact with its keys."""
        return mart.dm_fact_taxi_trip(self.ods_trip, *self.build_dims(), date_rows=self._date_rows())

    def build_dims(self) -> list[DataFrame]:
        """All dimensions of the fact; independent chains are built side by side."""
        self.ods_borough
        return parallel(*self._dims())


def build_star(t, trips: str = "money", run_ts=RUN_TS, fact_keys: bool = True,
               date_start: str | None = None, date_end: str | None = None) -> Star:
    """Every table of the warehouse, from raw roles (``FileRoles``) or driver ``Tables``."""
    s = LazyStar(t, trips, run_ts, date_start, date_end)
    parallel(*s._dims(), lambda: s.ods_weather)
    fact = s.fact if fact_keys else s.fact_with()
    return Star(s.ods_borough, s.ods_neighborhood, s.ods_vendor, s.ods_ratecode, s.ods_payment_type,
                s.ods_trip, s.ods_weather, s.dm_date, s.dm_vendor, s.dm_zone, s.dm_weather, fact)
