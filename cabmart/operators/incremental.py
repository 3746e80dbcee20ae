"""Incremental loads (L2-L10, L16, L17): pure functions ``(target, batch) -> new target``.

Writing the result is left to ``cabmart.sources.tables``; nothing here
mutates storage.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, functions as F

from ..functions.calendar import ntz_lit
from .lookup import broadcast_if_small

# Floors used when a target has no mark yet.
EVENT_TIME_FLOOR = _dt.datetime(2000, 1, 1)
PROCESS_TIME_FLOOR = _dt.datetime(1900, 1, 1)

WATERMARK_DDL = "target_table string, time timestamp_ntz"


def stamp(df: DataFrame, run_ts, col: str = "last_update") -> DataFrame:
    """One load timestamp for the whole run (a literal, not CURRENT_TIMESTAMP)."""
    return df.withColumn(col, ntz_lit(run_ts))


def upsert_by_key(target: DataFrame, batch: DataFrame, keys: list[str],
                  key_rows_bound: int | None = None) -> DataFrame:
    """Delete target rows whose key is in the batch, then insert the batch.

    Duplicates inside the batch survive, and NULL keys never delete, as in a
    delete+insert.  The distinct batch keys are pre-aggregated map-side;
    they are broadcast only when provably small.
    """
    drop = broadcast_if_small(batch.select(*keys).distinct(), max_rows=key_rows_bound)
    kept = target.join(drop, keys, "left_anti")
    return kept.unionByName(batch.select(*target.columns))


def append(target: DataFrame, batch: DataFrame) -> DataFrame:
    return target.unionByName(batch.select(*target.columns))


def high_water(target: DataFrame | None, col: str):
    """MAX(col) of the target as a driver value (None when empty or absent)."""
    if target is None:
        return None
    return target.agg(F.max(col)).first()[0]


def after_event_mark(batch: DataFrame, col: str, mark, lookback: str | None = "1 day",
                     floor=EVENT_TIME_FLOOR, strict: bool = False) -> DataFrame:
    """Rows newer than an event-time mark.

    ``strict=False``: ``col >= coalesce(mark, floor) - lookback`` (late rows
    inside the lookback are read again).  ``strict=True``: ``col > mark``
    (no filter when there is no mark).  The mark is a literal, so the filter
    reaches the parquet scan.
    """
    if strict:
        return batch if mark is None else batch.filter(F.col(col) > ntz_lit(mark))
    base = ntz_lit(mark if mark is not None else floor)
    if lookback:
        base = base - F.expr(f"INTERVAL {lookback}")
    return batch.filter(F.col(col) >= base)


def empty_watermarks(spark) -> DataFrame:
    return spark.createDataFrame([], WATERMARK_DDL)


def read_mark(marks: DataFrame | None, target_table: str, floor=PROCESS_TIME_FLOOR):
    """COALESCE(MAX(time), floor) for one target (one small action)."""
    if marks is None:
        return floor
    v = marks.filter(F.col("target_table") == target_table).agg(F.max("time")).first()[0]
    return v if v is not None else floor


def after_process_mark(batch: DataFrame, col: str, mark) -> DataFrame:
    """``col > mark`` on the load timestamp."""
    return batch.filter(F.col(col) > ntz_lit(mark))


def set_mark(marks: DataFrame, target_table: str, time) -> DataFrame:
    """INSERT .. ON CONFLICT (target_table) DO UPDATE SET time."""
    spark = marks.sparkSession
    row = spark.createDataFrame([(target_table, time)], WATERMARK_DDL)
    return upsert_by_key(marks, row, ["target_table"], key_rows_bound=1)


def require_newer(marks: DataFrame | None, run_ts) -> None:
    """Raise unless ``run_ts`` is later than every stored mark.

    Marks are load times and the next run reads what is stamped later, so two
    runs with one load time would lose the second run's rows.
    """
    newest = None if marks is None else marks.agg(F.max("time")).first()[0]
    if newest is not None and run_ts <= newest:
        raise ValueError(f"load time {run_ts} is not later than the newest stored mark {newest}")


def sync_schema(target: DataFrame, batch: DataFrame, mode: str = "fail") -> tuple[DataFrame, DataFrame]:
    """Schema-change policy of an incremental target (L17): (target, batch) ready to be merged.

    ``fail``: raise when names or types differ.  ``sync_all_columns``: the
    target takes the batch's columns and types; new ones are NULL in old rows,
    vanished ones go.  ``append_new_columns`` / ``merge``: the target also gains
    new columns but keeps vanished ones, which the batch gets as NULL.
    ``ignore``: the target stays as it is and the batch follows it.
    """
    have = {f.name.lower(): f for f in batch.schema.fields}
    want = {f.name.lower(): f for f in target.schema.fields}

    def as_fields(df: DataFrame, fields, own) -> DataFrame:
        cols = [(F.col(f"`{own[f.name.lower()].name}`") if f.name.lower() in own else F.lit(None))
                .cast(f.dataType).alias(f.name) for f in fields]
        return df.select(*cols)

    if mode == "fail":
        diff = sorted(set(have) ^ set(want))
        types = sorted(n for n in set(have) & set(want) if have[n].dataType != want[n].dataType)
        if diff or types:
            raise ValueError(f"schema change refused: columns {diff}, types {types}")
        return target, batch.select(*target.columns)
    if mode == "sync_all_columns":
        fields = batch.schema.fields
    elif mode in ("append_new_columns", "merge"):
        fields = [*target.schema.fields, *(f for n, f in have.items() if n not in want)]
    elif mode == "ignore":
        fields = target.schema.fields
    else:
        raise ValueError(f"unknown on_schema_change mode {mode!r}")
    return as_fields(target, fields, want), as_fields(batch, fields, have)
