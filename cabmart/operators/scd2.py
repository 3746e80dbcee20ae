"""Type-2 slowly changing dimension.

Target columns: ``key_col``, the business key, the tracked attributes,
``valid_from``, ``valid_to``, ``is_current``.  The batch carries the business
key, the tracked attributes and the time of the change (``ts_col``).

Changes are compared NULL-safe, so NULL <-> value counts as a change.  Every
step is a join on the business key, which is unique among current rows and
in the batch (checked), so no key is hot.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .materialize import materialize
from .surrogate import assign_keys


def assert_unique_key(batch: DataFrame, keys: list[str]) -> int:
    """Raise when a business key repeats; return the batch's row count (one job)."""
    per_key = batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    rows, worst = per_key.agg(F.sum("_n"), F.max("_n")).first()
    if worst is not None and worst > 1:
        raise ValueError(f"batch holds duplicate business keys {keys} ({worst} rows for one key)")
    return int(rows or 0)


def _same(tracked: list[str]):
    return reduce(lambda a, b: a & b,
                  [F.col(f"o_{c}").eqNullSafe(F.col(f"t_{c}")) for c in tracked])


def _matched(target: DataFrame, batch: DataFrame, keys, tracked, key_col, ts_col) -> DataFrame:
    cur = target.filter(F.col("is_current")).select(
        *keys, F.col(key_col).alias("t_key"), *[F.col(c).alias(f"t_{c}") for c in tracked])
    src = batch.select(*keys, *[F.col(c).alias(f"o_{c}") for c in tracked],
                       F.col(ts_col).alias("o_ts"))
    return src.join(cur, keys, "left")


def scd2_changed(target, batch, keys, tracked, key_col="key", ts_col="ods_update_time"):
    """Surrogate keys of current rows whose tracked attributes changed, with the change time."""
    m = _matched(target, batch, keys, tracked, key_col, ts_col)
    return (m.filter(F.col("t_key").isNotNull() & ~_same(tracked))
             .select(F.col("t_key").alias(key_col), F.col("o_ts").alias("valid_to")))


def scd2_closed(target, batch, keys, tracked, key_col="key", ts_col="ods_update_time"):
    """Closed versions of the changed rows (each emitted once)."""
    ch = (scd2_changed(target, batch, keys, tracked, key_col, ts_col)
          .withColumnRenamed("valid_to", "_closed_at"))
    cols = [c for c in target.columns if c not in ("valid_to", "is_current")]
    return (target.join(ch, key_col, "inner")
                  .select(*cols, F.col("_closed_at").cast("timestamp_ntz").alias("valid_to"),
                          F.lit(False).alias("is_current"))
                  .select(*target.columns))


def scd2_new(target, batch, keys, tracked, key_col="key", ts_col="ods_update_time",
             start: int = 0):
    """New versions: unseen business keys and changed ones, numbered after ``start``."""
    m = _matched(target, batch, keys, tracked, key_col, ts_col)
    fresh = m.filter(F.col("t_key").isNull() | ~_same(tracked)).select(
        *keys, *[F.col(f"o_{c}").alias(c) for c in tracked],
        F.col("o_ts").cast("timestamp_ntz").alias("valid_from"),
        F.lit(None).cast("timestamp_ntz").alias("valid_to"),
        F.lit(True).alias("is_current"))
    keyed = assign_keys(fresh, list(keys), key_col, start=start)
    return keyed.select(*target.columns)


def scd2_initial(batch, keys, tracked, key_col="key", ts_col="ods_update_time"):
    """First load: every row is a current version valid from its update time."""
    rows = batch.select(*keys, *tracked,
                        F.col(ts_col).cast("timestamp_ntz").alias("valid_from"),
                        F.lit(None).cast("timestamp_ntz").alias("valid_to"),
                        F.lit(True).alias("is_current"))
    keyed = assign_keys(rows, list(keys), key_col, start=0)
    return keyed.select(key_col, *keys, *tracked, "valid_from", "valid_to", "is_current")


def scd2_apply(target: DataFrame | None, batch: DataFrame, keys: list[str], tracked: list[str],
               key_col: str = "key", ts_col: str = "ods_update_time",
               check_unique: bool = True, stored_batch: bool = False) -> DataFrame:
    """The new dimension table: untouched rows + closed versions + new versions.

    The batch is read three times, so it is written once unless it already is
    a cheap projection of a stored table (``stored_batch=True``).
    """
    if check_unique:
        if not stored_batch:
            batch = materialize(batch, "scd2-batch")
        assert_unique_key(batch, keys)
    if target is None:
        return scd2_initial(batch, keys, tracked, key_col, ts_col)
    start = target.agg(F.max(key_col)).first()[0] or 0
    closed = scd2_closed(target, batch, keys, tracked, key_col, ts_col)
    new = scd2_new(target, batch, keys, tracked, key_col, ts_col, start=start)
    changed = scd2_changed(target, batch, keys, tracked, key_col, ts_col).select(key_col)
    kept = target.join(changed, key_col, "left_anti")
    return kept.unionByName(closed).unionByName(new)
