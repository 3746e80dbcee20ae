"""Surrogate key assignment.

Keys are ``start + rank`` in a total order, so a rerun gives the same keys
and an SQL ``row_number() over (order by ...)`` can check them.

``assign_keys`` numbers tables with a proven bound (code lists, type-2
dimensions, whose batch is counted by the uniqueness check) in one window.
``number_in_buckets`` numbers tables of any size: rows are sorted into ranges
by one shuffle and numbered inside their range, and the few range counts are
summed up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .materialize import materialize


def _order(cols: list) -> list[Column]:
    out = []
    for c in cols:
        if isinstance(c, str):
            out.append(F.col(c).asc_nulls_first())
        else:
            out.append(c)
    return out


def assign_keys(df: DataFrame, order: list, key: str = "key", start: int | Column = 0) -> DataFrame:
    """Add ``key`` = start + 1, start + 2, ... following ``order`` (NULLS FIRST), in one window.

    For dimensions only: the caller knows that the input is small.
    """
    start_col = start if isinstance(start, Column) else F.lit(int(start))
    w = Window.orderBy(*_order(order))
    return df.select((start_col + F.row_number().over(w)).cast("long").alias(key), *df.columns)


def number_in_buckets(df: DataFrame, buckets: list[Column], order: list, key: str = "key",
                      start: int | Column = 0) -> DataFrame:
    """Add ``key`` = start + 1, ... following ``buckets``, then ``order`` (both NULLS FIRST).

    The rows are shuffled once, into ranges of that order, and written with their
    place in the range; a second pass adds the rows of the ranges before, one number a
    range.  ``order`` names all columns that tell two rows apart, so equal rows are
    interchangeable, and a hash of where a row was read cuts a group of copies into several ranges.
    """
    start_col = start if isinstance(start, Column) else F.lit(int(start))
    cols = df.columns
    names = [f"_bucket{i}" for i in range(len(buckets))]
    source = F.xxhash64(F.spark_partition_id(), F.monotonically_increasing_id())
    rows = df.select(*[b.alias(n) for b, n in zip(buckets, names)], *cols).withColumn("_source", source)
    by = [*_order(names), *_order(order)]
    ranged = rows.repartitionByRange(*by, F.col("_source")).sortWithinPartitions(*by)
    # The id has the partition's number above the row's place in it.
    held = materialize(ranged.select(F.monotonically_increasing_id().alias("_id"), *cols), f"keys-{key}")
    part = F.shiftright("_id", 33)
    before, offsets = 0, []
    for r in held.groupBy(part.alias("part")).count().orderBy("part").collect():       # one row a range
        offsets.append((r.part, before))
        before += r["count"]
    ranges = df.sparkSession.createDataFrame(offsets, "_part long, _before long")
    place = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return (held.withColumn("_part", part).join(F.broadcast(ranges), "_part")
            .select((start_col + F.col("_before") + place + 1).cast("long").alias(key), *cols))
