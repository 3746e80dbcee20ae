"""Single stored tables (L1, L4, S10), each with snapshots of its own (see ``snapshots``).

A warehouse publishes all its tables in one snapshot; these helpers are for a
table that is written on its own, such as the target of a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .snapshots import Build, Snapshots


def versions(spark: SparkSession, root: str) -> list[int]:
    return Snapshots(spark, root).numbers()


def read_current(spark: SparkSession, root: str, schema: StructType | str | None = None):
    """The table's newest snapshot; an empty frame (or None) on first run."""
    found = Build(spark, root).stored("")
    if found is None and schema is not None:
        return spark.createDataFrame([], schema)
    return found


def write_version(df: DataFrame, root: str, build: Build | None = None) -> str:
    """Full rewrite (L1, and L2/L3 results); ``build`` is what the caller read the old version from.

    Without it the version to build on is the newest one when the write begins.
    """
    build = build or Build(df.sparkSession, root)
    build.save(df, "")
    build.publish()
    return f"{build.root}/{build.tables['']['path']}"


read_partitioned = read_current
