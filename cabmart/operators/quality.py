"""Data-quality checks (T1-T3) as frames of violations or one summary row per column."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def not_null_violations(df: DataFrame, col: str) -> DataFrame:
    return df.filter(F.col(col).isNull())


def unique_violations(df: DataFrame, col: str) -> DataFrame:
    """Values of ``col`` present more than once (NULL is not a value)."""
    return (df.filter(F.col(col).isNotNull()).groupBy(col)
              .agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1))


def quality_summary(df: DataFrame, table: str, cols: list[str]) -> DataFrame:
    """One row per column: rows, NULLs, rows beyond the first of a repeated value.

    Each column is counted by value (a hash aggregate with partial sums), so
    no row is multiplied as several exact distinct counts in one aggregate would.
    """
    out = None
    for c in cols:
        by_value = df.groupBy(F.col(c).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
        null = F.col("_v").isNull()
        one = by_value.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
                           F.coalesce(F.sum(F.when(null, F.col("_n"))), F.lit(0)).alias("n_null"),
                           F.coalesce(F.sum(F.when(~null, F.col("_n") - 1)), F.lit(0)).alias("n_duplicate"))
        row = one.select(F.lit(table).alias("table_name"), F.lit(c).alias("column_name"),
                         *[F.col(n).cast("long").alias(n) for n in ("n_rows", "n_null", "n_duplicate")],
                         ((F.col("n_null") == 0) & (F.col("n_duplicate") == 0)).alias("passed"))
        out = row if out is None else out.unionByName(row)
    return out


def monthly_counts(df: DataFrame, table: str, col: str, month: str) -> DataFrame:
    """The counts of ``quality_summary`` for each month: (``table_name``, ``column_name``, ``month``, counts).

    For a column whose values lie in one month each (they hold a time), so that
    a value's repeats are in its month, and the counts of months add up.
    """
    by_value = df.groupBy(F.col(month).cast("int").alias("month"), F.col(col).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    null = F.col("_v").isNull()
    counted = by_value.groupBy("month").agg(
        F.sum("_n").alias("n_rows"), F.coalesce(F.sum(F.when(null, F.col("_n"))), F.lit(0)).alias("n_null"),
        F.coalesce(F.sum(F.when(~null, F.col("_n") - 1)), F.lit(0)).alias("n_duplicate"))
    return counted.select(F.lit(table).alias("table_name"), F.lit(col).alias("column_name"), "month",
                          *[F.col(n).cast("long").alias(n) for n in ("n_rows", "n_null", "n_duplicate")])


def replace_months(stored: DataFrame | None, counts: DataFrame, table: str, months: list[int]) -> DataFrame:
    """Stored monthly counts with those of the ``months`` of one table replaced."""
    if stored is None:
        return counts
    return stored.filter((F.col("table_name") != table) | ~F.col("month").isin(months)).unionByName(counts)


def summary_of_months(counts: DataFrame) -> DataFrame:
    """``quality_summary`` rows from monthly counts."""
    names = ("n_rows", "n_null", "n_duplicate")
    return (counts.groupBy("table_name", "column_name").agg(*[F.sum(n).alias(n) for n in names])
            .withColumn("passed", (F.col("n_null") == 0) & (F.col("n_duplicate") == 0)))


# The declared checks: every ODS model's key is present and unique.
ODS_KEYS = {
    "ods_borough": ["id_borough"],
    "ods_neighborhood": ["id_neighborhood"],
    "ods_taxi_trip": ["id_trip"],
    "ods_weather_dt": ["id_weather"],
    "ods_ratecode": ["id_ratecode"],
    "ods_payment_type": ["id_payment_type"],
    "ods_vendor": ["id_vendor"],
}


def check_models(models: dict[str, DataFrame], keys: dict[str, list[str]] | None = None) -> DataFrame:
    """The summary of every declared check of the given models."""
    out = None
    for name, cols in (keys or ODS_KEYS).items():
        part = quality_summary(models[name], name, cols)
        out = part if out is None else out.unionByName(part)
    return out
