"""Chart-ready frames (D-1..D-8): the rows and ordering a chart would draw.

Drawing itself is out of scope; these stay distributed until the caller
collects them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from . import reports


def top_n_with_label(ranked: DataFrame, n: int, count_col: str = "total_trips") -> DataFrame:
    """D-7 / O3: top-n zones (ties broken by name) with a ``zone (borough)`` label."""
    top = ranked.orderBy(F.desc(count_col), "neighborhood_name", "borough_name").limit(n)
    return top.withColumn("label", F.concat(F.col("neighborhood_name"), F.lit(" ("),
                                            F.col("borough_name"), F.lit(")")))


def with_category_rank(df: DataFrame, col: str, labels: list[str],
                       rank_col: str = "category_rank") -> DataFrame:
    """D-5 / O5: position of ``col`` in a fixed label list (NULL when absent),
    stripped of blanks first (D-3)."""
    arr = F.array(*[F.lit(x) for x in labels])
    pos = F.array_position(arr, F.trim(F.col(col)))
    return df.withColumn(rank_col, F.when(pos > 0, pos.cast("int")))


def month_order(revenue_by_month: DataFrame) -> DataFrame:
    """D-6: distinct month names with their calendar position."""
    return (revenue_by_month.groupBy("month_name").agg(F.min("month_num").alias("month_num"))
            .orderBy("month_num"))


def rate_by_borough_chart(fact, weather, zones, category: str) -> DataFrame:
    """D-8: intensity x borough rates with the category order of the chart."""
    df = reports.trips_per_weather_record(fact, weather, category, zones=zones,
                                          value_name="trips_per_category",
                                          out_category="intensity")
    df = with_category_rank(df, "intensity", reports.category_order(category))
    return df.orderBy("borough", "category_rank")


def bars(df: DataFrame, x: str, y: str) -> DataFrame:
    """D-8: a bar chart's rows in the report's order: ``x``, ``y`` and the position of the bar."""
    place = Window.orderBy(F.desc(y), x)             # one row per bar: a report's few groups
    return df.select(F.col(x).alias("x"), F.col(y).cast("double").alias("y"),
                     F.row_number().over(place).alias("position"))


def top_bars(df: DataFrame, n: int, label: str, count: str) -> DataFrame:
    """D-8: the ``n`` longest bars of a lying bar chart, the longest drawn on top (last position)."""
    top = df.orderBy(F.desc(count), label).limit(n)
    place = Window.orderBy(count, F.desc(label))
    return top.select(F.col(count).alias("x"), F.col(label).alias("y"), F.row_number().over(place).alias("position"))


def bars_with_text(df: DataFrame, x: str, y: str, order: list[str]) -> DataFrame:
    """D-8: bars in a fixed order of labels, with the value as text of two digits."""
    ranked = with_category_rank(df, x, order, "position")
    return ranked.select(F.col(x).alias("x"), F.col(y).cast("double").alias("y"),
                         F.format_string("%.2f", F.col(y).cast("double")).alias("text"),
                         F.col("taxi_trips").alias("hover_trips"), "position").orderBy("position")


def revenue_lines(revenue_by_month: DataFrame) -> DataFrame:
    """D-8: one line per year over the months in calendar order."""
    return revenue_by_month.select(F.col("month_name").alias("x"), F.col("revenue").alias("y"),
                                   F.col("year").cast("string").alias("colour"),
                                   F.col("month_num").alias("position")).orderBy("colour", "position")
