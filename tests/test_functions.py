"""Row-level rules: rounding, casts, text cleaning, bins, calendar attributes."""

import datetime as dt
import decimal

from pyspark.sql import functions as F

from cabmart import functions as X
from cabmart.functions.bins import BINS, bin_column


def one_col(spark, values, expr, ddl="x double"):
    df = spark.createDataFrame([(v,) for v in values], ddl)
    return [r[0] for r in df.select(expr).collect()]


def test_dec2_rounds_binary_value(spark):
    vals = [0.125, 1.005, 0.285, 1.015, 2.345, 0.145, 10.075, -0.125]
    want = ["0.13", "1.00", "0.28", "1.01", "2.35", "0.14", "10.07", "-0.13"]
    got = one_col(spark, vals, X.dec2("x"))
    assert got == [decimal.Decimal(w) for w in want]


def test_int_cast_half_even(spark):
    assert one_col(spark, [1.5, 2.5, -1.5, 3.5, None], X.int_half_even("x")) == [2, 2, -2, 4, None]


def test_clamp_zero(spark):
    got = one_col(spark, [-1.5, 0.0, None, 3.0, float("nan")], X.clamp_zero("x"))
    assert got[:4] == [0.0, 0.0, 0.0, 3.0]
    assert got[4] != got[4]  # NaN stays NaN


def test_safe_div_null_on_zero(spark):
    df = spark.createDataFrame([(1.0, 0.0), (3.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(X.safe_div("a", "b")).collect()] == [None, 1.5]


def test_normalize_text(spark):
    vals = ["  a   b   c ", "", "   ", None, "a\tb", "Staten  Island"]
    allrun = one_col(spark, vals, X.normalize_text("x", lower=True), "x string")
    assert allrun == ["a b c", None, None, None, "a b", "staten island"]
    first = one_col(spark, ["a  b  c", "x\n\ny z"], X.normalize_text("x", first_only=True), "x string")
    assert first == ["a b  c", "x y z"]


def test_weather_bins_edges(spark):
    src, rules, other = BINS["temperature_category"]
    vals = [-10.01, -10.0, -0.01, 0.0, 9.99, 10.0, 19.99, 20.0, 29.99, 30.0, 34.99, 35.0, None]
    got = one_col(spark, vals, bin_column("x", rules, other))
    assert got == ["Extreme Cold", "Freezing", "Freezing", "Cold", "Cold", "Mild", "Mild", "Warm",
                   "Warm", "Hot", "Hot", "Extreme Heat", "Extreme Heat"]
    _, rules, other = BINS["rain_intensity"]
    got = one_col(spark, [0.0, -1.0, 2.49, 2.5, 9.99, 10.0, 49.9, 50.0, None], bin_column("x", rules, other))
    assert got == ["No Rain", "Light Rain", "Light Rain", "Moderate Rain", "Moderate Rain",
                   "Heavy Rain", "Heavy Rain", "Violent Rain", "Violent Rain"]
    _, rules, other = BINS["wind_intensity"]
    got = one_col(spark, [0.0, 18.9, 19.0, 37.9, 38.0, 60.9, 61.0], bin_column("x", rules, other))
    assert got == ["No Wind", "Light Wind", "Moderate Wind", "Moderate Wind", "Strong Wind",
                   "Strong Wind", "Very Strong Wind"]
    _, rules, other = BINS["snow_intensity"]
    assert one_col(spark, [0.0, 0.49, 0.5, 3.99, 4.0], bin_column("x", rules, other)) == [
        "No Snow", "Light Snow", "Moderate Snow", "Moderate Snow", "Heavy Snow"]
    assert one_col(spark, [None, 0.0, 0.1], X.positive_flag("x")) == [False, False, True]


def test_time_of_day(spark):
    hours = [4, 5, 11, 12, 15, 16, 19, 20, 23, 0]
    got = one_col(spark, hours, X.time_of_day("x"), "x int")
    assert got == ["Late Night", "Morning Rush", "Morning Rush", "Midday", "Midday", "Evening Rush",
                   "Evening Rush", "Night", "Night", "Late Night"]


def test_calendar_attributes(spark):
    days = [dt.date(2024, 2, 29), dt.date(2024, 12, 30), dt.date(2024, 6, 2), dt.date(2024, 6, 1),
            dt.date(2024, 1, 1), dt.date(2024, 7, 4), dt.date(2024, 11, 11), dt.date(2024, 12, 25)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    rows = df.select(X.date_key("d"), X.day_name("d"), X.month_name("d"), X.iso_week("d"),
                     X.day_of_week0("d"), X.is_weekend("d"), X.season("d"), X.holiday_name("d"),
                     X.is_holiday("d")).collect()
    assert tuple(rows[0][:4]) == (20240229, "thursday", "february", 9)
    assert rows[1][3] == 1 and rows[1][0] == 20241230          # ISO week 1 of the next year
    assert rows[2][4] == 0 and rows[2][5] is True               # Sunday
    assert rows[3][4] == 6 and rows[3][5] is True               # Saturday
    assert [r[7] for r in rows[4:]] == ["New Year's Day", "Independence Day", "Veterans Day",
                                        "Christmas Day"]
    assert [r[6] for r in rows[:4]] == ["Winter", "Winter", "Summer", "Summer"]
    assert rows[0][7] is None and rows[0][8] is False


def test_minutes_and_time_text(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 8, 0, 0), dt.datetime(2024, 1, 1, 8, 30, 30))],
                               "a timestamp_ntz, b timestamp_ntz")
    r = df.select(X.minutes_between("a", "b"), X.time_text("b"), X.hour_of("b"),
                  X.truncate_to_hour("b")).first()
    assert r[0] == 30.5 and r[1] == "08:30:30" and r[2] == 8
    assert r[3] == dt.datetime(2024, 1, 1, 8, 0, 0)


def test_hash_and_ids(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), None)], "v int, a timestamp_ntz, b timestamp_ntz")
    r = df.select(X.unknown_hash(), X.trip_id("v", "a", "b"), X.weather_id(F.lit(None).cast("string"), "a")).first()
    assert r[0] == "b23a6a8439c0dde5515893e7c90c1e3233b8616e634470f20dc4928bcf3609bc"
    assert r[1] == "1_2024-01-01 00:00:00"
    assert r[2] == r[0] + "_2024-01-01 00:00:00"


def test_reference_date_range(spark):
    from cabmart.plans import mart
    dd = mart.dm_date(spark)                     # 2024-01-01 .. 2050-12-31, both ends
    assert dd.count() == 9862
    r = dd.agg(F.min("key_date"), F.max("key_date"), F.sum(F.col("is_holiday").cast("int"))).first()
    assert (r[0], r[1], r[2]) == (20240101, 20501231, 27 * 4)
