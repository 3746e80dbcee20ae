"""Table operators: dedup, keys, lookups, upserts, marks, schema policy, SCD2, quality."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window, functions as F

from cabmart.operators import (keep_first, assign_keys, lookup, upsert_by_key, after_event_mark,
                               empty_watermarks, set_mark, read_mark, sync_schema, require_newer, number_in_buckets, scd2_apply,
                               scd2_initial, quality_summary, unique_violations, not_null_violations,
                               broadcast_if_small, check_models)

TS1, TS2 = dt.datetime(2024, 6, 1), dt.datetime(2024, 7, 1)


def test_keep_first_matches_row_number(spark):
    rnd = random.Random(7)
    rows = [(rnd.randint(0, 20), rnd.choice([None, "a", "b", "c"]), rnd.choice([None, 1.0, 2.0, 3.0]),
             rnd.choice(["x", "y"])) for _ in range(400)]
    # one hot key holding a third of the rows
    rows += [(99, rnd.choice(["a", "b", None]), rnd.random(), "z") for _ in range(200)]
    df = spark.createDataFrame(rows, "k int, s string, v double, o string")
    got = sorted(keep_first(df, ["k"], ["s", "v"]).collect())
    w = Window.partitionBy("k").orderBy(F.col("s").asc_nulls_last(), F.col("v").asc_nulls_last(),
                                        F.col("o").asc_nulls_first())
    want = sorted(df.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn").collect())
    assert got == want
    got_d = sorted(keep_first(df, ["k"], ["v"], descending=True).collect())
    w = Window.partitionBy("k").orderBy(F.col("v").desc_nulls_last(), F.col("s").desc_nulls_last(),
                                        F.col("o").desc_nulls_last())
    want_d = sorted(df.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn").collect())
    assert got_d == want_d


def test_assign_keys_dense_and_ordered(spark):
    df = spark.range(0, 500).select((F.col("id") % 3).alias("day"), (F.col("id") * 7 % 500).alias("x"))
    rows = assign_keys(df, ["day", "x"], "key", start=10).orderBy("key").collect()
    assert [r.key for r in rows] == list(range(11, 511))
    assert [(r.day, r.x) for r in rows] == sorted((r.day, r.x) for r in rows)


def test_number_in_buckets_with_a_large_group_of_copies(spark):
    hot = spark.range(0, 3000).select(F.lit(1).alias("day"), F.lit(7).alias("x"))   # 3000 copies
    rest = spark.range(0, 6000).select((F.col("id") % 3).alias("day"), F.col("id").alias("x"))
    nulls = spark.createDataFrame([(None, 5), (0, None)], "day long, x long")
    df = hot.unionByName(rest).unionByName(nulls)
    keyed = number_in_buckets(df, [F.col("day"), F.col("x") % 4], ["x"], "key", start=5)
    rows = keyed.orderBy("key").collect()
    assert [r.key for r in rows] == list(range(6, 9008))
    low = lambda v: (v is not None, v)
    order = [(low(r.day), low(None if r.x is None else r.x % 4), low(r.x)) for r in rows]
    assert order == sorted(order) and sum(r.day == 1 and r.x == 7 for r in rows) == 3001


def test_lookup_defaults_and_broadcast(spark):
    fact = spark.createDataFrame([(1,), (2,), (None,)], "fk int")
    dim = spark.createDataFrame([(1, 100)], "id int, key long")
    out = sorted(lookup(fact, dim, [("fk", "id")], {"k": ("key", -1)}).collect(),
                 key=lambda r: (r.fk is None, r.fk))
    assert [(r.fk, r.k) for r in out] == [(1, 100), (2, -1), (None, -1)]
    plan = broadcast_if_small(dim, max_rows=10)._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan.lower()


def test_upsert_replay_and_duplicates(spark):
    target = spark.createDataFrame([("a", 1), ("b", 1), (None, 1)], "id string, v int")
    batch = spark.createDataFrame([("b", 2), ("c", 2), ("c", 3)], "id string, v int")
    out = sorted(upsert_by_key(target, batch, ["id"]).collect(), key=lambda r: (r.id is None, str(r.id), r.v))
    assert [(r.id, r.v) for r in out] == [("a", 1), ("b", 2), ("c", 2), ("c", 3), (None, 1)]
    again = upsert_by_key(upsert_by_key(target, batch, ["id"]), batch, ["id"])
    assert sorted(again.collect(), key=str) == sorted(upsert_by_key(target, batch, ["id"]).collect(), key=str)


def test_event_marks(spark):
    rows = [(dt.datetime(2024, 1, d, 12),) for d in (1, 5, 9, 10)]
    df = spark.createDataFrame(rows, "t timestamp_ntz")
    mark = dt.datetime(2024, 1, 10, 0)
    look = after_event_mark(df, "t", mark, lookback="1 day")     # late row of the 9th is re-read
    assert look.count() == 2
    assert after_event_mark(df, "t", mark, strict=True).count() == 1
    assert after_event_mark(df, "t", None, lookback="1 day").count() == 4  # first run: floor 2000
    assert after_event_mark(df, "t", None, strict=True).count() == 4


def test_watermark_table(spark):
    m = empty_watermarks(spark)
    assert read_mark(m, "x") == dt.datetime(1900, 1, 1)
    m = set_mark(m, "x", TS1)
    m = set_mark(m, "y", TS1)
    m = set_mark(m, "x", TS2)
    assert m.count() == 2 and read_mark(m, "x") == TS2 and read_mark(m, "y") == TS1


def test_schema_policies(spark):
    target = spark.createDataFrame([(1, "old")], "a int, b string")
    batch = spark.createDataFrame([(1, 2.0)], "a long, newcol double")
    with pytest.raises(ValueError):
        sync_schema(target, batch, "fail")
    t, b = sync_schema(target, batch, "sync_all_columns")      # the target follows the source
    assert t.columns == b.columns == ["a", "newcol"] and t.schema["a"].dataType == batch.schema["a"].dataType
    assert t.collect()[0].newcol is None
    t, b = sync_schema(target, batch, "merge")                 # nothing is lost on either side
    assert t.columns == b.columns == ["a", "b", "newcol"] and b.collect()[0].b is None
    t, b = sync_schema(target, batch, "ignore")
    assert t.columns == b.columns == ["a", "b"]


def test_load_times_must_grow(spark):
    marks = set_mark(empty_watermarks(spark), "x", TS1)
    require_newer(marks, TS2)
    require_newer(None, TS1)
    for again in (TS1, dt.datetime(2024, 5, 1)):
        with pytest.raises(ValueError, match="not later"):
            require_newer(marks, again)


def _dim(spark, rows, ts):
    return spark.createDataFrame([(i, n, ts) for i, n in rows],
                                 "id_vendor int, vendor_name string, ods_update_time timestamp_ntz")


SCD = dict(keys=["id_vendor"], tracked=["vendor_name"], key_col="key_vendor")


def test_scd2_scenarios(spark):
    first = scd2_apply(None, _dim(spark, [(1, "A"), (2, "B"), (3, None)], TS1), **SCD)
    assert first.filter("is_current").count() == 3
    same = scd2_apply(first, _dim(spark, [(1, "A"), (2, "B"), (3, None)], TS2), **SCD)
    assert sorted(same.collect()) == sorted(first.collect())                      # no change
    changed = scd2_apply(first, _dim(spark, [(1, "A"), (2, "B2"), (3, "C"), (4, "D")], TS2), **SCD)
    rows = {(r.id_vendor, r.is_current): r for r in changed.collect()}
    assert rows[(2, False)].valid_to == TS2 and rows[(2, True)].vendor_name == "B2"
    assert rows[(3, False)].vendor_name is None and rows[(3, True)].vendor_name == "C"  # NULL -> value
    assert rows[(4, True)].key_vendor == 6 and changed.count() == 6
    assert sorted(r.key_vendor for r in changed.collect()) == [1, 2, 3, 4, 5, 6]
    with pytest.raises(ValueError):
        scd2_apply(first, _dim(spark, [(1, "A"), (1, "Z")], TS2), **SCD)


def test_quality(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "b")], "id int, s string")
    s = {r.column_name: r for r in quality_summary(df, "t", ["id", "s"]).collect()}
    assert (s["id"].n_null, s["id"].n_duplicate, s["id"].passed) == (0, 1, False)
    assert (s["s"].n_null, s["s"].n_duplicate) == (1, 0)
    assert unique_violations(df, "id").collect()[0].n_rows == 2
    assert not_null_violations(df, "s").count() == 1


def test_quality_summary_multiplies_no_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, None)], "id int, s string")
    plan = quality_summary(df, "t", ["id", "s"])._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
    got = check_models({"m": df}, {"m": ["id"]}).collect()
    assert [(r.table_name, r.n_duplicate, r.passed) for r in got] == [("m", 1, False)]
    assert quality_summary(df.filter("false"), "t", ["id"]).collect()[0].n_rows == 0
