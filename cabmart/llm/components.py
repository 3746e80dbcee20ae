"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut, drop

#: Far more than the rounds that any graph of long ids needs (they grow with the logarithm of its diameter).
MOST_ROUNDS = 100


def _mark(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """(``node``, ``comp``) of every node of the edges (``a``, ``b``); comp is the smallest node of the component.

    Each round is written to the shared folder, and what the one before it held is
    given back, files and memory.  Minima are taken by partial sums, so a node with
    very many neighbours does not load one task; joins on such a node are split by Spark.
    """
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
              "edges")
    mark = _mark(now)
    for _ in range(MOST_ROUNDS):
        if mark[0] == 0:
            break
        both = now.union(now.select(F.col("v"), F.col("u"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        last, now, before = now, cut(small, "edges"), mark
        drop(last)
        mark = _mark(now)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("node"), "comp").union(
        now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
