"""A set of query vectors against all vectors, in blocks (shared by the two searches).

Candidates are dealt by a hash of their id into stripes of about ``stripe``
rows, queries into groups of about ``group`` rows; every stripe meets every
group in one task, which holds both as matrices.  The sizes are parameters, so
a task's memory does not depend on the size of the table, nor on the vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F


def usable(df: DataFrame, id_col: str, vec_col: str, zero: bool = True) -> DataFrame:
    """(``id``, ``vec`` array<double>) of the rows that take part.

    Left out are rows without an id, and vectors that are null, empty, or hold a
    null or a non-finite component; with ``zero=False`` also those of zeros alone.
    """
    vec = F.col(vec_col).cast("array<double>")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    keep = F.col(id_col).isNotNull() & vec.isNotNull() & (F.size(vec) > 0) & finite
    if not zero:
        keep &= F.exists(vec, lambda x: x != 0)
    return df.filter(F.coalesce(keep, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"))


def matrix(table: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a block; shorter vectors are filled up with zeros."""
    ids = table.column("id").to_numpy()
    lists = table.column("vec").combine_chunks()
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(ids) and (size == dim).all():
        return ids, flat.reshape(len(ids), dim)
    out = np.zeros((len(ids), dim))
    row = np.repeat(np.arange(len(ids)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return ids, out


def best_per_query(vectors: DataFrame, is_query: Column, search, k: int, score_type: str, stripe: int,
                   group: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best of each query over all stripes.

    ``vectors`` comes from ``usable``; ``search(cand_ids, cand, query_ids, queries)``
    gives arrays (query_id, vec_id, score) that hold at least the k best pairs of a
    block.  Higher scores are better, ties go to the smaller id.
    """
    queries = vectors.filter(is_query).dropDuplicates(["id", "vec"])
    rows, dim = vectors.agg(F.count("*"), F.max(F.size("vec"))).first()
    asked = queries.count()
    n_stripes, n_groups = max(1, -(-rows // stripe)), max(1, -(-asked // group))
    number = lambda n, seed: F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = (vectors.select("id", "vec", number(n_stripes, 1).cast("int").alias("s"))
            .select("id", "vec", "s", every(n_groups).alias("g")))
    right = (queries.select("id", "vec", number(n_groups, 2).cast("int").alias("g"))
             .select("id", "vec", "g", every(n_stripes).alias("s")))
    dim = dim or 1

    def block(key, cand: pa.Table, query: pa.Table) -> pa.Table:
        empty = [pa.array([], type=t) for t in (pa.int64(), pa.int64(), kind)]
        if not cand.num_rows or not query.num_rows:
            return pa.table(empty, names=["query_id", "vec_id", "score"])
        found = search(*matrix(cand, dim), *matrix(query, dim))
        return pa.table([pa.array(a, type=t) for a, t in zip(found, (pa.int64(), pa.int64(), kind))],
                        names=["query_id", "vec_id", "score"])

    kind = pa.int64() if score_type == "long" else pa.float64()
    found = (left.groupBy("s", "g").cogroup(right.groupBy("s", "g"))
             .applyInArrow(block, f"query_id long, vec_id long, score {score_type}"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def keep_best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: higher scores first, ties to the smaller id."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= least)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))][:k]
