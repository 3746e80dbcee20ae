"""Exact top-k search by inner product of integer vectors (operator 4).

Multi-resolution segment statistics: a vector is cut into segments of equal
length L, of which the mean and the deviation are kept, for a few segments
first, then for more.  For two vectors

    distance^2 >= sum over segments of L * ((mean - mean')^2 + (dev - dev')^2)

and as q.c = (|q|^2 + |c|^2 - distance^2) / 2, that lower bound of the
distance is an upper bound of the inner product.  In every block the bounds
are taken from coarse to fine; at every level the pairs of the largest bounds
are scored exactly, which raises the k-th best score found so far; a pair whose
bound is below it is dropped.  Each query's products are computed for its own
survivors alone.  No pair is dropped on equal scores, so ties are decided
exactly.  How many pairs survive depends on the vectors: few where they form
clusters, most where their segments hardly differ.

Defined results: rows without an id and vectors that are null, empty or hold
null or non-finite components take no part; shorter vectors count as filled
up with zeros; a candidate with the query's id is the query's own; repeated
rows are candidates each for itself, a repeated query is asked once; an empty
table gives no rows.  Products that a long cannot hold raise an error.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .stripes import best_per_query, keep_best, usable

#: Rows of a block of candidates and of queries, and queries handled at once within it.
STRIPE, GROUP, AT_ONCE = 4096, 16_384, 64


def levels(dim: int) -> list[int]:
    """Numbers of segments, coarse to fine; the finest have at least two components."""
    return [s for s in (4, 8, 16, 32, 64, 128, 256) if 2 * s <= dim]


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, each times the root of the segment's length.

    The product of two such rows bounds the inner product from above.
    """
    n, dim = x.shape
    length = -(-dim // segments)
    padded = np.zeros((n, segments * length))
    padded[:, :dim] = x                                  # zeros change neither product nor bound
    parts = padded.reshape(n, segments, length)
    return np.concatenate((parts.mean(axis=2), parts.std(axis=2)), axis=1) * np.sqrt(length)


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers of any size."""
    whole = np.frompyfunc(int, 1, 1)
    return whole(q) @ whole(c).T


def block_search(k: int, multiplied=lambda query, n: None):
    """``multiplied(query id, n)`` is told how many exact products of a query were taken after the last level."""
    def search(cand_ids, cand, query_ids, queries):
        steps = [(statistics(cand, s), statistics(queries, s)) for s in levels(cand.shape[1])]
        exact = lambda q, c: np.rint(c @ q).astype(np.int64)
        most = float(np.abs(cand).max(initial=0) * np.abs(queries).max(initial=0)) * cand.shape[1]
        if most >= 2.0 ** 53:                            # beyond doubles: whole numbers of any size
            exact = lambda q, c: products(q[None], c)[0]
        out = []
        # Queries alike in their coarsest statistics are handled at once, since they keep the same candidates.
        alike = np.lexsort(steps[0][1].T) if steps else np.arange(len(queries))
        for at in range(0, len(queries), AT_ONCE):
            part = alike[at:at + AT_ONCE]
            floor = np.full(len(part), -np.inf)
            alive = query_ids[part, None] != cand_ids[None, :]
            columns = np.arange(len(cand_ids))
            for of_cand, of_query in steps:
                bound = of_query[part] @ of_cand[columns].T
                bound += 1e-6 * (1 + np.abs(bound))
                alive &= bound >= floor[:, None]
                if len(columns) > 2 * k:
                    # The floor is raised by exact scores of the candidates with the largest bounds.
                    first = np.argpartition(np.where(alive, bound, -np.inf), -2 * k, axis=1)[:, -2 * k:]
                    for i, c in enumerate(first):
                        c = c[alive[i, c]]
                        if len(c) >= k:
                            score = exact(queries[part[i]], cand[columns[c]])
                            floor[i] = max(floor[i], float(np.partition(score, len(c) - k)[len(c) - k]))
                    alive &= bound >= floor[:, None]
                used = alive.any(axis=0)
                if not used.all():
                    columns, alive = columns[used], alive[:, used]
            for i, q in enumerate(part):
                mine = columns[alive[i]]
                multiplied(query_ids[q], len(mine))
                score = exact(queries[q], cand[mine])
                best = keep_best(score, cand_ids[mine], k)
                out.append((np.full(len(best), query_ids[q]), cand_ids[mine[best]], score[best]))
        return tuple(np.concatenate([o[n] for o in out]).astype(np.int64) for n in range(3))

    return search


def search(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, id_col: str = "vec_id",
           vec_col: str = "embedding", stripe: int = STRIPE, group: int = GROUP) -> DataFrame:
    """The ``k`` candidates with the largest integer inner product, for every row whose id ``every`` divides.

    Components become floor(scale * x).  Columns: query_id, rank, vec_id, score (long).
    """
    rows = usable(vectors, id_col, vec_col)
    whole = rows.select("id", F.transform("vec", lambda x: F.floor(F.lit(float(scale)) * x).cast("double")).alias("vec"))
    return best_per_query(whole, F.col("id") % every == 0, block_search(k), k, "long", stripe, group)
