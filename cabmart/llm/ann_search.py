"""Approximate nearest neighbours by cosine (operator 8).

Vectors are scaled to length one, where the largest cosine is the smallest
distance, and projected to ``DIMS`` dimensions by a fixed matrix of normal
(2-stable) numbers.  Each block of vectors is indexed by a kd-tree over the
projections.  For a query, points come one after another in the order of their
distance in the projection, and are verified by their true distance, k at
first, then more at a time.  The leaf nearest to the query is verified before
all; what it gives bounds the leaves to open (by the distance of their boxes)
and the points that can come at all.  As projected^2 / true^2 follows a chi-square law with ``DIMS``
degrees, a vector nearer than the k-th best found so far, at distance d, has a
projection within r of the query's with probability chi2(r^2 / d^2); the
search stops once that reaches ``SURE`` for the next point's distance r, that is
once r^2 reaches d^2 times the law's quantile.

Every row is indexed, and there is no cap on how many are verified.  The
returned scores are the cosines of the original vectors.

Defined results: rows without an id and vectors that are null, empty, zero or
hold null or non-finite components take no part; shorter vectors count as
filled up with zeros; a candidate with the query's id is the query's own;
repeated rows are candidates each for itself, a repeated query is asked once;
an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .stripes import best_per_query, keep_best, usable

#: Dimensions of the projection (even), and how sure the search must be to stop.
DIMS, SURE = 32, 0.95
#: Vectors of a leaf, most points verified between two tests, rows of a block of candidates and of queries,
#: queries handled at once.
LEAF, AT_ONCE, STRIPE, GROUP, TOGETHER = 32, 64, 8192, 16_384, 64


def chi_square(x: np.ndarray, dims: int) -> np.ndarray:
    """Distribution function for an even number of degrees of freedom."""
    half = np.minimum(x / 2, 700.0)
    tail = sum(half ** i / math.factorial(i) for i in range(dims // 2))
    return 1 - np.exp(-half) * tail


def quantile(sure: float, dims: int) -> float:
    """The value that a chi-square number does not pass by a probability of ``sure``."""
    low, high = 0.0, 20.0 * dims + 200
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(np.array(middle), dims) < sure else (low, middle)
    return high


def projection(dim: int, dims: int = DIMS) -> np.ndarray:
    return np.random.default_rng(20_24).standard_normal((dim, dims))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def kd_tree(points: np.ndarray, leaf: int = LEAF) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The leaves (places of their points) and corners of their boxes; cut at the median of the widest side."""
    leaves, todo = [], [np.arange(len(points))]
    while todo:
        at = todo.pop()
        if len(at) <= leaf:
            leaves.append(at)
            continue
        side = np.argmax(np.ptp(points[at], axis=0))
        at = at[np.argpartition(points[at, side], len(at) // 2)]
        todo += [at[:len(at) // 2], at[len(at) // 2:]]
    return (leaves, np.array([points[at].min(axis=0) for at in leaves]),
            np.array([points[at].max(axis=0) for at in leaves]))


def block_search(k: int, dims: int = DIMS, sure: float = SURE, verified=lambda query, n: None):
    """``verified(query id, n)`` is told how many vectors were verified for a query."""
    reach = quantile(sure, dims)

    def limit(best: np.ndarray) -> float:
        """The squared projected distance from which on the test stops a search."""
        return reach * max(2 - 2 * float(best[0]), 1e-300) if best[0] > -np.inf else np.inf

    def search(cand_ids, cand, query_ids, queries):
        cand_unit, query_unit = unit(cand), unit(queries)
        matrix = projection(cand.shape[1], dims)
        near, asked = cand_unit @ matrix, query_unit @ matrix
        leaves, low, high = kd_tree(near)
        place = np.concatenate(leaves)                   # from here on, the vectors lie leaf by leaf
        first = np.cumsum([0] + [len(at) for at in leaves])
        leaf = np.repeat(np.arange(len(leaves)), np.diff(first))
        near, ids, exact = near[place], cand_ids[place], cand[place]
        rough_unit, rough_query = cand_unit[place].astype(np.float32), query_unit.astype(np.float32)
        square = np.einsum("pd,pd->p", near, near)
        out = []
        for begin in range(0, len(queries), TOGETHER):
            part = np.arange(begin, min(begin + TOGETHER, len(queries)))
            gap = np.maximum(0, np.maximum(low[None] - asked[part, None], asked[part, None] - high[None]))
            boxes = np.einsum("qld,qld->ql", gap, gap)
            nearest, seeds = boxes.argmin(axis=1), []
            limits = np.empty(len(part))
            for i, q in enumerate(part):                 # the nearest leaf gives a first k-th best
                at = np.arange(first[nearest[i]], first[nearest[i] + 1])
                at = at[ids[at] != query_ids[q]]
                cosine = rough_unit[at] @ rough_query[q]
                best = np.partition(np.concatenate((np.full(k, -np.inf), cosine)), -k)[-k:]
                limits[i] = limit(best)
                seeds.append((at, cosine, best))
            # Leaves that one of the queries opens, and the projected distances of their points.
            opened = np.flatnonzero((boxes < limits[:, None]).any(axis=0)[leaf])
            apart = square[opened] - 2 * (asked[part] @ near[opened].T) + (asked[part] ** 2).sum(axis=1)[:, None]
            for i, q in enumerate(part):
                at, cosine, best = seeds[i]
                found, scores, most = [at], [cosine], k
                next_ones = np.flatnonzero((apart[i] < limits[i]) & (leaf[opened] != nearest[i]) & (ids[opened] != query_ids[q]))
                next_ones = next_ones[np.argsort(apart[i, next_ones], kind="stable")]
                far, held, done = apart[i, next_ones], opened[next_ones], 0
                while (within := np.searchsorted(far, limit(best))) > done:      # all before it pass the test so far
                    take = held[done:min(done + most, within)]
                    cosine = rough_unit[take] @ rough_query[q]
                    best = np.partition(np.concatenate((best, cosine)), -k)[-k:]
                    found.append(take)
                    scores.append(cosine)
                    done, most = done + len(take), min(2 * most, AT_ONCE)
                at, rough = np.concatenate(found), np.concatenate(scores)
                verified(query_ids[q], len(at))
                if not len(at):
                    continue
                # Scores of the nearest (and of what rounding may have put beside them) from the vectors as given.
                at = at[rough >= best[0] - 1e-5]
                score = cosines(exact[at], queries[q])
                pick = keep_best(score, ids[at], k)
                out.append((np.full(len(pick), query_ids[q]), ids[at[pick]], score[pick]))
        if not out:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        return tuple(np.concatenate([o[n] for o in out]) for n in range(3))

    return search


def cosines(cand: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosine in double precision (components beyond 1e100 or below 1e-100 are scaled first)."""
    for x in (cand, query):
        top = np.abs(x).max(initial=0)
        if top > 1e100 or np.abs(x).max(axis=-1).min(initial=1) < 1e-100:
            cand = cand / np.abs(cand).max(axis=1, keepdims=True)
            query = query / np.abs(query).max()
            break
    return (cand @ query) / (np.sqrt((cand * cand).sum(axis=1)) * np.sqrt(query @ query))


def search(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding",
           stripe: int = STRIPE, group: int = GROUP) -> DataFrame:
    """The ``k`` nearest found by cosine for every row whose id ``every`` divides.

    Columns: query_id, rank, vec_id, score (double).
    """
    rows = usable(vectors, id_col, vec_col, zero=False)
    return best_per_query(rows, F.col("id") % every == 0, block_search(k), k, "double", stripe, group)
