import math

import numpy as np

from cabmart.llm import ann_search as N, exact_search as X
from cabmart.llm.stripes import keep_best
from conftest import SF_MIDDLE, SF_SMALL

ODD = [(1000, None), (1020, []), (1040, [1.0, None, 0.5]), (1060, [float("nan")] * 8), (1080, [float("inf")] * 8), (None, [0.1] * 8)]
KIND = "vec_id long, embedding array<float>"


def vectors(n=300, dim=8, seed=0, copies=40):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 0.3, (n, dim)).astype(np.float32)
    x[n // 2:n // 2 + copies] = x[0]                     # ties
    return [(i, [float(v) for v in x[i]]) for i in range(n)]


def test_exact_query_matches_sql(spark, queries):
    import __spark_entry__ as E
    from oracle_compare import compare, duck
    problems, n, _ = compare(spark, "op4", queries["op4_exact_search"], E.oracle_sql()["op4_exact_search"], SF_SMALL, duck(SF_SMALL))
    assert not problems and n > 0


def test_exact_search_in_many_blocks(spark):
    rows = vectors()
    df = spark.createDataFrame(rows + ODD, KIND).selectExpr("*", "1 AS id", "'v' AS vec")
    got = {}
    for r in X.search(df, k=7, every=20, stripe=40, group=4).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    whole = {i: [math.floor(64 * v) for v in vec] for i, vec in rows}
    assert set(got) == {i for i in whole if i % 20 == 0}
    for q, found in got.items():
        want = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:7]
        assert sorted(found) == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]


def clustered(n=4000, dim=64, clusters=50, seed=7):
    """Vectors around centres that differ in their segments' means."""
    rng = np.random.default_rng(seed)
    centre = np.repeat(rng.normal(0, 0.5, (clusters, dim // 8)), 8, axis=1)
    return centre[rng.integers(0, clusters, n)] + rng.normal(0, 0.1, (n, dim))


def test_bounds_spare_most_products_of_clustered_vectors():
    x = np.floor(64 * clustered())
    ids, taken = np.arange(len(x)), {}
    asked = ids % 20 == 0
    q, c, s = X.block_search(20, taken.__setitem__)(ids, x, ids[asked], x[asked])
    assert set(taken) == set(ids[asked].tolist())
    assert np.mean(list(taken.values())) < 0.2 * len(x)
    scores = x[asked] @ x.T
    for i, query in enumerate(ids[asked]):
        want = sorted((-v, j) for j, v in enumerate(scores[i]) if j != query)[:20]
        assert [(-v, j) for v, j in zip(s[q == query], c[q == query])] == want


def test_few_vectors_are_verified():
    """The share of vectors verified, on clustered vectors and on those of the driver's table."""
    for x, most in ((clustered(), 0.1), (table_vectors("/root/testdata/sf0.1"), 0.45)):
        ids, taken = np.arange(len(x)), {}
        asked = ids % 50 == 0
        q, c, _ = N.block_search(5, verified=taken.__setitem__)(ids, x, ids[asked], x[asked])
        unit = N.unit(x)
        hit = 0
        for query in ids[asked]:
            score = unit @ unit[query]
            score[query] = -2
            hit += len(set(np.argsort(-score, kind="stable")[:5]) & set(c[q == query]))
        assert hit >= 0.9 * 5 * asked.sum()
        assert np.mean(list(taken.values())) < most * len(x)


def table_vectors(sf):
    import pyarrow.parquet as pq
    return np.array(pq.read_table(f"{sf}/embeddings.parquet", columns=["embedding"])["embedding"].to_pylist(), dtype=np.float64)


def test_bounds_hold_and_large_values():
    rng = np.random.default_rng(3)
    a, b = np.floor(rng.normal(0, 50, (40, 21))), np.floor(rng.normal(0, 50, (30, 21)))
    for s in (1, 2, 4, 7, 10):
        assert (X.statistics(a, s) @ X.statistics(b, s).T >= a @ b.T - 1e-6).all()
    big = np.floor(rng.normal(0, 2.0 ** 29, (30, 4)))
    ids = np.arange(30)
    q, c, s = X.block_search(3)(ids, big, ids[:2], big[:2])
    for i in range(2):
        want = sorted((-sum(int(x) * int(y) for x, y in zip(big[i], big[j])), j) for j in range(30) if j != i)[:3]
        assert [(-int(v), int(j)) for v, j in zip(s[q == i], c[q == i])] == want


def test_fewer_candidates_than_k_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(0, [0.5, 0.5]), (0, [0.5, 0.5]), (3, [0.5, 0.1]), (4, [0.25])], KIND)
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in X.search(df).orderBy("rank").collect()] == [
        (0, 1, 3, 32 * 32 + 32 * 6), (0, 2, 4, 32 * 16)]
    assert [(r.query_id, r.vec_id) for r in N.search(df).orderBy("rank").collect()] == [(0, 3), (0, 4)]
    for s in (X, N):
        assert s.search(df.filter("false")).count() == 0
        assert s.search(spark.createDataFrame(ODD, KIND)).count() == 0


def nearest(rows, q, k):
    unit = {i: np.array(v, dtype=np.float64) for i, v in rows}
    a = unit[q]
    scores = sorted((-float(a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b))), i) for i, b in unit.items() if i != q)
    return scores[:k]


def recall(found, rows, k):
    hit = total = 0
    for q in found:
        want = nearest(rows, q, k)
        hit += len({i for _, i in want} & {i for i, _ in found[q]})
        total += len(want)
        assert [i for i, _ in found[q]] == [i for _, i in sorted((-s, i) for i, s in found[q])]
    return hit / total


def test_ann_query_recall(spark, queries, small):
    rows = small("embeddings", "vec_id, embedding", SF_MIDDLE)
    found = {}
    for r in queries["op8_ann_search"](spark, SF_MIDDLE).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(found) == {i for i, _ in rows if i % 50 == 0} and all(len(f) == 5 for f in found.values())
    assert recall(found, rows, 5) >= 0.9
    by = dict(rows)
    for q, f in found.items():
        for i, s in f:
            a, b = np.array(by[q], dtype=np.float64), np.array(by[i], dtype=np.float64)
            assert abs(s - a @ b / math.sqrt((a @ a) * (b @ b))) < 1e-12


def test_ann_in_many_blocks_with_odd_rows(spark):
    rows = vectors(n=400, dim=16, seed=4, copies=0)
    df = spark.createDataFrame(rows + ODD + [(1100, [0.0] * 16)], KIND)
    found = {}
    for r in N.search(df, stripe=64, group=3).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(found) == {i for i, _ in rows if i % 50 == 0}
    assert recall(found, rows, 5) >= 0.9


def test_stop_test_and_tree():
    rng = np.random.default_rng(5)
    x = (rng.standard_normal((200_000, 10)) ** 2).sum(axis=1)
    for at in (3.0, 9.0, 16.0):
        assert abs((x <= at).mean() - N.chi_square(np.array([at]), 10)[0]) < 0.005
    assert abs((x <= N.quantile(0.95, 10)).mean() - 0.95) < 0.005
    points = np.concatenate((rng.normal(0, 1, (500, 6)), np.zeros((300, 6))))        # many equal points
    leaves, low, high = N.kd_tree(points, leaf=16)
    assert sorted(np.concatenate(leaves).tolist()) == list(range(800)) and max(map(len, leaves)) <= 16
    for at, a, b in zip(leaves, low, high):
        assert (points[at] >= a).all() and (points[at] <= b).all()


def test_keep_best_ties():
    score, ids = np.array([5, 7, 5, 5, 7]), np.array([9, 4, 2, 8, 3])
    assert ids[keep_best(score, ids, 3)].tolist() == [3, 4, 2]
    assert ids[keep_best(score, ids, 9)].tolist() == [3, 4, 2, 8, 9]
