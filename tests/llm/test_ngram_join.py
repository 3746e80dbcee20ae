import random
from collections import defaultdict

import numpy as np
import pytest

from cabmart.llm import ngram_join as J
from cabmart.llm.components import components
from conftest import SF_SMALL
from plain import group_rows, shingle_set


def corpus(seed, n=60):
    """Texts with copies, chains of near copies, a shared passage and common phrases."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["the", "of"] * 20
    passage = " ".join(rnd.choices(vocabulary, k=60))
    texts = [" ".join(rnd.choices(vocabulary, k=rnd.randrange(1, 120))) for _ in range(n)]
    texts += [t + " " + passage for t in texts[:15]]
    texts += [" ".join(rnd.choices(("the", "of"), k=rnd.randrange(2, 30))) for _ in range(20)]
    base = rnd.choices(vocabulary, k=150)
    for i in range(40):                                   # a chain that drifts away from its first text
        base = base[:]
        for _ in range(rnd.choice((0, 1, 2, 4))):
            base[rnd.randrange(150)] = f"edit{rnd.randrange(999)}"
        texts.append(" ".join(base))
    texts += [rnd.choice(texts).upper().replace(" ", "\t\n") for _ in range(30)]
    rnd.shuffle(texts)
    return list(enumerate(texts))


def expected(rows, n, percent):
    sizes, group = group_rows(rows, n, percent)
    least = {}
    for (i, _), g in zip(rows, group):
        least[g] = min(least.get(g, i), i)
    return {i: (s, least[g] if s else i) for (i, _), s, g in zip(rows, sizes, group)}


@pytest.mark.parametrize("seed, n, percent, frequent", [(1, 4, 85, 64), (2, 5, 80, 3), (3, 2, 60, 2), (4, 1, 70, 4)])
def test_against_plain_python(spark, monkeypatch, seed, n, percent, frequent):
    monkeypatch.setattr(J, "FREQUENT", frequent)         # few groups make a token frequent: pairs of tokens are used
    monkeypatch.setattr(J, "MINHASHES", 1)               # weak first links leave the rest to the exact index
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.join(df, n, percent).collect()}
    assert got == expected(rows, n, percent)


def test_query(spark, queries, small):
    rows = small("documents", "doc_id, text")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries["op10_ngram_join"](spark, SF_SMALL).collect()}
    assert got == expected(rows, 4, 85)


def test_shingles_and_signatures():
    texts = ["", " \t", "one", "One two THREE", "a b c d a b c d a b c d", "x y", "x y z", "É b c d", "é b c d"]
    text, gram = J.shingles([t.encode() for t in texts], 4)
    assert np.bincount(text, minlength=len(texts)).tolist() == [len(shingle_set(t, 4)) for t in texts]
    assert gram[text == 7] != gram[text == 8]            # only A-Z is lower-cased
    bounds = J._bounds(text, len(texts))
    assert len(set(J.signatures(gram, bounds)[2:].tolist())) == 7


def test_edge_cases(spark):
    long = " ".join(f"t{i % 977} u{i % 983}" for i in range(60_000))
    rows = [(5, "a b c d e f"), (2, "A b\tc d e f"), (None, "a b c d e f"), (7, None), (8, ""), (9, " \n "), (7, "other words are here now"),
            (3, "one two"), (4, "one two"), (6, "one"), (1, long), (0, long + " end"), (5, "a b c d e f"), (None, "lone text with no id at all")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS node", "'v' AS version", "2 AS number")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.join(df).collect()), key=str)
    want = [(5, 3, 2), (2, 3, 2), (None, 3, 2), (7, 0, 7), (8, 0, 8), (9, 0, 9), (7, 2, 7), (3, 1, 3), (4, 1, 3), (6, 1, 6),
            (1, got[1][1], 0), (0, got[0][1], 0), (5, 3, 2), (None, 4, None)]
    assert got == sorted(want, key=str)
    assert J.join(df.filter("false")).count() == 0
    left = J.one_of_each(df, 4, 85)
    assert left.columns == df.columns
    kept = sorted(((r.doc_id, r.text) for r in left.collect()), key=str)
    assert kept == sorted([(2, "A b\tc d e f"), (7, None), (8, ""), (9, " \n "), (7, "other words are here now"), (3, "one two"),
                           (6, "one"), (0, long + " end"), (None, "lone text with no id at all")], key=str)
    assert J.one_of_each(df.filter("false")).count() == 0


def test_near_copies_without_ids_and_one_id_on_many_texts(spark):
    def words(name, n=60):
        return " ".join(f"{name}{i}" for i in range(n))

    more = words("more", 6)
    chain = [f"{words('b')} {more}", words("b"), f"{more} {words('b')}"]        # the ends are linked by the middle alone
    rows = [(1, words("a")), (None, words("a") + " x"), (2, chain[0]), (3, chain[2]), (None, words("c")), (None, words("c") + " x")]
    rows += [(None, chain[1])] * 3 + [(9, words(f"t{i}x")) for i in range(30)] + [(10, words("t5x") + " x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.join(df).collect()), key=str)
    want = [(1, 57, 1), (None, 58, 1), (2, 63, 2), (3, 63, 2), (None, 57, None), (None, 58, None)]
    assert got == sorted(want + [(None, 57, 2)] * 3 + [(9, 57, 9)] * 30 + [(10, 58, 9)], key=str)
    kept = [tuple(r) for r in J.one_of_each(df, 4, 85).collect()]
    lone = [r for r in kept if r[0] is None]
    assert len(lone) == 1 and lone[0] in rows[4:6]
    assert sorted(r for r in kept if r[0] is not None) == sorted([rows[0], rows[2]] + [r for r in rows if r[0] == 9])


def test_components(spark):
    rnd = random.Random(9)
    edges = [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 260)] + [(-5, 7), (7, 8), (3, 3)]
    edges += [(rnd.randrange(1000, 1200), rnd.randrange(1000, 1200)) for _ in range(90)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    size = defaultdict(int)
    for x in up:
        size[root(x)] += 1
    assert got == {x: root(x) for x in up if size[root(x)] > 1}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_index_is_split_without_a_join(spark, monkeypatch):
    """A set's tokens are told apart by an aggregation: no join makes a row for every row of the index."""
    monkeypatch.setattr(J, "FREQUENT", 3)
    rows = [(1, 9, 1, 0, 70, 2), (1, 9, 1, 1, 71, 3), (1, 9, 1, 4, 72, 5), (1, 9, 1, 3, 73, 2), (2, 8, 2, 0, 70, 2), (3, 7, 1, 2, 71, 3)]
    df = spark.createDataFrame(rows, "node long, n int, comp long, pos int, key int, groups long")
    split = J._by_set(df)
    got = {r.node: (r.n, r.comp, [tuple(t) for t in r.often], [tuple(t) for t in r.alone]) for r in split.collect()}
    assert got == {1: (9, 1, [(1, 71), (4, 72)], [(0, 70), (3, 73)]), 2: (8, 2, [], [(0, 70)]), 3: (7, 1, [(2, 71)], [])}

    plans, cut = [], J.cut
    monkeypatch.setattr(J, "cut", lambda df, name: cut(df, name) if not plans.append(df._jdf.queryExecution().optimizedPlan().toString()) else None)
    prefixed = spark.createDataFrame([(i, 4, 0, [1, 2, 3, 10 + i]) for i in range(6)], "node long, n int, common int, keys array<int>")
    groups = spark.createDataFrame([(0, 0), (1, 0)], "node long, comp long")
    pairs = J.candidates(prefixed, groups, 60)
    assert {(r.a, r.b) for r in pairs.collect()} == {(a, b) for a in range(6) for b in range(a)} - {(1, 0)}
    later = [*plans[1:], pairs._jdf.queryExecution().optimizedPlan().toString()]     # (the first has the groups, a row for each set)
    assert len(plans) == 2 and not any("LeftOuter" in p for p in later)


def test_rounds_of_components_give_back_the_one_before(spark, monkeypatch):
    """Of a long path's rounds only the last one's edges are left."""
    import os
    from cabmart.llm import components as K
    made, cut = [], K.cut
    monkeypatch.setattr(K, "cut", lambda df, name: (made.append(cut(df, name)), made[-1])[1])
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.comp for r in K.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    files = [[f.removeprefix("file:").replace("///", "/") for f in frame.inputFiles()] for frame in made]
    assert len(files) > 3 and all(map(os.path.exists, files[-1]))
    assert not any(os.path.exists(f) for some in files[:-1] for f in some)
