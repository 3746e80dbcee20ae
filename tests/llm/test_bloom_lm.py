import math
import os
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cabmart.llm import bloom_lm as M
from cabmart.llm.common import release, scratch_path
from conftest import SF_MIDDLE
from pyspark.sql import functions as F

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text):
    return WORDS.findall((text or "").encode().translate(LOWER)) + [None]


def level(c):
    return c.bit_length()


def mean(c):
    return (2 ** (level(c) - 1) + 2 ** level(c) - 1) / 2 if c else 0.0


def plain(rows, train, order):
    """[(n_tokens, n_known, N, base, score)] with exact levels; rows: (id, text), train: ids."""
    learned = [words(t) for (i, t), on in zip(rows, train) if on]
    ones = Counter(w for ws in learned for w in ws)
    total, rest = sum(ones.values()), sum(ones.values()) + 0.1 * (len(ones) + 1)

    def placed(ws):
        ws = [None] + ws
        for at in range(1, len(ws)):
            yield ws[at], [tuple(ws[at - n + 1:at + 1]) for n in range(2, order + 1) if n - 1 <= at]

    more = Counter(g for ws in learned for _, gs in placed(ws) for g in gs)

    def contexts(ws):
        for at, (w, gs) in enumerate(placed(ws)):
            for g in gs:
                c = ones[g[0]] if len(g) == 2 else mean(more[g[:-1]])
                if c > 0:
                    yield at, len(g), more[g], c

    seen, new = defaultdict(int), defaultdict(int)
    for ws in learned:
        for _, n, c, ctx in contexts(ws):
            key = n, int(math.floor(math.log2(ctx))) + 1
            seen[key] += 1
            new[key] += c <= 1
    out = []
    for _, t in rows:
        ws = words(t)
        p = [(ones[w] + 0.1) / rest for w in ws]
        base = sum(map(math.log10, p))
        for at, n, c, ctx in contexts(ws):
            key = n, int(math.floor(math.log2(ctx))) + 1
            g = (new[key] + 1) / (seen[key] + 2) if seen[key] else 1.0
            p[at] = (1 - g) * min(1.0, mean(c) / ctx) + g * p[at]
        out.append((len(ws), sum(ones[w] > 0 for w in ws), total, base, sum(map(math.log10, p))))
    return out


def corpus(seed, n=120):
    rnd = random.Random(seed)
    vocabulary = ["The", "the", "of", "é", "x,"] * 5 + [f"w{i}" for i in range(60)]
    fixed = [" ".join(rnd.choices(vocabulary, k=6)) for _ in range(5)]
    return [(i, "\t".join(rnd.choice(fixed) if rnd.random() < 0.3 else rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 40))))
            for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("order", [2, 3])
@pytest.mark.parametrize("broadcast", [M.BROADCAST, 0])
def test_against_plain_python(spark, monkeypatch, order, broadcast):
    """With an error that never happens the levels are exact; segments broadcast or asked for."""
    monkeypatch.setattr(M, "BROADCAST", broadcast)
    monkeypatch.setattr(M, "BLOCK", 700)
    rows = corpus(order)
    df = frame(spark, rows).repartition(4)
    model = M.fit(df, F.col("doc_id") % 4 != 0, order=order, error=1e-12)
    assert (model.shared is None) == (broadcast == 0)
    got = {r.doc_id: r[1:] for r in M.score(df, model).collect()}
    for (i, _), want in zip(rows, plain(rows, [i % 4 != 0 for i, _ in rows], order)):
        assert got[i][:3] == want[:3] and got[i][3:] == pytest.approx(want[3:], rel=1e-9)


def test_query(spark, queries, small):
    rows = small("documents", "doc_id, text", SF_MIDDLE)
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    got = {r.doc_id: r for r in queries["op11_bloom_lm"](spark, SF_MIDDLE).collect()}
    better, off = 0, []
    for (i, _), on, want in zip(rows, held, plain(rows, [not h for h in held], 2)):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (on, *want[:3])
        assert r.base_score == pytest.approx(want[3], rel=1e-9)
        better += r.score > r.base_score
        off.append(abs(r.score - want[4]) / abs(want[4]))
    assert len(got) == len(rows) and better > 0.98 * len(rows) and np.median(off) < 0.02


def test_levels_and_the_filter_error():
    assert M.level_of(np.array([1, 2, 3, 4, 7, 8, 2 ** 40 - 1, 2 ** 40])).tolist() == [1, 2, 2, 3, 3, 4, 40, 41]
    rnd = np.random.default_rng(1)
    low = rnd.choice(2 ** 32, 60_000, replace=False).astype("<u4")
    count = np.floor(2 ** rnd.exponential(1.5, 30_000)).astype(np.int64)
    body = np.frombuffer(M.build_bits(low[:30_000], count, 1 / 128), dtype=np.uint8)
    start, size = np.zeros(60_000, dtype=np.uint64), np.full(60_000, 8 * len(body), dtype=np.uint64)
    got = M.levels(low, body, start, size, 1 / 128)
    assert (got[:30_000] >= M.level_of(count)).all()                       # never too low
    assert (got[:30_000] > M.level_of(count)).mean() < 0.012 and (got[30_000:] > 0).mean() < 0.012
    assert 8 * len(body) < 10.2 * M.level_of(count).sum() + 100


def test_the_filter_grows_with_the_input(spark):
    small, large = (M.fit(frame(spark, [(i, " ".join(f"w{i}x{j}" for j in range(200))) for i in range(n)]), F.lit(True)) for n in (50, 200))
    assert 3.5 < large.n_bytes / small.n_bytes < 4.5


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b a b " * 40_000), (None, "never learned"), (5, "a b"), (5, "a b"), (6, "zz yy")]
    df = frame(spark, rows).selectExpr("*", "1 AS score", "'v' AS version", "2 AS id")
    train = [True, True, True, True, False, True, True, False]
    got = sorted((r[1:] for r in M.score(df, M.fit(df, F.col("doc_id") < 6, error=1e-9)).collect()), key=str)
    want = sorted(plain(rows, train, 2), key=str)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    for g, w in zip(got, want):
        assert g[3:] == pytest.approx(w[3:])
    untaught = M.score(df, M.fit(df, F.lit(False)))
    assert {r.score for r in untaught.collect()} == {0.0} and {r.base_score for r in untaught.collect()} == {0.0}
    assert M.score(df.filter("false"), M.fit(df.filter("false"), F.lit(True))).count() == 0


def test_levels_hash_a_key_once_a_level(monkeypatch):
    """The answers are those of the bits by their definition, with one hash for each level that a key is asked for."""
    rnd = np.random.default_rng(3)
    low = [np.unique(rnd.integers(0, 1 << 32, 3000).astype("<u4")) for _ in range(3)]
    held = [M.build_bits(k[:1000], rnd.integers(1, 200, 1000), M.ERROR) for k in low]
    body = np.frombuffer(b"".join(held), dtype=np.uint8)
    start = np.cumsum([0] + [8 * len(b) for b in held[:-1]]).astype(np.uint64)
    own = np.repeat(np.arange(4), [len(k) for k in low] + [5])            # the last five belong to a segment without bits
    keys = np.concatenate([*low, low[0][:5]])
    start, size = np.append(start, np.uint64(0)), np.array([8 * len(b) for b in held] + [0], dtype=np.uint64)
    want = np.zeros(len(keys), dtype=np.int64)
    for i in np.flatnonzero(size[own] > 0):
        for j in range(1, M.LEVELS + 1):
            at = M._places(keys[i:i + 1], j, size[own[i]], M.probes_of(M.ERROR)).ravel() + start[own[i]]
            if not all(body[int(a) >> 3] >> (int(a) & 7) & 1 for a in at):
                break
            want[i] = j
    hashed, mix = [], M.mix
    monkeypatch.setattr(M, "mix", lambda h: hashed.append(len(h)) or mix(h))
    got = M.levels(keys, body, start[own], size[own], M.ERROR)
    assert got.tolist() == want.tolist() and want.max() >= 8
    assert sum(hashed) <= (want[size[own] > 0] + 1).sum()


def test_the_driver_holds_the_segments_once(spark):
    """Their rows are taken one at a time, so the driver needs little more than the segments themselves."""
    df = frame(spark, [(i, " ".join(f"w{i}x{j}" for j in range(20_000))) for i in range(60)]).repartition(6)
    table = M.fit(df, F.lit(True)).table.repartition(16, "kind", "segment").cache()
    table.count()
    tracemalloc.start()
    model = M.Model(table, 2, 7, M.ERROR)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    table.unpersist()
    assert model.shared is not None and peak < 1.6 * model.n_bytes


def on_disk(spark):
    """Shuffle files and lineage cuts, and their bytes."""
    tops = [*spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString(),
            os.path.dirname(scratch_path(spark, "any")).removeprefix("file:")]
    return {f: os.path.getsize(f) for top in tops for d, _, names in os.walk(top) for f in (os.path.join(d, n) for n in names)}


def test_a_large_filter_takes_little_disk(spark, monkeypatch):
    """Questions and answers are packed: with segments that are not broadcast, scoring writes less than twice the texts."""
    monkeypatch.setattr(M, "BROADCAST", 0)
    rnd = random.Random(5)
    texts = [" ".join(f"w{int(rnd.expovariate(1 / 3000))}" for _ in range(400)) for _ in range(1500)]
    df = frame(spark, list(enumerate(texts))).repartition(4)
    model = M.fit(df, F.lit(True))
    release(spark, last=True)
    before = on_disk(spark)
    scored = M.score(df, model)
    assert len(scored.collect()) == len(texts)
    assert sum(n for f, n in on_disk(spark).items() if f not in before) < 2 * sum(map(len, texts))


def test_blocks_of_texts_keep_every_row(spark, monkeypatch):
    """Segments that are not broadcast give what broadcast ones do, however blocks are cut and however often a segment is copied."""
    rows = [(i % 7 if i % 5 else None, t if i % 11 else None) for i, t in corpus(8, 90)] + [(9, ""), (9, "long " * 300)] * 2
    df = frame(spark, rows).repartition(3)
    train = F.col("doc_id") < 4
    want = sorted(tuple(map(str, r)) for r in M.score(df, M.fit(df, train)).collect())
    assert len(want) == len(rows)
    monkeypatch.setattr(M, "BROADCAST", 0)
    model = M.fit(df, train)
    monkeypatch.setattr(M, "ASKED", 40)
    monkeypatch.setattr(M, "SEGMENT_TEXT", 64)
    assert sorted(tuple(map(str, r)) for r in M.score(df, model).collect()) == want
