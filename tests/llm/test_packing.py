import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from cabmart.llm import packing as K
from conftest import SF_MIDDLE

JSON = P.path("byte_bpe_50k.json")


def check(rows, texts, capacity):
    """Every rule of the packing on its rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    lib = Tokenizer.from_file(JSON)
    ids = {i: lib.encode(t or "", add_special_tokens=False).ids + [2] for i, t in texts}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        part = np.array(ids[r.doc_id][r.start:r.start + r.length], dtype="<u4")
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
    assert set(by_doc) == set(ids)
    for i, own in by_doc.items():
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert [r.start for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
        assert sum(r.length for r in own) == len(ids[i])
        assert all(r.length == capacity for r in own[1:]) and (len(own) == 1) == (len(ids[i]) <= capacity)
    for own in by_seq.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
        assert sum(r.length for r in own) <= capacity
    least = -(-sum(map(len, ids.values())) // capacity)
    return len(by_seq), least


def test_query(spark, queries, small):
    rows = queries["op6_packing"](spark, SF_MIDDLE).collect()
    n, least = check(rows, small("documents", "doc_id, text", SF_MIDDLE), 1024)
    assert n <= 1.01 * least + 2


def test_edge_cases(spark):
    texts = [(1, None), (2, ""), (3, "a " * 40), (4, "word " * 9), (5, "b <|endoftext|> c"), (6, "x y z " * 500)] + [(i, "same words here") for i in range(7, 60)]
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS length", "'s' AS sequence_id")
    rows = K.pack(df, JSON, capacity=16, keep_ids=True).collect()
    n, least = check(rows, texts, 16)
    assert n <= least + 5
    assert all(r.length == len(r.ids) for r in rows)
    assert K.pack(df.filter("false"), JSON, capacity=16).count() == 0
    again = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "doc_id long, text string")
    got = K.pack(again, JSON, capacity=16).collect()
    assert len(got) == 3 and len({(r.sequence_id, r.offset) for r in got}) == 3


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_document_once(seed):
    rng = np.random.default_rng(seed)
    lengths = np.concatenate([rng.integers(1, 257, 900), np.full(600, 90), np.minimum(256, rng.lognormal(3, 1, 900).astype(int) + 1)])
    counts = np.bincount(lengths, minlength=257)
    used = np.zeros(257, dtype=int)
    planned = K.plan(counts, 256)
    for sequence, many in planned:
        assert sum(sequence) <= 256 and many > 0
        for length in sequence:
            used[length] += many
    assert (used[1:] == counts[1:]).all()
    assert sum(m for _, m in planned) <= 1.06 * lengths.sum() / 256 + 2


def test_fit_is_the_least_squares_solution():
    """At the optimum no pattern's weight can be moved to lessen the weighted residual."""
    rng = np.random.default_rng(2)
    patt = K.patterns(24)
    assert len(patt) == sum(1 for a in range(1, 25) for b in range(a + 1) for c in range(b + 1) if a + b + c == 24)
    counts = np.bincount(rng.integers(1, 25, 500), minlength=25)
    x = K.fit_repeats(counts, patt, steps=4000)
    weight = np.arange(25) / 24
    residual = weight * (counts - sum(np.bincount(patt[:, k], weights=x, minlength=25) for k in range(3)))
    gradient = (weight * residual)[patt].sum(axis=1)
    assert (gradient <= 0.05).all() and np.abs(gradient[x > 0.05]).max() <= 0.05


def test_patterns_fill_a_sequence():
    for capacity in (1, 2, 3, 10, 64):
        p = K.patterns(capacity)
        assert (p.sum(axis=1) == capacity).all() and len(np.unique(p, axis=0)) == len(p)
