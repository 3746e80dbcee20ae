import random
import re
from collections import Counter, defaultdict

import pytest

from cabmart.llm import collocations as C
from cabmart.llm import tallies
from conftest import SF_MIDDLE

PIECES = re.compile(rb"[.,;:!?\x0A-\x0D]")
WORDS = re.compile(rb"[^\x20\x09]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def plain(rows, support=10, longest=3, percent=50, top=2000):
    """rows: (lang, text). [(lang, rank, phrase, a, l, r, n, score), ...], the phrases as bytes."""
    counts, sizes = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in PIECES.split((text or "").encode().translate(LOWER)):
            words = WORDS.findall(piece)
            sizes[lang] += len(words)
            for n in range(1, longest + 1):
                counts[lang].update(tuple(words[i:i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= support}
        kept = []
        for p, a in cand.items():
            score, _, l, r = min((10 ** 6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            inside = any(100 * b >= percent * a and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in cand.items())
            if not inside:
                kept.append((-score, -a, b" ".join(p), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase, -a, l, r, sizes[lang], -score))
    return sorted(out)


def found(df):
    return sorted((r.lang, r.rank, r.phrase.encode(), r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def corpus(seed, n=300):
    rnd = random.Random(seed)
    vocabulary = ["The", "of", "new", "york", "é", "City\t", "x1", "-", "a\xa0b"] + [f"w{i}" for i in range(40)]
    fixed = ["san francisco bay", "new york city hall", "of the the", "Ad hoc"]
    rows = []
    for _ in range(n):
        words = [rnd.choice(fixed) if rnd.random() < 0.2 else rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 30))]
        text = "".join(w + rnd.choice([" ", " ", " ", "  ", "\t", ". ", "\n", "!", ";\r\n", "\x0b"]) for w in words)
        rows.append((rnd.choice(["en", "en", "en", "de", None, "und"]), text))
    return rows


@pytest.mark.parametrize("seed, support, longest", [(1, 10, 3), (2, 4, 3), (3, 3, 4), (4, 1, 2)])
def test_against_plain_python(spark, monkeypatch, seed, support, longest):
    monkeypatch.setattr(C, "BLOCK", 500)                 # many blocks a task
    rows = corpus(seed)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string").repartition(5)
    got = found(C.collocations(df, support, longest, top=40))
    assert got == plain(rows, support, longest, top=40) and len(got) > 10


def test_query(spark, queries, small):
    rows = [(lang, text) for _, lang, text in small("documents", "doc_id, lang, text", SF_MIDDLE)]
    got = found(queries["op13_collocations"](spark, SF_MIDDLE))
    f = defaultdict(list)
    for r in got:
        f[r[0]].append(r)
    assert got and all([r[1] for r in own] == list(range(1, len(own) + 1)) for own in f.values())
    few = [r for r in rows if r[0] in ("es", "fr")]
    assert [r for r in got if r[0] in ("es", "fr")] == plain(few)


def test_a_phrase_of_one_shard_or_of_all_is_found(spark):
    """Ten occurrences are enough wherever they lie: in one document, or one in each of ten."""
    rows = [("en", "only here " + "rare pair, " * 10)] + [("en", f"spread thin. filler{i} word{i}") for i in range(10)]
    rows += [("en", "other text " * 50)] * 20 + [("en", "nine times. " * 9)]
    df = spark.createDataFrame(rows, "lang string, text string")
    got = {r.phrase: r.a for r in C.collocations(df).collect()}
    assert got["rare pair"] == 10 and got["spread thin"] == 10 and "nine times" not in got
    assert got == {p.decode(): a for _, _, p, a, *_ in plain(rows)}


def test_edge_cases(spark):
    rows = [(None, "a b c " * 12), ("und", "a b"), ("en", None), ("en", ""), ("de", " \t\n.,;"), (None, "a b c " * 12),
            ("long", "w x " * 200_000), ("", "p q. " * 10)]
    df = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "'z' AS phrase", "1 AS segment", "2 AS a")
    assert found(C.collocations(df)) == plain(rows)
    assert C.collocations(df.filter("false")).count() == 0


def test_counts_past_64_bits(spark):
    df = spark.createDataFrame([(10 ** 12, 2 * 10 ** 12, 3 * 10 ** 12)], "a long, l long, r long")
    assert df.select(C._div("a", "l", "r").alias("s")).first().s == 10 ** 6 // 6


def test_segments_grow_with_the_text():
    assert tallies.segment_bits(0) == tallies.LEAST_BITS
    for n in (10 ** 9, 10 ** 12, 10 ** 14):
        assert tallies.SEGMENT_TEXT / 2 < n / 2 ** tallies.segment_bits(n) <= tallies.SEGMENT_TEXT
