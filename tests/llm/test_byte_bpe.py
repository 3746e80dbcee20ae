import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from cabmart.llm import byte_bpe as B

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def oracle():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=B.read_ranks(RANKS), special_tokens={})


def encode(texts, path=RANKS, c=None):
    c = c or B.codec(path)
    out = []
    for ids, counts in c.encode(texts):
        ends = np.cumsum(counts)
        out += [ids[a:b].tolist() for a, b in zip(ends - counts, ends)]
    return out


PARTS = ["a", "b", " ", "  ", "\n", "'s", "'re", "'", "''", "ll", "'ll", "1", "２", "é", "漢", "😀", " ", "​", "!",
         "\t", "é", "\u0085", "　", "²", "ǅ", "don't", "we've", "'S", " 's", "x'd", "_", "<|endoftext|>"]


def texts(n, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randrange(30))) for _ in range(n)]


def test_ids_are_those_of_tiktoken(oracle):
    got = encode(texts(4000))
    assert got == [oracle.encode_ordinary(t) for t in texts(4000)]


def test_ids_are_those_of_the_library():
    lib = Tokenizer.from_file(JSON)
    assert encode(texts(2000), JSON) == [e.ids for e in lib.encode_batch(texts(2000), add_special_tokens=False)]


def test_added_tokens_of_the_file():
    lib = Tokenizer.from_file(JSON)
    own = ["see <|endoftext|> here", "<|endoftext|>", "a<|endoftext|><|endoftext|>b", "<|endoftext", "x" * 300_000 + " <|endoftext|> y"]
    assert encode(own, JSON) == [e.ids for e in lib.encode_batch(own, add_special_tokens=False)]
    assert encode(own, JSON)[0] == [3826, 220, 50256, 994]
    c = B.codec(JSON)
    assert [c.decode(np.array(i)).tobytes().decode() for i in encode(own, JSON)] == own


def test_classes_of_all_code_points(oracle):
    every = [f"a{chr(c)}a {chr(c)} 1{chr(c)}" for c in range(0, 0x30000, 3) if not 0xD800 <= c < 0xE000]
    assert encode(every) == [oracle.encode_ordinary(t) for t in every]


def test_very_long_texts_and_full_table(oracle):
    long = "word " * 120_000 + "aaaa" * 9000 + " b'll " * 500
    small = B.Codec(RANKS, kept=500)                      # the table of matches is emptied again and again
    for c in (B.codec(RANKS), small):
        assert encode([long, "", "x"], c=c) == [oracle.encode_ordinary(t) for t in (long, "", "x")]


def test_offsets_and_split_characters(spark):
    rows = [(1, "aé漢😀 b"), (2, ""), (3, None), (4, "plain words")]
    df = B.encode(spark.createDataFrame(rows, "doc_id int, text string"), RANKS)
    c = B.codec(RANKS)
    for r in df.collect():
        text = r.text or ""
        assert r.bpe_n_tokens == len(r.bpe_ids) == len(r.bpe_starts) == len(r.bpe_ends)
        at = 0
        inside = 0
        for i, a, b in zip(r.bpe_ids, r.bpe_starts, r.bpe_ends):
            piece = c.tokens[i]
            owner = [k for k, ch in enumerate(text) for _ in ch.encode()]
            assert (a, b) == (owner[at], owner[at + len(piece) - 1] + 1)
            inside += at > 0 and owner[at] == owner[at - 1]
            at += len(piece)
        assert r.bpe_n_split == inside
    assert max(r.bpe_n_split for r in df.collect()) > 0


def test_decode_round_trip_and_broken_ids(spark):
    rows = [(i, t) for i, t in enumerate(texts(200, 5) + [None, ""])]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    back = B.decode(B.encode(df, RANKS), RANKS)
    for r in back.collect():
        assert r.decoded_text == (r.text or "")
        assert bytes(r.decoded_bytes) == (r.text or "").encode()
    first = B.codec(RANKS).tokens.index("é".encode()[:1])
    cut = B.decode(spark.createDataFrame([(1, [first]), (2, None), (3, [])], "k int, bpe_ids array<int>"), RANKS)
    got = {r.k: (bytes(r.decoded_bytes), r.decoded_text) for r in cut.collect()}
    assert got == {1: (b"\xc3", "�"), 2: (b"", ""), 3: (b"", "")}
    with pytest.raises(Exception, match="not in the vocabulary"):
        B.decode(spark.createDataFrame([(1, [10 ** 6])], "k int, bpe_ids array<int>"), RANKS).collect()


def test_clashing_names_and_empty_table(spark):
    df = spark.createDataFrame([(1, "x", "kept")], "doc_id int, text string, bpe_ids string")
    out = B.encode(df, RANKS)
    assert out.columns == ["doc_id", "text", "bpe_ids", "_bpe_ids", "_bpe_n_tokens", "_bpe_starts", "_bpe_ends", "_bpe_n_split"]
    assert out.first().bpe_ids == "kept"
    assert B.encode(df.filter("false"), RANKS).count() == 0


def test_query(spark, queries, small, oracle):
    from conftest import SF_SMALL
    got = {r.doc_id: r for r in queries["op2_byte_bpe"](spark, SF_SMALL).collect()}
    rows = small("documents", "doc_id, text")
    assert len(got) == len(rows)
    for i, t in rows:
        ids = oracle.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
