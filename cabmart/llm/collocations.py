"""Phrases whose words belong together, mined by partitions (operator 13).

Texts are cut into pieces at punctuation and line ends, pieces into words.  A
phrase of 2 to ``longest`` words that occurs ``support`` times or more in a
language is a candidate.  SON partitioning finds the candidates:

1. Documents are dealt to ``SHARDS`` shards by a hash.  In a shard that holds the
   share s of a language's text, a phrase is locally frequent if it occurs
   ceil(s * support) times or more there: a phrase with ``support`` occurrences is
   locally frequent in some shard, as the shares add up to one.
2. Each shard is mined completely, by length: only phrases whose parts are
   locally frequent somewhere are counted.  A shard is as large a part of any
   corpus, so its counts are dealt to many tasks, as packed arrays of hashes.
3. The union of what is locally frequent becomes a bit table of bounded size (a
   hash that meets another's bit only lets a phrase too many through).
4. Every phrase that passes is counted over all texts, by its words: exactly.

Scores compare a candidate with its parts, whose counts are in the same table, as
a part of a candidate is itself frequent.

Defined results: a null text is empty; a null language is ``und``; repeated rows
count each; a document without words adds nothing; a table without texts has no
phrases; other columns are ignored.  Counts are exact up to 10**16.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import cut, release
from .tallies import by_segment, low32, merged, segment_bits, tallied
from .words import _LOWER, _STEP, Words, mix, runs

#: Parts of the corpus that are mined on their own.
SHARDS = 4
#: Words that a task counts at once, and bits of a table at most (32 MB).
BLOCK, MOST_TABLE_BITS = 1_500_000, 28
#: Parts of a language that are ranked side by side.
RANK_PARTS = 64

_BREAK = np.zeros(256, dtype=bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_OUTSIDE = _BREAK.copy()
_OUTSIDE[[0x20, 0x09]] = True


def _lang_key(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


class _Block:
    """Words of many documents: hash (with the language), and whether the next word is in the same piece."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.size = 0

    def add(self, texts: list[bytes], own: np.ndarray, lang_keys: np.ndarray, keep_raw: bool):
        """``own``: the group (language, or lot) of each text."""
        w = Words(texts, _OUTSIDE)
        if not len(w.start):
            return
        breaks = np.concatenate(([0], np.cumsum(_BREAK[w.raw])))
        joined = np.append(breaks[w.start[1:]] == breaks[w.end[:-1]], False)
        self.parts.append((mix(w.hashes() ^ lang_keys[w.text]), joined, own[w.text],
                           (w.start, w.end, _LOWER[w.raw].tobytes()) if keep_raw else None))
        self.size += len(w.start)

    def arrays(self):
        h, joined, own = (np.concatenate([p[i] for p in self.parts]) for i in range(3))
        return h, joined, own


def _phrase_keys(h: np.ndarray, joined: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the n words from each word on, and where these lie in one piece."""
    keys, good = h, np.ones(len(h), dtype=bool)
    for k in range(1, n):
        following = np.append(h[k:], np.zeros(min(k, len(h)), dtype=np.uint64))
        keys = mix(keys * np.uint64(_STEP) + following)
        good = good & np.append(joined[k - 1:], np.zeros(min(k - 1, len(h)), dtype=bool))
    return keys, good


class _Table:
    """Bits of the hashes of one length's frequent phrases."""

    def __init__(self, bits: int):
        self.bits = bits
        self.at = np.zeros(1 << (bits - 3), dtype=np.uint8)

    def has(self, keys: np.ndarray) -> np.ndarray:
        place = keys >> np.uint64(64 - self.bits)
        return (self.at[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _blocks(batches, langs, lots, keep_raw: bool = False):
    """Blocks of words of (lang, lot, text) batches; ``lots`` gives a text's group."""
    block = _Block()
    for batch in batches:
        lang, lot = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        done = 0
        for part in runs([(t or "").encode() for t in batch.column(2).to_pylist()]):
            names = lang[done:done + len(part)]
            keys = np.array([langs(x) for x in names], dtype=np.uint64)
            own = np.array([lots(x, k) for x, k in zip(names, lot[done:done + len(part)])], dtype=np.int64)
            done += len(part)
            block.add(part, own, keys, keep_raw)
            if block.size >= BLOCK:
                yield block
                block = _Block()
    if block.size:
        yield block


def _memo(f):
    seen: dict = {}

    def get(x):
        if x not in seen:
            seen[x] = f(x)
        return seen[x]
    return get


def _mine(texts: DataFrame, n: int, below, least: dict, bits: int, table_bits: int) -> _Table:
    """The table of the phrases of n words that are locally frequent in a shard."""
    lots = sorted(set(least.values()))                   # local supports; a lot is (shard, place of its support)

    def count(batches):
        def lot(lang, shard):
            return shard * len(lots) + lots.index(least[lang, shard])

        for block in _blocks(batches, _memo(_lang_key), lot):
            h, joined, own = block.arrays()
            keys, good = _phrase_keys(h, joined, n)
            if below is not None:
                part, _ = _phrase_keys(h, joined, n - 1)
                known = below.value.has(part)
                good &= known & np.append(known[1:], False)
            keys, own = keys[good], own[good]
            for k in np.unique(own).tolist():
                found, counts = tallied(keys[own == k])
                rows = [(s, k, low32(found[at], bits).tobytes(), counts[at].astype("<u4").tobytes())
                        for s, at in by_segment(found, bits)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), (
                        pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["segment", "lot", "keys", "counts"])

    def reduce(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for k, keys, counts in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("lot", "keys", "counts"))):
                held.setdefault(k, ([], []))
                held[k][0].append(np.frombuffer(keys, dtype="<u4"))
                held[k][1].append(np.frombuffer(counts, dtype="<u4").astype(np.int64))
        own = np.zeros(1 << (table_bits - bits), dtype=bool)
        for k, (keys, counts) in held.items():
            found, total = merged(keys, counts)
            found = found[total >= lots[k % len(lots)]]
            own[found >> np.uint32(32 - table_bits + bits)] = True
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], type=pa.int32()),
                                          pa.array([np.packbits(own, bitorder="little").tobytes()])], names=["segment", "body"])

    tallies = texts.mapInArrow(count, "segment int, lot int, keys binary, counts binary")
    table = _Table(table_bits)
    size = len(table.at) >> bits
    for r in tallies.groupBy("segment").applyInArrow(reduce, "segment int, body binary").collect():   # one bounded slice a segment
        table.at[r.segment * size:(r.segment + 1) * size] = np.frombuffer(r.body, dtype=np.uint8)
    return table


def _exact(texts: DataFrame, tables) -> DataFrame:
    """(``lang``, ``phrase``, ``a``) of all that the tables let through; the empty phrase counts all words."""
    def count(batches):
        names: list[str] = []

        def group(lang, _):
            if lang not in places:
                places[lang] = len(names)
                names.append(lang)
            return places[lang]

        places: dict = {}
        for block in _blocks(batches, _memo(_lang_key), group, keep_raw=True):
            h, joined, own = block.arrays()
            lang, phrase, a = [], [], []
            for k, n in enumerate(np.bincount(own).tolist()):
                if n:
                    lang.append(names[k])
                    phrase.append(b"")
                    a.append(n)
            first_word = np.cumsum([0] + [len(p[0]) for p in block.parts])
            for n, table in enumerate(tables.value, 1):
                keys, good = _phrase_keys(h, joined, n)
                at = np.flatnonzero(good & table.has(keys))
                order = np.argsort(keys[at], kind="stable")
                at, keys = at[order], keys[at][order]
                first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else []
                a += np.diff(np.append(first, len(keys))).tolist()
                where = at[first]
                part = np.searchsorted(first_word, where, side="right") - 1
                for i, p in zip(where.tolist(), part.tolist()):
                    start, end, raw = block.parts[p][3]
                    i -= int(first_word[p])
                    phrase.append(raw[start[i]:end[i]] if n == 1 else b" ".join(raw[s:e] for s, e in zip(start[i:i + n], end[i:i + n])))
                lang += [names[k] for k in own[where].tolist()]
            for at in range(0, len(a), 50_000):
                to = at + 50_000
                yield pa.RecordBatch.from_arrays([pa.array(lang[at:to]), pa.array(phrase[at:to], type=pa.binary()).cast(pa.string()),
                                                  pa.array(a[at:to], type=pa.int64())], names=["lang", "phrase", "a"])

    return texts.mapInArrow(count, "lang string, phrase string, a long").groupBy("lang", "phrase").agg(F.sum("a").alias("a"))


def frequent_phrases(docs: DataFrame, support: int = 10, longest: int = 3, text_col: str = "text",
                     lang_col: str = "lang") -> DataFrame:
    """(``lang``, ``phrase``, ``words``, ``a``): every phrase of 1 to ``longest`` words with ``support`` occurrences or more.

    The row of the empty phrase (0 words) holds how many words the language has, whatever the support.
    """
    spark = docs.sparkSession
    shard = F.pmod(F.xxhash64(F.col(text_col), F.col(lang_col), *([F.col("doc_id")] if "doc_id" in docs.columns else [])), F.lit(SHARDS))
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), shard.cast("int").alias("lot"),
                        F.col(text_col).alias("text"))
    sizes = {(r.lang, r.lot): r.n or 0 for r in                          # a row per language and shard
             texts.groupBy("lang", "lot").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    whole = {}
    for (lang, _), n in sizes.items():
        whole[lang] = whole.get(lang, 0) + n
    least = {k: max(1, -(-support * n // max(1, whole[k[0]]))) for k, n in sizes.items()}
    total = sum(whole.values())
    bits = segment_bits(total)
    table_bits = min(max(bits + 3, int(np.ceil(np.log2(max(total / 8, 1 << 16))))), max(MOST_TABLE_BITS, bits + 3))
    tables, below = [], None
    for n in range(1, longest + 1):
        tables.append(_mine(texts, n, below, least, bits, table_bits))
        release(spark)
        below = spark.sparkContext.broadcast(tables[-1])                 # 2**table_bits bits
    counted = _exact(texts, spark.sparkContext.broadcast(tables)).filter((F.col("a") >= support) | (F.col("phrase") == ""))
    words = F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ")))
    return cut(counted.select("lang", "phrase", words.alias("words"), "a"), "phrases")


def _div(top: str, *below: str):
    """floor(1000000 * top * top / product of ``below``), in whole numbers."""
    return F.expr(f"cast((cast(1000000 as decimal(38,0)) * {top} * {top}) div ({' * '.join(f'cast({b} as decimal(38,0))' for b in below)}) as long)")


def collocations(docs: DataFrame, support: int = 10, longest: int = 3, percent: int = 50, top: int = 2000,
                 text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The ``top`` candidates of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    The score is that of the weakest cut in two: floor(10**6 a a / (l r)), with the counts l and r of
    both parts.  A candidate inside a longer one that occurs ``percent`` % as often or more is left out.
    """
    counts = frequent_phrases(docs, support, longest, text_col, lang_col)
    grams = counts.filter("words >= 2")
    split = F.split("phrase", " ")
    cuts = F.explode(F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(
        k.alias("k"), F.array_join(F.slice(split, F.lit(1), k), " ").alias("left"),
        F.array_join(F.slice(split, k + 1, F.col("words") - k), " ").alias("right"))))
    parts = grams.select("lang", "phrase", "a", cuts.alias("cut")).select("lang", "phrase", "a", "cut.*")
    single = counts.select("lang", F.col("phrase").alias("part"), F.col("a").alias("count"))
    scored = (parts.join(single.toDF("lang", "left", "l"), ["lang", "left"])
              .join(single.toDF("lang", "right", "r"), ["lang", "right"])
              .select("lang", "phrase", "a", F.struct(_div("a", "l", "r").alias("score"), "k", "l", "r").alias("cut"))
              .groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min("cut").alias("cut")))
    # Of longer ones, those with one word more have the largest counts, and are candidates themselves.
    inner = F.explode(F.array(F.array_join(F.slice(split, F.lit(1), F.col("words") - 1), " "),
                              F.array_join(F.slice(split, F.lit(2), F.col("words") - 1), " ")))
    longer = (grams.filter("words >= 3").select("lang", inner.alias("phrase"), "a")
              .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    kept = (scored.join(longer, ["lang", "phrase"], "left")
            .filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * percent))
            .select("lang", "phrase", "a", "cut.score", "cut.l", "cut.r"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    best = (kept.withColumn("place", F.row_number().over(W.partitionBy("lang", part).orderBy(*order)))
            .filter(F.col("place") <= top))
    ranked = (best.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long"))
              .filter(F.col("rank") <= top))
    sizes = counts.filter("words = 0").select("lang", F.col("a").alias("n"))
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
