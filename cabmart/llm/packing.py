"""Packing of tokenized documents into sequences by length patterns (operator 6).

1. Documents are encoded; those longer than a sequence are cut, the short rest
   first, so that every other piece fills a sequence.
2. The lengths are counted by Spark: at most ``capacity`` x ``SHARDS`` counts
   come to the driver, however many documents there are.
3. Patterns of one to three lengths that fill a sequence are enumerated, and
   how often each is to be used is fitted to the counts by non-negative least
   squares (accelerated projected gradient).  The repeats are rounded up, in
   order of size, as far as documents of those lengths are left.
4. What no pattern took is packed best fit decreasing, by length and count, so
   this too does not grow with the number of documents.
5. Spark numbers the pieces of each length (by length and shard, so that one
   very common length is spread over many tasks) and each looks up its place.

Defined results: a null text is an empty document, which is one piece that
holds the end id alone; repeated rows are packed each for itself; a null id is
carried; an empty table gives no pieces.  Equal rows are interchangeable.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from .byte_bpe import codec
from .common import cut

#: Parts into which the numbering of one length is dealt.
SHARDS = 256
#: Steps of the least-squares fit.
FIT_STEPS = 300
#: Fits, each to what the one before left; all but the last are rounded down.
ROUNDS = 2

PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()),
    T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType())])


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, text_col: str = "text",
                 id_col: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """One row per piece of every document: its place in the document, length and checksum.

    ``keep_ids`` adds the ids themselves (array<int>).
    """
    schema = T.StructType(PIECES.fields + ([T.StructField("ids", T.ArrayType(T.IntegerType()))] if keep_ids else []))

    def run(batches):
        c = codec(vocabulary)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            done = 0
            for ids, counts in c.encode(texts):
                rows, bodies = [], []
                ends = np.cumsum(counts)
                for doc, a, b in zip(doc_ids[done:done + len(counts)], (ends - counts).tolist(), ends.tolist()):
                    own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                    at = 0
                    step = len(own) if len(own) <= capacity else len(own) % capacity or capacity
                    for piece in range(-(-len(own) // capacity)):
                        part = own[at:at + step]
                        rows.append((doc, piece, at, len(part), zlib.crc32(part.tobytes())))
                        if keep_ids:
                            bodies.append(part.astype(np.int32))
                        at, step = at + step, capacity
                done += len(counts)
                columns = [pa.array(col, type=t) for col, t in
                           zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                if keep_ids:
                    columns.append(pa.array(bodies, type=pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


@lru_cache(maxsize=4)
def patterns(capacity: int) -> np.ndarray:
    """All ways to fill a sequence with one, two or three lengths; 0 where there is no document."""
    rows = [np.array([[capacity, 0, 0]])]
    long = np.arange((capacity + 1) // 2, capacity)
    rows.append(np.stack([long, capacity - long, 0 * long], axis=1))
    for a in range(-(-capacity // 3), capacity - 1):
        b = np.arange(-(-(capacity - a) // 2), min(a, capacity - a - 1) + 1)
        rows.append(np.stack([0 * b + a, b, capacity - a - b], axis=1))
    return np.concatenate(rows)


def fit_repeats(counts: np.ndarray, patt: np.ndarray, steps: int = FIT_STEPS) -> np.ndarray:
    """Non-negative least squares: repeats x of the patterns such that they use ``counts`` documents of each length.

    ``counts[l]`` is how many documents have length l; ``counts[0]`` is not fitted.  A miss
    weighs as much as the document is long, since short ones fit in later.
    """
    size = len(counts)
    weight = np.arange(size) / (size - 1)
    target = counts * weight

    def used(x):
        return weight * sum(np.bincount(patt[:, k], weights=x, minlength=size) for k in range(3))

    def back(r):
        return (weight * r)[patt].sum(axis=1)

    probe = np.ones(len(patt))
    for _ in range(20):                                  # largest eigenvalue, by power iteration
        probe = back(used(probe))
        norm = np.linalg.norm(probe)
        probe /= norm
    step = 1 / (1.05 * norm)
    x = y = np.zeros(len(patt))
    t = 1.0
    for _ in range(steps):
        after = np.maximum(0, y + step * back(target - used(y)))
        t_after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = after + (t - 1) / t_after * (after - x)
        x, t = after, t_after
    return x


def plan(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how often) such that every document of the counts is used once."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    out = []
    patt = patterns(capacity)
    for last in (False,) * (ROUNDS - 1) + (True,):
        x = fit_repeats(left, patt)
        for p in np.argsort(-x, kind="stable"):
            want = int(np.ceil(x[p] - 0.5) if last else x[p])
            if want <= 0:
                break
            lengths, uses = np.unique(patt[p][patt[p] > 0], return_counts=True)
            n = min(want, int((left[lengths] // uses).min()))
            if n > 0:
                left[lengths] -= n * uses
                out.append((tuple(patt[p][patt[p] > 0].tolist()), n))
    return out + best_fit(left, capacity)


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing over counts: equal sequences are kept as one entry with a number."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}     # by free space
    for length in range(capacity, 0, -1):
        n = int(left[length])
        for free in sorted(f for f in open_ if f >= length):
            # A sequence with room for several takes as many as fit before the next one is begun.
            fits = free // length
            groups, kept = open_.pop(free), []
            for lengths, many in groups:
                full = min(many, n // fits)
                if full:
                    open_.setdefault(free - fits * length, []).append((lengths + (length,) * fits, full))
                    n -= full * fits
                    many -= full
                if many and n:
                    open_.setdefault(free - n * length, []).append((lengths + (length,) * n, 1))
                    n, many = 0, many - 1
                if many:
                    kept.append((lengths, many))
            if kept:
                open_.setdefault(free, []).extend(kept)
            if not n:
                break
        if n:
            fits = capacity // length
            if n // fits:
                open_.setdefault(capacity - fits * length, []).append(((length,) * fits, n // fits))
            if n % fits:
                open_.setdefault(capacity - n % fits * length, []).append(((length,) * (n % fits), 1))
    return [g for groups in open_.values() for g in groups]


class Places:
    """For each length, which sequence and offset its k-th document gets."""

    def __init__(self, planned, capacity: int):
        slots: dict[int, list[tuple[int, int, int]]] = {}
        begun = 0
        for lengths, many in planned:
            offset = 0
            for length in lengths:
                slots.setdefault(length, []).append((many, begun, offset))
                offset += length
            begun += many
        self.sequences = begun
        self.by_length = {}
        for length, own in slots.items():
            many, base, offset = (np.array(v, dtype=np.int64) for v in zip(*own))
            self.by_length[length] = (np.cumsum(many) - many, base, offset)

    def look_up(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
        for value in np.unique(length):
            at = np.flatnonzero(length == value)
            first, base, off = self.by_length[int(value)]
            slot = np.searchsorted(first, number[at], side="right") - 1
            sequence[at] = base[slot] + number[at] - first[slot]
            offset[at] = off[slot]
        return sequence, offset


def pack(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, text_col: str = "text",
         id_col: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """Pack every document: one row per piece with ``sequence_id`` and ``offset`` (see the module's text)."""
    pieces = cut(token_pieces(docs, vocabulary, capacity, end_id, text_col, id_col, keep_ids)
                 .withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SHARDS)).cast("int")), "pieces")
    counted = pieces.groupBy("length", "shard").count().collect()        # at most capacity x SHARDS rows
    by_shard = np.zeros((capacity + 1, SHARDS), dtype=np.int64)
    for length, shard, n in counted:
        by_shard[length, shard] = n
    places = Places(plan(by_shard.sum(axis=1), capacity), capacity)
    before = np.cumsum(by_shard, axis=1) - by_shard
    shared = docs.sparkSession.sparkContext.broadcast((before, places))

    order = W.partitionBy("length", "shard").orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = pieces.withColumn("number", F.row_number().over(order))
    schema = T.StructType([f for f in pieces.schema.fields if f.name != "shard"]
                          + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    kept = [n for n in schema.names if n not in ("sequence_id", "offset")]

    def place(batches):
        first, table = shared.value
        for batch in batches:
            get = lambda name: batch.column(batch.schema.get_field_index(name))
            length, shard = get("length").to_numpy(), get("shard").to_numpy()
            number = first[length, shard] + get("number").to_numpy() - 1
            sequence, offset = table.look_up(length, number)
            yield pa.RecordBatch.from_arrays([get(n) for n in kept] + [pa.array(sequence), pa.array(offset)],
                                             names=schema.names)

    return numbered.mapInArrow(place, schema)
