"""Language-model scores from a log-frequency Bloom filter (operator 11).

Training counts words and n-grams of all training texts.  Words keep exact
counts.  An n-gram that occurs c times has the level 1 + floor(log2 c); the
filter holds it once for each level up to its own.  Its level is found again by
asking for level 1, 2, ... until the answer is no; its count is taken as the mean
of the counts of that level.  The answer is never too low, and one level too
high with a probability of ``error``.

* The filter is cut into segments by the n-gram's hash, each with as many bits
  as its n-grams need, so it grows with the corpus and its error does not.
* While all segments take at most ``BROADCAST`` bytes they are sent to the
  workers, which probe them where the texts lie.  A larger filter stays where it
  is: the texts are packed into blocks, each block's distinct words and n-grams are
  sent to the segments as sorted arrays, and the answers come back to the block as
  arrays in the same order, without the keys (a byte an n-gram).  Both ways ask the
  same bits and give the same scores.

A word's probability mixes the orders, from the words alone upward:

    p_n = (1 - g) * min(1, c(n-gram) / c(its context)) + g * p_(n-1)

where g is the share of never-seen continuations of contexts that occur about as
often (Good-Turing: n-grams of level 1 over all, by the power of two of the
context's count), measured over the whole training text.  The words alone are
smoothed by 0.1: (c + 0.1) / (N + 0.1 (V + 1)).

Defined results: a null text is empty, and an empty text has its end alone;
rows without an id, or whose ``train`` is null, are scored, not learned from;
repeated rows count each; without training texts every probability of a word
alone is 1 and the score 0; an empty table gives an empty table; taken column
names get underscores in front.  Words are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .common import cut, drop, free_name, release
from .tallies import SEGMENT_TEXT, by_segment, low32, merged, segment_bits, tallied, text_bytes
from .words import _STEP, Words, distinct, mix, runs

#: Bytes of segments that are broadcast at most.
BROADCAST = 160 << 20
#: Tokens that a task counts or scores at once.
BLOCK = 1_000_000
#: Bytes of the texts that ask segments which are not broadcast at once (a longer text asks alone).
ASKED = 4 << 20
#: Probability that an absent (n-gram, level) is taken for present.
ERROR = 1 / 128
LEVELS = 64
END = np.uint64(0x9D39247E33776D41)
WORD = 1


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, place in the text) of every word and, behind each text's last, its end."""
    w = Words(texts)
    size = w.counts + 1
    ends = np.cumsum(size)
    out = np.full(int(ends[-1]) if len(ends) else 0, END, dtype=np.uint64)
    out[np.arange(len(w.start)) + w.text] = w.hashes()
    text = np.repeat(np.arange(len(texts)), size)
    return out, text, np.arange(len(out)) - np.repeat(ends - size, size)


def all_tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``tokens`` of more texts than are cut into words at once."""
    parts, done = [], 0
    for part in runs(texts):
        token, text, place = tokens(part)
        parts.append((token, text + done, place))
        done += len(part)
    return tuple(map(np.concatenate, zip(*parts))) if len(parts) > 1 else parts[0] if parts else tokens([])


def grams(token: np.ndarray, place: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the n-gram that ends at each token, and where there is one.

    A text is preceded by one end, so the first token has a bigram, the second a trigram, and so on.
    """
    key = np.full(len(token), np.uint64(n), dtype=np.uint64)
    for k in range(n - 1, -1, -1):
        back = token if not k else np.concatenate((np.full(min(k, len(token)), END), token[:-k]))
        before = place < k                               # the end in front of the text
        key = mix(key * np.uint64(_STEP) + np.where(before, END, back))
    return key, place >= n - 2


def level_of(count: np.ndarray) -> np.ndarray:
    """1 + floor(log2 count), exactly."""
    return np.frexp(count.astype(np.float64))[1]


#: Mean of the counts that have a level: 2**(j - 1) to 2**j - 1.
MEAN = np.array([0.0] + [(2.0 ** (j - 1) + 2.0 ** j - 1) / 2 for j in range(1, LEVELS + 1)])


def _places(low: np.ndarray, level: int, size: np.ndarray, probes: int) -> np.ndarray:
    """Bits of (key, level) in a segment of ``size`` bits, one row a probe."""
    h = mix(low.astype(np.uint64) + (np.uint64(level) << np.uint64(32)) + np.uint64(0x51ED270B))
    one, two = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return (one + np.arange(probes, dtype=np.uint64)[:, None] * two) % size


def probes_of(error: float) -> int:
    return max(1, int(np.ceil(-np.log2(error))))


def build_bits(low: np.ndarray, count: np.ndarray, error: float) -> bytes:
    """The bits of one segment's n-grams."""
    level, k = level_of(count), probes_of(error)
    size = int(np.ceil(int(level.sum()) * k / np.log(2) / 8 + 1)) * 8
    bits = np.zeros(size, dtype=bool)
    for j in range(1, int(level.max(initial=0)) + 1):
        bits[_places(low[level >= j], j, np.uint64(size), k).ravel()] = True
    return np.packbits(bits, bitorder="little").tobytes()


def levels(low: np.ndarray, body: np.ndarray, start: np.ndarray, size: np.ndarray, error: float) -> np.ndarray:
    """The level of each n-gram: probes of level 1, 2, ... in ``body`` from the bit ``start`` on, until one fails."""
    out = np.zeros(len(low), dtype=np.int64)
    alive = np.flatnonzero(size > 0)
    low, start, size = low[alive].astype(np.uint64), start[alive].astype(np.int64), size[alive]
    k = probes_of(error)
    for j in range(1, LEVELS + 1):
        # One hash and two divisions a level: each probe lies ``step`` bits behind the one before, modulo the size.
        h = mix(low + (np.uint64(j) << np.uint64(32)) + np.uint64(0x51ED270B))
        at, step = ((v % size).view(np.int64) for v in (h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)))
        first, bits, left = start, size.view(np.int64), np.arange(len(alive))
        for p in range(k):                               # most absent ones fail early
            if p:
                at += step
                at -= bits * (at >= bits)
            bit = at + first
            yes = np.flatnonzero(body.take(bit >> 3) >> (bit & 7).astype(np.uint8) & 1)
            if len(yes) < len(at):
                at, step, first, bits, left = (v.take(yes) for v in (at, step, first, bits, left))
        alive, low, start, size = (v.take(left) for v in (alive, low, start, size))
        if not len(alive):
            break
        out[alive] = j
    return out


class Segments:
    """All segments of a model, in the worker's memory."""

    def __init__(self, sizes: list, rows: Iterable, bits: int, error: float):
        """``rows``: (kind, segment, n, body); kind 1 has words and their counts, kind n the bits of n-grams.

        ``sizes`` (kind, segment, n, bytes of the body) come first, so that rows are taken one at
        a time, in any order, and each body is held once.
        """
        self.bits, self.error = bits, error
        sizes = sorted(sizes)
        words = [s for s in sizes if s[0] == WORD]
        n_words = sum(n for _, _, n, _ in words)
        self.keys = np.zeros(n_words, dtype="<u8")
        self.counts = np.zeros(n_words, dtype="<u4" if all(b == 12 * n for _, _, n, b in words) else "<u8")
        first = dict(zip((s[1] for s in words), np.cumsum([0] + [s[2] for s in words]).tolist()))
        self.kinds = {}
        for kind in sorted({s[0] for s in sizes} - {WORD}):
            size, start = np.zeros(1 << bits, dtype=np.uint64), np.zeros(1 << bits, dtype=np.uint64)
            at = 0
            for _, segment, _, n_bytes in (s for s in sizes if s[0] == kind):
                size[segment], start[segment] = 8 * n_bytes, 8 * at
                at += n_bytes
            self.kinds[kind] = (np.zeros(at, dtype=np.uint8), start, size)
        for kind, segment, n, body in rows:
            if kind == WORD:
                at = first[segment]
                self.keys[at:at + n] = np.frombuffer(body, dtype="<u8", count=n)
                self.counts[at:at + n] = _word_counts(n, body)
            else:
                whole, start, _ = self.kinds[kind]
                at = int(start[segment]) >> 3
                whole[at:at + len(body)] = np.frombuffer(body, dtype=np.uint8)

    def ask(self, kind: int, keys: np.ndarray) -> np.ndarray:
        """Counts of words, or levels of n-grams; ``keys`` are distinct and sorted."""
        if kind == WORD:
            return _found(self.keys, self.counts, keys)
        if kind not in self.kinds:
            return np.zeros(len(keys), dtype=np.int64)
        body, start, size = self.kinds[kind]
        segment = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        return levels(low32(keys, self.bits), body, start[segment], size[segment], self.error)


def _word_counts(n: int, body: bytes) -> np.ndarray:
    """The counts behind n keys: four bytes each where they fit, else eight."""
    return np.frombuffer(body, dtype="<u4" if len(body) == 12 * n else "<u8", offset=8 * n)


def _found(have: np.ndarray, values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(have):
        return np.zeros(len(keys), dtype=np.int64)
    at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
    return np.where(have[at] == keys, values[at], 0).astype(np.int64)


class Model:
    """What scoring needs: totals, mixing weights, and the segments (held by workers, or a table)."""

    def __init__(self, table: DataFrame, order: int, bits: int, error: float):
        self.table, self.order, self.bits, self.error = table, order, bits, error
        sums = table.groupBy("kind").agg(F.sum("n"), F.sum("total"), F.sum(F.length("body"))).collect()     # a row per order
        found = {r[0]: r[1:] for r in sums}
        self.distinct, self.total = found.get(WORD, (0, 0, 0))[:2]
        self.n_bytes = sum(r[2] for r in found.values())
        self.unseen = np.ones((order + 1, LEVELS + 1))
        self.shared = None
        if self.n_bytes <= BROADCAST:
            sizes = [tuple(r) for r in table.select("kind", "segment", "n", F.length("body")).collect()]      # a row per segment
            rows = table.select("kind", "segment", "n", "body").toLocalIterator()
            self.shared = table.sparkSession.sparkContext.broadcast(Segments(sizes, rows, bits, error))


class _Scorer:
    """The arithmetic of scores, whatever answers the questions: ``ask(kind, sorted distinct keys)``."""

    def __init__(self, order: int, total: int, distinct: int, unseen: np.ndarray):
        self.order, self.total, self.unseen = order, total, unseen
        self.rest = total + 0.1 * (distinct + 1)

    def _asked(self, ask, kind: int, keys: np.ndarray) -> np.ndarray:
        uniq, back = np.unique(keys, return_inverse=True)
        return np.asarray(ask(kind, uniq), dtype=np.float64)[back]

    def counts(self, texts: list[bytes], ask):
        """Tokens, their counts, and for each order from 2 on: (where, level, context's count)."""
        token, text, place = all_tokens(texts)
        count = self._asked(ask, WORD, token)
        boundary = count[-1] if len(count) else 0.0      # every text's last token is the end
        rows = []
        context = np.where(place > 0, np.append(boundary, count[:-1]), boundary) if len(token) else count
        for n in range(2, self.order + 1):
            key, there = grams(token, place, n)
            level = np.zeros(len(token), dtype=np.int64)
            level[there] = self._asked(ask, n, key[there]).astype(np.int64)
            rows.append((there & (context > 0), level, context))
            context = np.append(0.0, MEAN[level[:-1]]) if len(token) else count    # of the token before
        return text, place, count, rows

    def score(self, texts: list[bytes], ask):
        text, _, count, rows = self.counts(texts, ask)
        p = (count + 0.1) / self.rest
        base = np.bincount(text, weights=np.log10(p), minlength=len(texts))
        for n, (there, level, context) in enumerate(rows, 2):
            g = self.unseen[n][np.minimum(level_of(np.maximum(context, 1)), LEVELS)]
            seen = np.minimum(1.0, MEAN[level] / np.maximum(context, 1))
            p = np.where(there, (1 - g) * seen + g * p, p)
        size = np.bincount(text, minlength=len(texts))
        known = np.bincount(text[count > 0], minlength=len(texts))
        return size, known, base, np.bincount(text, weights=np.log10(p), minlength=len(texts))


def _count(texts: DataFrame, order: int, bits: int) -> DataFrame:
    """Packed tallies of words and n-grams: ``kind``, ``segment``, ``keys``, ``counts``."""
    def run(batches):
        def flush():
            for kind in range(1, order + 1):
                found, n = tallied(np.concatenate(held[kind]))
                rows = [(kind, s, found[at].astype("<u8").tobytes() if kind == WORD else low32(found[at], bits).tobytes(),
                         n[at].astype("<u4").tobytes()) for s, at in by_segment(found, bits)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), (
                        pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["kind", "segment", "keys", "counts"])
                held[kind].clear()

        held: dict = {k: [] for k in range(1, order + 1)}
        size = 0
        for batch in batches:
            for part in runs([(t or "").encode() for t in batch.column(0).to_pylist()]):
                token, _, place = tokens(part)
                held[WORD].append(token)
                for n in range(2, order + 1):
                    key, there = grams(token, place, n)
                    held[n].append(key[there])
                size += len(token)
                if size >= BLOCK:
                    yield from flush()
                    size = 0
        if size:
            yield from flush()

    return texts.mapInArrow(run, "kind int, segment int, keys binary, counts binary")


def _segments(tallies: DataFrame, error: float) -> DataFrame:
    """(``kind``, ``segment``, ``n`` distinct keys, ``total`` occurrences, ``body``)."""
    def build(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, segment = (k.as_py() for k in key)
        keys, counts = [], []
        for batch in batches:
            for k, c in zip(*(batch.column(batch.schema.get_field_index(x)).to_pylist() for x in ("keys", "counts"))):
                keys.append(np.frombuffer(k, dtype="<u8" if kind == WORD else "<u4"))
                counts.append(np.frombuffer(c, dtype="<u4").astype(np.int64))
        k, c = merged(keys, counts)
        if kind == WORD:
            body = k.tobytes() + c.astype("<u4" if c.max(initial=0) < 1 << 32 else "<u8").tobytes()
        else:
            body = build_bits(k, c, error)
        yield pa.RecordBatch.from_arrays(
            [pa.array([kind], type=pa.int32()), pa.array([segment], type=pa.int32()), pa.array([len(k)]), pa.array([int(c.sum())]),
             pa.array([body], type=pa.binary())], names=["kind", "segment", "n", "total", "body"])

    return tallies.groupBy("kind", "segment").applyInArrow(build, "kind int, segment int, n long, total long, body binary")


def fit(docs: DataFrame, train: Column, order: int = 2, error: float = ERROR, text_col: str = "text") -> Model:
    """Learn from all texts where ``train`` is true."""
    spark = docs.sparkSession
    texts = docs.filter(train).select(F.col(text_col).alias("text"))
    bits = segment_bits(text_bytes(texts))
    table = cut(_segments(_count(texts, order, bits), error), "segments")
    release(spark)
    model = Model(table, order, bits, error)
    _mixing(model, texts.select(F.lit(None).cast("long").alias("id"), "text"))
    return model


def _mixing(model: Model, texts: DataFrame) -> None:
    """The share of new continuations by order and by the power of two of the context's count."""
    order, scorer = model.order, _Scorer(model.order, model.total, model.distinct, model.unseen)

    def run(pieces):
        sums = np.zeros((2, order + 1, LEVELS + 1), dtype=np.int64)
        for _, part, ask in pieces:
            _, _, _, rows = scorer.counts(part, ask)
            for n, (there, level, context) in enumerate(rows, 2):
                own = np.minimum(level_of(np.maximum(context[there], 1)), LEVELS)
                sums[0, n] += np.bincount(own, minlength=LEVELS + 1)
                sums[1, n] += np.bincount(own[level[there] <= 1], minlength=LEVELS + 1)
        n, at = np.nonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(n.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(sums[0][n, at]),
                                          pa.array(sums[1][n, at])], names=["order", "at", "n", "new"])

    cuts = _with_answers(texts, model) if model.shared is None else ()
    rows = (_pieces(texts, model, cuts, run, "order int, at int, n long, new long")
            .groupBy("order", "at").agg(F.sum("n").alias("n"), F.sum("new").alias("new")).collect())       # a row per order and power
    if cuts:
        drop(*cuts)
    for r in rows:
        new = min(r.n, r.new / (1 - model.error))        # some of level 1 were taken for more
        model.unseen[r.order, r["at"]] = (new + 1) / (r.n + 2)


def _blocks(texts: DataFrame) -> DataFrame:
    """``texts`` (id, text) in blocks of about ``ASKED`` bytes: ``block``, ``n_bytes``, ``body`` (its rows, compressed)."""
    def pack(batches):
        def flush():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for rows in held:
                    out.write_batch(rows)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([size]), pa.array([sink.getvalue().to_pybytes()])], names=["n_bytes", "body"])

        held, size = [], 0
        for batch in batches:
            first = 0
            for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()):
                if size and size + n + 4 > ASKED:
                    held.append(batch.slice(first, i - first))
                    yield flush()
                    first, size = i, 0
                size += n + 4                            # an empty text has a token, too
            held.append(batch.slice(first))
        if size:
            yield flush()

    return texts.select("id", "text").mapInArrow(pack, "n_bytes long, body binary").withColumn("block", F.monotonically_increasing_id())


def _let_go(spark: SparkSession) -> None:
    """Shuffle files of finished jobs go now; one or two collections often left those of the last job."""
    release(spark)
    for _ in range(2):
        release(spark, last=True)


def _unpacked(body: bytes) -> tuple[pa.Array, list[bytes]]:
    rows = pa.ipc.open_stream(body).read_all().combine_chunks()
    return rows.column(0).combine_chunks(), [(t or "").encode() for t in rows.column(1).to_pylist()]


def _answered(kind: int, keys: np.ndarray, n: int, body: bytes, error: float) -> np.ndarray:
    """Counts of words, or levels of n-grams (by their ``low32``), as the segment ``body`` of ``n`` keys has them."""
    if kind == WORD:
        return _found(np.frombuffer(body, dtype="<u8", count=n), _word_counts(n, body), keys)
    return levels(keys, np.frombuffer(body, dtype=np.uint8), np.zeros(len(keys), dtype=np.uint64),
                  np.full(len(keys), 8 * len(body), dtype=np.uint64), error)


def _with_answers(texts: DataFrame, model: Model) -> tuple[DataFrame, DataFrame]:
    """Lineage cuts of ``_blocks(texts)`` and of the answers to each block's questions.

    The answers of a block, kind by kind and in the order of their segments, are those to its sorted distinct keys.
    """
    spark, order, bits, error = texts.sparkSession, model.order, model.bits, model.error
    kept = "<u4" if model.total < 1 << 32 else "<u8"     # how the counts of words are sent

    def ask(batches):
        for batch in batches:
            for block, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                token, _, place = all_tokens(_unpacked(body)[1])
                for kind in range(1, order + 1):
                    key = token
                    if kind > WORD:
                        key, there = grams(token, place, kind)
                        key = key[there]
                    key = distinct(key)
                    low = key.astype("<u8") if kind == WORD else low32(key, bits)
                    parts = [(s, low[at].tobytes()) for s, at in by_segment(key, bits)]
                    if parts:
                        segments, keys = zip(*parts)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(parts), block)), pa.array(np.full(len(parts), kind, dtype=np.int32)),
                             pa.array(segments, type=pa.int32()), pa.array(keys, type=pa.binary())], names=["block", "kind", "segment", "keys"])

    def answer(asked: pa.Table, segment: pa.Table) -> pa.Table:
        if not len(asked):
            return pa.table({n: pa.array([], type=t) for n, t in zip(names, (pa.int64(), pa.int32(), pa.int32(), pa.binary()))})
        kind = asked.column("kind")[0].as_py()
        parts = [np.frombuffer(k, dtype="<u8" if kind == WORD else "<u4") for k in asked.column("keys").to_pylist()]
        keys = np.concatenate(parts)
        value = np.zeros(len(keys), dtype=np.int64)
        for n, body in zip(*(segment.column(c).to_pylist() for c in ("n", "body"))):
            value = _answered(kind, keys, n, body, error)
        value = value.astype(kept if kind == WORD else np.uint8)
        ends = np.cumsum([len(p) for p in parts])
        return pa.table([asked.column("block"), asked.column("kind"), asked.column("segment"),
                         pa.array([value[b - len(p):b].tobytes() for p, b in zip(parts, ends)], type=pa.binary())], names=names)

    names = ["block", "kind", "segment", "answers"]
    _let_go(spark)
    blocks = cut(_blocks(texts), "blocks")
    # A segment's questions meet in one place; if far more is asked than was learned they are dealt to copies of it.
    shares = max(1, round((blocks.agg(F.sum("n_bytes")).first()[0] or 0) / (SEGMENT_TEXT << bits)))
    asked = (blocks.select("block", "body").mapInArrow(ask, "block long, kind int, segment int, keys binary")
             .withColumn("share", F.pmod(F.xxhash64("block"), F.lit(shares)).cast("int")))
    table = model.table.select("kind", "segment", "n", "body", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))
    by = ["kind", "segment", "share"]
    answers = cut(asked.groupBy(*by).cogroup(table.groupBy(*by)).applyInArrow(answer, "block long, kind int, segment int, answers binary"), "answers")
    _let_go(spark)                                       # of the questions
    return blocks, answers


def _pieces(texts: DataFrame, model: Model, cuts: tuple, run, schema) -> DataFrame:
    """What ``run`` makes of pieces (ids, texts, ask) of ``texts`` (id, text), or of ``cuts`` if the segments are not broadcast."""
    shared, kept = model.shared, "<u4" if model.total < 1 << 32 else "<u8"

    def broadcast(batches):
        ask = shared.value.ask
        for batch in batches:
            done = 0
            for part in runs([(t or "").encode() for t in batch.column(1).to_pylist()]):
                yield batch.column(0).slice(done, len(part)), part, ask
                done += len(part)

    def joined(block: pa.Table, told: pa.Table) -> pa.Table:
        rows = sorted(zip(*(told.column(c).to_pylist() for c in ("kind", "segment", "answers"))))
        answers = {kind: np.frombuffer(b"".join(r[2] for r in rows if r[0] == kind), dtype=kept if kind == WORD else np.uint8)
                   for kind in {r[0] for r in rows}}

        def ask(kind, keys):
            own = answers.get(kind, np.zeros(0, dtype=np.uint8))
            if len(own) != len(keys):
                raise ValueError(f"{len(own)} answers to {len(keys)} questions")
            return own

        return pa.Table.from_batches(run([(*_unpacked(body), ask) for body in block.column("body").to_pylist()]))

    if shared is not None:
        return texts.mapInArrow(lambda batches: run(broadcast(batches)), schema)
    blocks, answers = cuts
    return blocks.select("block", "body").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(joined, schema)


def score(docs: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(``id_col``, ``text_col`` of every row and) ``n_tokens``, ``n_known``, ``train_tokens`` long, ``base_score``, ``score`` double."""
    names = [free_name(docs.select(id_col), n) for n in ("n_tokens", "n_known", "train_tokens", "base_score", "score")]
    scorer, total = _Scorer(model.order, model.total, model.distinct, model.unseen), model.total
    kinds = [T.LongType()] * 3 + [T.DoubleType()] * 2
    schema = T.StructType([T.StructField(id_col, T.LongType())] + [T.StructField(n, k) for n, k in zip(names, kinds)])

    def run(pieces):
        for ids, part, ask in pieces:
            size, known, base, own = scorer.score(part, ask)
            yield pa.RecordBatch.from_arrays([ids, pa.array(size), pa.array(known), pa.array(np.full(len(part), total)),
                                              pa.array(base), pa.array(own)], names=schema.names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return _pieces(rows, model, _with_answers(rows, model) if model.shared is None else (), run, schema)
