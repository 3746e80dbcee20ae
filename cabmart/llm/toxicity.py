"""Toxicity: a factorization machine over hashed terms (operator 1).

A text's terms are its words and their first four to seven bytes (so that
forms of one word share terms), hashed, plus one term for its length.  Of the
terms of the labelled sample, the ``TERMS`` with the largest information about
the label are kept; Spark counts them.  The machine gives each kept term a
weight and a vector of ``RANK`` numbers:

    logit = bias + sum of weights + sum over pairs of terms of <v_i, v_j>

so that two terms together (an insult and the mention of a group) can weigh
other than the sum of both.  It is fitted by Adagrad on the logistic loss, and
a logistic curve on rows it did not see gives the probability.

The fit uses at most ``SAMPLE`` labelled rows (in the order of a hash of the
id); only their kept terms come to the driver.  Texts are scored where they
lie, in one pass.

Defined results: a null text counts as empty and has only the length term;
labels other than 0 and 1, or without an id, teach nothing; without toxic rows
every score is 0, with toxic rows alone it is 1; repeated rows are scored each
for itself; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut
from .labelled import feature_rows, platt, sample_rows, sample_texts, score_texts, sigmoid
from .words import Words, distinct, mix, runs

BUCKETS = 1 << 22
#: Labelled rows used for the fit, terms kept, and rows of a class that a kept term occurs in at least.
SAMPLE, TERMS, LEAST_ROWS = 16_000, 2048, 3
RANK, PASSES, RATE, DECAY = 8, 30, 0.1, 2e-4
#: Each so many-th row of the sample fits the curve instead of the machine.
CURVE = 5

_OUTSIDE = np.ones(256, dtype=bool)
_OUTSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, term) of every distinct term of each text, sorted by both."""
    w = Words([t.decode("utf-8", "replace").lower().encode() for t in texts], _OUTSIDE)
    size = w.end - w.start
    found = [(w.text, w.hashes())]
    for n in (4, 5, 6, 7):
        longer = size > n
        found.append((w.text[longer], mix(w.hashes(n)[longer] + np.uint64(n))))
    length = np.floor(np.log2(w.counts + 1)).astype(np.uint64)
    found.append((np.arange(len(texts)), mix(length + np.uint64(1 << 40))))
    text = np.concatenate([f[0] for f in found]).astype(np.uint64)
    key = distinct((text << np.uint64(22)) | (np.concatenate([f[1] for f in found]) % np.uint64(BUCKETS)))
    return (key >> np.uint64(22)).astype(np.int64), (key & np.uint64(BUCKETS - 1)).astype(np.int64)


def count_terms(texts: DataFrame) -> DataFrame:
    """(``term``, ``pos``, ``neg``): in how many sampled texts of each class a term occurs."""
    def run(batches):
        for batch in batches:
            y = np.array(batch.column(0).to_pylist(), dtype=np.int64)
            body = [(t or "").encode() for t in batch.column(1).to_pylist()]
            done, keys = 0, []
            for part in runs(body):
                text, term = terms(part)
                keys.append(term * 2 + y[done + text])
                done += len(part)
            if not keys:
                continue
            keys = np.sort(np.concatenate(keys))
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            n = np.diff(np.append(first, len(keys)))
            one = keys[first] % 2
            yield pa.RecordBatch.from_arrays(
                [pa.array((keys[first] // 2).astype(np.int32)), pa.array(n * one), pa.array(n * (1 - one))],
                names=["term", "pos", "neg"])

    return (texts.select("y", "text").mapInArrow(run, "term int, pos long, neg long")
            .groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))


def informative(counts: DataFrame, n_pos: int, n_neg: int, keep: int = TERMS) -> list[int]:
    """The ``keep`` terms whose presence tells most about the label (mutual information)."""
    n = float(n_pos + n_neg)

    def part(joint, row, column):
        return F.when(joint > 0, joint / n * F.log(joint * n / (row * column))).otherwise(0.0)

    pos, neg = F.col("pos"), F.col("neg")
    absent_pos, absent_neg = F.lit(n_pos) - pos, F.lit(n_neg) - neg
    info = (part(pos, pos + neg, F.lit(n_pos)) + part(neg, pos + neg, F.lit(n_neg))
            + part(absent_pos, absent_pos + absent_neg, F.lit(n_pos))
            + part(absent_neg, absent_pos + absent_neg, F.lit(n_neg)))
    best = (counts.filter(F.greatest(pos, neg) >= LEAST_ROWS).select("term", info.alias("info"))
            .orderBy(F.desc("info"), "term").limit(keep))
    return sorted(r.term for r in best.collect())


class Machine:
    """Weights and vectors by kept term; ``slot`` maps a hashed term to its row, 0 for the others."""

    def __init__(self, kept: list[int]):
        self.kept = np.array(kept, dtype=np.int64)
        self.bias, self.slope, self.offset = 0.0, 1.0, 0.0
        self.w = np.zeros(len(kept) + 1)
        self.v = np.zeros((len(kept) + 1, RANK))

    def logits(self, slots: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        linear = np.bincount(row, weights=self.w[slots], minlength=n)
        pairs = np.zeros(n)
        for f in range(RANK):
            v = self.v[slots, f]
            pairs += np.bincount(row, weights=v, minlength=n) ** 2 - np.bincount(row, weights=v * v, minlength=n)
        return self.bias + linear + pairs / 2

    def score(self, texts: list[bytes]) -> np.ndarray:
        row, term = terms(texts)
        slots = self._slots(term)
        hit = slots > 0
        return sigmoid(self.slope * self.logits(slots[hit], row[hit], len(texts)) + self.offset)

    def _slots(self, term: np.ndarray) -> np.ndarray:
        table = self.__dict__.get("_table")
        if table is None:
            table = np.zeros(BUCKETS, dtype=np.int16)
            table[self.kept] = np.arange(1, len(self.kept) + 1)
            self._table = table
        return table[term].astype(np.int64)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_table"}

    def fit(self, rows: list[np.ndarray], y: np.ndarray, passes: int = PASSES, batch: int = 64):
        """Adagrad on the logistic loss; ``rows`` hold the slots of each text."""
        rng = np.random.default_rng(11)
        self.v[1:] = rng.normal(0, 0.02, (len(self.kept), RANK))
        share = (y.sum() + 0.5) / (len(y) + 1)
        self.bias = float(np.log(share / (1 - share)))
        gw, gv, gb = np.full(self.w.shape, 1e-2), np.full(self.v.shape, 1e-2), 1e-2
        for _ in range(passes):
            order = rng.permutation(len(y))
            for at in range(0, len(order), batch):
                pick = order[at:at + batch]
                size = np.array([len(rows[i]) for i in pick])
                slots = np.concatenate([rows[i] for i in pick])
                row = np.repeat(np.arange(len(pick)), size)
                vec = self.v[slots]
                sums = np.stack([np.bincount(row, weights=vec[:, f], minlength=len(pick)) for f in range(RANK)], 1)
                logit = (self.bias + np.bincount(row, weights=self.w[slots], minlength=len(pick))
                         + ((sums ** 2).sum(1) - np.bincount(row, weights=(vec ** 2).sum(1), minlength=len(pick))) / 2)
                error = (sigmoid(logit) - y[pick]) / len(pick)
                uniq, back = np.unique(slots, return_inverse=True)
                dw = np.bincount(back, weights=error[row], minlength=len(uniq)) + DECAY * self.w[uniq]
                each = error[row][:, None] * (sums[row] - vec)
                dv = np.stack([np.bincount(back, weights=each[:, f], minlength=len(uniq)) for f in range(RANK)], 1)
                dv += DECAY * self.v[uniq]
                gw[uniq] += dw ** 2
                gv[uniq] += dv ** 2
                self.w[uniq] -= RATE * dw / np.sqrt(gw[uniq])
                self.v[uniq] -= RATE * dv / np.sqrt(gv[uniq])
                db = error.sum()
                gb += db ** 2
                self.bias -= RATE * db / np.sqrt(gb)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", held_out: Column | None = None,
        sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Machine:
    """Fit on a bounded sample of the labelled rows that are not ``held_out``."""
    picked = sample_rows(labels, label_col, sample, id_col, held_out)
    texts = cut(sample_texts(docs, picked, id_col, text_col), "toxicity-sample")   # read three times
    by_class = {r.y: r["count"] for r in texts.groupBy("y").count().collect()}
    n_pos, n_neg = by_class.get(1, 0), by_class.get(0, 0)
    if not n_pos or not n_neg:
        machine = Machine([])
        machine.slope, machine.offset = 0.0, 500.0 if n_pos else -500.0
        return machine
    machine = Machine(informative(count_terms(texts), n_pos, n_neg))

    def kept_terms(part):
        row, term = terms(part)
        slots = machine._slots(term)
        return row[slots > 0], slots[slots > 0]

    got = sorted((r.y, bytes(r.features)) for r in feature_rows(texts, kept_terms).collect())  # at most ``sample`` rows
    got = [got[i] for i in np.random.default_rng(3).permutation(len(got))]
    y = np.array([g[0] for g in got], dtype=np.int64)
    rows = [np.frombuffer(g[1], dtype="<u4").astype(np.int64) for g in got]
    curve = np.arange(len(y)) % CURVE == CURVE - 1
    if len(set(y[curve].tolist())) < 2 or len(set(y[~curve].tolist())) < 2:
        curve = np.zeros(len(y), dtype=bool)             # too few rows to set some apart
    machine.fit([r for r, c in zip(rows, curve) if not c], y[~curve])
    on = curve if curve.any() else ~curve
    own = [r for r, c in zip(rows, on) if c]
    row = np.repeat(np.arange(len(own)), [len(r) for r in own])
    machine.slope, machine.offset = platt(machine.logits(np.concatenate(own), row, len(own)), y[on])
    return machine


def classify(docs: DataFrame, machine: Machine, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``predicted``; the machine's fixed size is its size bound."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    return score_texts(docs, lambda texts: shared.value.score(texts), text_col)
