"""Quality classifier: naive Bayes support vectors (operator 3).

Every text becomes a set of n-gram indicators, hashed to ``BUCKETS``: words and
word pairs, runs of up to four word *forms* (letter case, trailing signs,
digits, repetition of a word before), and forms by the share of the text they
make up.  Each indicator is scaled by the log ratio of its smoothed share in
the two classes; a linear model with hinge loss is then fitted to the scaled
indicators by dual coordinate descent, and its margin is turned into a
probability by a logistic curve fitted on rows that the model did not see.

The model is fitted on at most ``SAMPLE`` labelled rows (in the order of a
hash of the id), whose indicators come to the driver: a few MB, however large
the tables are.  Texts are scored where they lie, in one pass.

Defined results: a null text counts as empty, and an empty text has one
indicator of its own; labels other than 0 and 1, or without an id, teach
nothing; if either class has no row the score is the share of class 1 (0.5
without any row); repeated rows are scored each for itself; an empty table
gives an empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame

from .labelled import feature_rows, platt, sample_rows, sample_texts, score_texts, sigmoid
from .words import Words, distinct, mix, ngrams

BUCKETS = 1 << 18
#: Labelled rows used for the fit.
SAMPLE = 8000
#: Weight of the loss against the norm of the weights, and passes over the rows.
COST, PASSES = 1.0, 20
#: Each so many-th row of the sample fits the curve instead of the model.
CURVE = 5

_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True


def _forms(w: Words, h: np.ndarray) -> np.ndarray:
    """A small hash of how each word looks and whether it repeats one of the two before it."""
    upto = lambda mask: np.concatenate(([0], np.cumsum(mask[w.raw])))
    upper, letter, digit = upto(_UPPER), upto(_LETTER), upto(_DIGIT)
    n_upper, n_letter = upper[w.end] - upper[w.start], letter[w.end] - letter[w.start]
    n_digit = digit[w.end] - digit[w.start]
    size = w.end - w.start
    case = np.where(n_upper == 0, 0, np.where(n_upper == 1, 1, np.where(2 * n_upper >= n_letter, 3, 2)))
    last, before = w.raw[w.end - 1], w.raw[np.maximum(w.end - 2, 0)]
    sign = np.where(_LETTER[last] | _DIGIT[last], 0, last.astype(np.int64))
    sign += np.where((sign > 0) & (size > 1) & ~_LETTER[before] & ~_DIGIT[before], 256, 0)
    numeric = np.where(n_digit == 0, 0, np.where(n_letter == 0, 1, 2))
    letters = np.where(n_letter == 0, 0, np.where(n_letter > 20, 2, 1))
    same = np.zeros(len(h), dtype=np.int64)
    for back in (2, 1):
        again = (h[back:] == h[:-back]) & (w.text[back:] == w.text[:-back])
        same[back:][again] = back
    return (((sign * 4 + case) * 3 + numeric) * 3 + letters) * 3 + same


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, indicator) of every distinct indicator of each text, sorted."""
    w = Words(texts)
    h = w.hashes()
    form = mix(_forms(w, h).astype(np.uint64) + np.uint64(1 << 20))
    found = [(w.text, mix(h ^ np.uint64(1)))]
    pair, of = ngrams(h, w.text, 2)
    found.append((of, mix(pair ^ np.uint64(2))))
    for n in (1, 2, 3, 4):
        gram, of = ngrams(form, w.text, n)
        found.append((of, mix(gram ^ np.uint64(10 + n))))
        if n < 3 and len(gram):
            order = np.lexsort((gram, of))
            g, o = gram[order], of[order]
            first = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (o[1:] != o[:-1]))))
            share = np.diff(np.append(first, len(g))) / w.counts[o[first]]
            for step, least in enumerate((0.02, 0.08, 0.25, 0.5)):
                hit = first[share >= least]
                found.append((o[hit], mix(g[hit] ^ np.uint64(100 * n + step))))
    length = np.floor(np.log2(w.counts + 1)).astype(np.uint64)
    found.append((np.arange(len(texts)), mix(length + np.uint64(1 << 40))))
    text = np.concatenate([f[0] for f in found]).astype(np.uint64)
    key = (text << np.uint64(18)) | (np.concatenate([f[1] for f in found]) % np.uint64(BUCKETS))
    key = distinct(key)
    return (key >> np.uint64(18)).astype(np.int64), (key & np.uint64(BUCKETS - 1)).astype(np.int64)


def log_ratio(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Log of the ratio of each indicator's smoothed share in class 1 and in class 0."""
    counts = [1.0 + np.bincount(np.concatenate([r for r, k in zip(rows, y) if k == c]), minlength=BUCKETS)
              for c in (0, 1)]
    seen = (counts[0] + counts[1]) > 2
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    return np.where(seen, ratio, 0.0)


def hinge_fit(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: float = COST,
              passes: int = PASSES) -> np.ndarray:
    """Weights of the scaled indicators: L1-loss linear support vectors by dual coordinate descent."""
    sign = np.where(y == 1, 1.0, -1.0)
    # The rarer class weighs as much as the other.
    most = np.where(y == 1, (y == 0).sum(), (y == 1).sum()) / len(y) * 2 * cost
    square = np.array([(v := scale[r]) @ v for r in rows])
    alpha, weights = np.zeros(len(y)), np.zeros(BUCKETS)
    rng = np.random.default_rng(7)
    for _ in range(passes):
        moved = 0.0
        for i in rng.permutation(len(y)):
            if square[i] == 0:
                continue
            values = scale[rows[i]]
            gradient = sign[i] * (weights[rows[i]] @ values) - 1
            after = min(max(alpha[i] - gradient / square[i], 0.0), most[i])
            if after != alpha[i]:
                weights[rows[i]] += (after - alpha[i]) * sign[i] * values
                moved = max(moved, abs(after - alpha[i]) / most[i])
                alpha[i] = after
        if moved < 1e-3:
            break
    return weights * scale


class Model:
    def __init__(self, weights: np.ndarray, slope: float, offset: float):
        self.weights, self.slope, self.offset = weights.astype(np.float32), slope, offset

    def score(self, texts: list[bytes]) -> np.ndarray:
        text, feature = features(texts)
        margin = np.bincount(text, weights=self.weights[feature], minlength=len(texts))
        return sigmoid(self.slope * margin + self.offset)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", held_out: Column | None = None,
        sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on a bounded sample of the labelled rows that are not ``held_out``."""
    texts = sample_texts(docs, sample_rows(labels, label_col, sample, id_col, held_out), id_col, text_col)
    # At most ``sample`` rows, taken one at a time: the driver holds them once, as the numbers that came.
    got = sorted((r.y, bytes(r.features)) for r in feature_rows(texts, features).toLocalIterator())
    rng = np.random.default_rng(3)
    got = [got[i] for i in rng.permutation(len(got))]
    y = np.array([g[0] for g in got], dtype=np.int64)
    rows = [np.frombuffer(g[1], dtype="<u4") for g in got]
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        return Model(np.zeros(BUCKETS), 0.0, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    curve = np.arange(len(y)) % CURVE == CURVE - 1
    if len(set(y[curve].tolist())) < 2 or len(set(y[~curve].tolist())) < 2:
        curve = np.zeros(len(y), dtype=bool)             # too few rows to set some apart
    own = [r for r, c in zip(rows, curve) if not c]
    scale = log_ratio(own, y[~curve])
    weights = hinge_fit(own, y[~curve], scale)
    on = curve if curve.any() else ~curve
    margin = np.array([weights[r].sum() for r, c in zip(rows, on) if c])
    return Model(weights, *platt(margin, y[on]))


def classify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``predicted``; the model's fixed size is its size bound."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return score_texts(docs, lambda texts: shared.value.score(texts), text_col)
