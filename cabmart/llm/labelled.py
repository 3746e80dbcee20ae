"""What the two text classifiers share: labelled rows, and scoring every text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import free_name
from .words import runs


def sample_rows(labels: DataFrame, label_col: str, n: int, id_col: str = "doc_id",
                held_out: Column | None = None) -> DataFrame:
    """At most ``n`` labelled ids, in the order of a hash of the id: (``id_col``, ``y``).

    Rows without an id, with a label other than 0 or 1, or held out are left out.
    """
    keep = F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)
    if held_out is not None:
        keep &= ~held_out
    return (labels.filter(keep).select(id_col, F.col(label_col).cast("int").alias("y")).distinct()
            .orderBy(F.xxhash64(F.col(id_col)), F.col(id_col), F.col("y")).limit(n))


def sample_texts(docs: DataFrame, sample: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``y``, ``text``) of the sampled ids; the sample is bounded, so it is broadcast.

    Of rows that share an id one text counts, so the result is bounded as well.
    """
    return (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
            .join(F.broadcast(sample.select(F.col(id_col).alias("_id"), "y")), "_id")
            .groupBy("_id", "y").agg(F.min("text").alias("text")).select("y", "text"))


def feature_rows(texts: DataFrame, features) -> DataFrame:
    """(``y``, ``features`` binary): the sorted distinct features of each text as 32-bit integers.

    ``features(list of bytes)`` gives (text number, feature) arrays, sorted and distinct.
    """
    def run(batches):
        for batch in batches:
            y = batch.column(0).to_pylist()
            rows = []
            for part in runs([(t or "").encode() for t in batch.column(1).to_pylist()]):
                text, feature = features(part)
                cuts = np.searchsorted(text, np.arange(1, len(part)))
                rows += [f.astype("<u4").tobytes() for f in np.split(feature, cuts)]
            yield pa.RecordBatch.from_arrays([pa.array(y, type=pa.int32()), pa.array(rows, type=pa.binary())],
                                             names=["y", "features"])

    return texts.select("y", "text").mapInArrow(run, "y int, features binary")


def score_texts(docs: DataFrame, scorer, text_col: str = "text", score_col: str = "score",
                predicted_col: str = "predicted") -> DataFrame:
    """``docs`` with a score (0 to 1) and the decision of every whole text.

    ``scorer(list of bytes)`` gives an array of scores.  Taken names get underscores in front.
    """
    score_col, predicted_col = free_name(docs, score_col), free_name(docs, predicted_col)
    column = docs.columns.index(text_col)
    schema = T.StructType(docs.schema.fields + [T.StructField(score_col, T.DoubleType()),
                                                T.StructField(predicted_col, T.IntegerType())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [(t or "").encode() for t in part.column(column).to_pylist()]
                score = np.concatenate([scorer(r) for r in runs(texts)])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(score, type=pa.float64()),
                     pa.array((score >= 0.5).astype(np.int32), type=pa.int32())], names=schema.names)

    return docs.mapInArrow(run, schema)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def platt(margin: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and offset of the logistic curve from margins to probabilities (Newton, smoothed targets)."""
    pos, neg = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * margin + b)
        g, w = p - target, np.maximum(p * (1 - p), 1e-9)
        ga, gb = (g * margin).sum() + 1e-3 * (a - 1), g.sum()
        haa, hab, hbb = (w * margin * margin).sum() + 1e-3, (w * margin).sum(), w.sum()
        det = haa * hbb - hab * hab
        if det <= 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        scale = min(1.0, 2 / max(abs(da), abs(db), 1e-12))
        a, b = a - scale * da, b - scale * db
        if max(abs(da), abs(db)) < 1e-8:
            break
    return float(a), float(b)
