"""Quality classifier: logistic regression over hashed word n-grams, learned by FTRL, scored as dot products.

A document's features are its uni- and bigrams of word pieces by their share, and marks for the bucket of
its length and of its share of distinct pieces. The model is fitted in one task on a bounded sample of
labelled rows and reaches the executors as 2**18 weights (1 MB); scoring is one pass without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import batches, bounded_batches, held_out, text_bytes
from .sparse_text import BITS, Ftrl, labelled_sample, mark, ngrams

#: Labelled rows to fit on, at most.
SAMPLE = 5000
EPOCHS = 4
_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct indices and their values."""
    at, n = ngrams(text)
    u, c = np.unique(at, return_counts=True)
    ones = len(np.unique(at[:n]))
    marks = [mark(f"length{n.bit_length()}"), mark(f"distinct{n.bit_length()}:{10 * ones // n if n else 0}")]
    return np.concatenate([u, marks]), np.concatenate([8.0 * np.sqrt(c / max(1, n)), [0.3, 1.0]])


def _once(at: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, inv = np.unique(at, return_inverse=True)
    return u, np.bincount(inv, v)


def fit(texts: list[bytes], labels: list[int], epochs: int = EPOCHS) -> np.ndarray:
    """Weights, the bias last."""
    model, bias = Ftrl(alpha=0.15, l1=0.05), np.array([1 << BITS])
    rows = [_once(*features(t)) for t in texts]
    for _ in range(epochs):
        for (at, v), y in zip(rows, labels, strict=True):
            w, b = model.weights(at), model.weights(bias, 0.0)
            p = 1 / (1 + np.exp(-np.clip(w @ v + b[0], -35, 35)))
            model.update(at, w, (p - y) * v)
            model.update(bias, b, np.array([p - y]))
    out = model.weights(np.arange((1 << BITS) + 1))
    out[-1] = model.weights(bias, 0.0)[0]
    return out.astype(np.float32)


def _fitter(it):
    texts, labels = [], []
    for b in it:
        texts += b.column("t").to_pylist()
        labels += b.column("y").to_pylist()
    yield pa.record_batch([pa.array([fit(texts, [int(y > 0) for y in labels]).tobytes()], pa.binary())], names=["w"])


def _scorer(weights):
    def run(it):
        w = np.frombuffer(weights.value, np.float32).astype(np.float64)
        for b in it:
            score = []
            for t in b.column("t").to_pylist():
                at, v = features(t)
                score.append(1 / (1 + np.exp(-np.clip(w[at] @ v + w[-1], -35, 35))))
            s = np.array(score)
            yield batches({"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "score": s, "predicted": (s >= 0.3).astype(np.int32)}, _OUT)

    return run


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score (0..1), predicted (score >= 0.3).

    Null text scores as empty; a null id isn't held out; repeated rows score alike; other columns of either
    table are never read. Without any label the score is 0.5 throughout; an empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = labelled_sample(docs, labels, "quality", sample).mapInArrow(_fitter, "w binary").collect()
    weights = rows[0]["w"] if rows else np.zeros((1 << BITS) + 1, np.float32).tobytes()
    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_bytes().alias("t"))
    return ready.mapInArrow(_scorer(spark.sparkContext.broadcast(weights)), "doc_id long, held_out boolean, score double, predicted int")
