"""Toxicity: cumulative-link ordinal regression over sparse text features, with one weight vector for all grades.

P(grade > k) = 1 / (1 + exp(theta_k - w.x)) for ordered thresholds theta_k. Labels name toxic documents
only; grades of toxic ones come from a first fit with one threshold: those with at least the median share
of learned evidence are graded 2 (severe), the others 1. The second fit then shares its weights across
both thresholds. Features are the presence of word pieces; a strong L1 leaves the telling ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import batches, bounded_batches, held_out, text_bytes
from .sparse_text import BITS, Ftrl, labelled_sample, ngrams

SAMPLE = 6000  #: labelled rows to fit on, at most
EPOCHS = 6
TOXIC = 0.3  #: P(grade > 0) from which a document is predicted toxic
GRADES = 3
_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("severity", pa.float64()), ("p_toxic", pa.float64()), ("grade", pa.int32()), ("predicted", pa.int32())])


def features(text: bytes) -> np.ndarray:
    at, n = ngrams(text)
    return np.unique(at[:n])


def above(score: float, thresholds: np.ndarray) -> np.ndarray:
    """P(grade > k) for each k."""
    return 1 / (1 + np.exp(np.clip(thresholds - score, -35, 35)))


def fit_ordinal(rows: list[np.ndarray], grades: list[int], top: int, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and `top` ascending thresholds, for grades 0..top."""
    model = Ftrl(alpha=1.0, l1=8.0)
    share = np.array([np.mean([g > k for g in grades] or [0]) for k in range(top)]).clip(0.001, 0.999)
    theta = np.log((1 - share) / share)
    seen = np.ones(top)
    for _ in range(epochs):
        for at, y in zip(rows, grades, strict=True):
            w = model.weights(at)
            p = above(w.sum(), theta)
            # P(y) is the difference of neighbouring tails; its log's slope in the score is 1 - p_above - p_below
            low = 1.0 if y == 0 else p[y - 1]
            high = 0.0 if y == top else p[y]
            model.update(at, w, np.full(len(at), -(1 - low - high)))
            slope = np.zeros(top)
            width = max(low - high, 1e-6)
            if y < top:
                slope[y] = -high * (1 - high) / width
            if y > 0:
                slope[y - 1] = low * (1 - low) / width
            seen += slope * slope
            theta = np.maximum.accumulate(theta - 0.1 * slope / np.sqrt(seen))
    return model.weights(np.arange(1 << BITS)).astype(np.float32), theta


def fit(texts: list[bytes], labels: list[int]) -> tuple[np.ndarray, np.ndarray]:
    rows = [features(t) for t in texts]
    w, theta = fit_ordinal(rows, labels, 1)
    evidence = [float(np.maximum(w[at], 0).sum()) for at in rows]
    toxic = [e for e, y in zip(evidence, labels, strict=True) if y]
    if len(set(toxic)) < 2:
        return w, np.append(theta, theta[-1] + 4)
    middle = np.median(toxic)
    return fit_ordinal(rows, [0 if not y else 2 if e >= middle else 1 for e, y in zip(evidence, labels, strict=True)], GRADES - 1)


def _fitter(it):
    texts, labels = [], []
    for b in it:
        texts += b.column("t").to_pylist()
        labels += b.column("y").to_pylist()
    w, theta = fit(texts, [int(y > 0) for y in labels])
    yield pa.record_batch([pa.array([w.tobytes()], pa.binary()), pa.array([theta.tolist()], pa.list_(pa.float64()))], names=["w", "theta"])


def _scorer(model):
    def run(it):
        w, theta = np.frombuffer(model.value[0], np.float32).astype(np.float64), np.array(model.value[1])
        for b in it:
            p = np.array([above(w[features(t)].sum(), theta) for t in b.column("t").to_pylist()]).reshape(-1, len(theta))
            each = np.hstack([np.ones((len(p), 1)), p]) - np.hstack([p, np.zeros((len(p), 1))])
            yield batches({"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "severity": p.sum(axis=1), "p_toxic": p[:, 0], "grade": each.argmax(axis=1).astype(np.int32), "predicted": (p[:, 0] >= TOXIC).astype(np.int32)}, _OUT)

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, severity (expected grade, 0..2), p_toxic, grade, predicted.

    predicted is 1 where p_toxic >= TOXIC. Null text scores as empty; a null id isn't held out; repeated rows
    score alike; other columns of either table are never read. Without labels nothing is toxic; an empty
    table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = labelled_sample(docs, labels, "toxic", sample).mapInArrow(_fitter, "w binary, theta array<double>").collect()
    model = (rows[0]["w"], list(rows[0]["theta"])) if rows else (np.zeros(1 << BITS, np.float32).tobytes(), [6.0, 10.0])
    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_bytes().alias("t"))
    return ready.mapInArrow(_scorer(spark.sparkContext.broadcast(model)), "doc_id long, held_out boolean, severity double, p_toxic double, grade int, predicted int")
