"""Hashed word n-grams of whole texts, and follow-the-regularised-leader learning over them."""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Table, held_out, keep, text_bytes

BITS = 18  #: of a feature's index: 2**18 weights, 1 MB
_PIECE = re.compile(r"[^\W\d_]+|\d+|([^\w\s]|_)\1*")


def _pieces(word: bytes) -> bytes:
    """32-bit hashes of a word's letters (in lower case), digits and runs of one sign; capitals leave a mark."""
    out = []
    for m in _PIECE.finditer(word.decode("utf-8", "replace")):
        p = m[0]
        if p[0].isalpha():
            if len(p) > 1 and p.isupper():
                out.append("<U>")
            out.append(p.lower())
        else:
            out.append("<0>" if p[0].isdigit() else p[:3])
    return np.array([xxhash.xxh32_intdigest(p) for p in out], np.uint32).tobytes()


_PIECES = Table(_pieces, 300_000)
keep("features", _PIECES)


def ngrams(text: bytes) -> tuple[np.ndarray, int]:
    """Indices of all uni- and bigrams of pieces, repeats included; and how many pieces there are."""
    u = np.frombuffer(b"".join(map(_PIECES.__getitem__, text.split())), np.uint32)
    two = (u[:-1] * np.uint32(0x9E3779B1)) ^ ((u[1:] >> np.uint32(3)) * np.uint32(0x85EBCA77))
    shift = np.uint32(32 - BITS)
    return np.concatenate([(u * np.uint32(0xC2B2AE3D)) >> shift, (two * np.uint32(0x27D4EB2F)) >> shift]).astype(np.int64), len(u)


def mark(name: str) -> int:
    """Index of a feature that isn't an n-gram, such as a bucket of lengths."""
    return xxhash.xxh32_intdigest(name, seed=1) >> (32 - BITS)


class Ftrl:
    """Weights led by FTRL-proximal: a rate for each coordinate, L1 sparsity and L2 shrinkage.

    `bias` is one more coordinate, without L1.
    """

    def __init__(self, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.001, biases: int = 1):
        self.z, self.n = np.zeros((1 << BITS) + biases), np.zeros((1 << BITS) + biases)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray, l1: float | None = None) -> np.ndarray:
        z, l1 = self.z[at], self.l1 if l1 is None else l1
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def update(self, at: np.ndarray, w: np.ndarray, g: np.ndarray) -> None:
        """at: distinct coordinates with weights w and gradients g."""
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """Texts and labels (t, y) to learn from: rows not held out, at most `limit`, those of smallest hash.

    The limit bounds the fit's memory, in one task; the ids that pass it are at most `limit` rows, hence
    the broadcast. Null labels and ids are left out, repeated labels of one id count once, the largest.
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("y")).filter("id is not null and y is not null").filter(~held_out("id")).groupBy("id").agg(F.max("y").alias("y"))
    ids = ids.orderBy(F.xxhash64("id"), "id").limit(limit)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text_bytes().alias("t")).join(F.broadcast(ids), "id")
    return rows.orderBy(F.xxhash64("id", F.lit(7)), "id", "t").limit(limit).select("t", "y")
