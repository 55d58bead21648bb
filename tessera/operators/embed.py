"""Embeddings: an offline default by feature hashing, and any batch embedder through mapInPandas."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import token_set

BATCH, RETRIES = 24, 3


def hashed_counts(text: Column, dims: int = 64) -> Column:
    """Counts of a text's distinct tokens by bucket of their md5: `dims` integers."""
    # a bucket is a character, so that its tokens are counted by dropping it from one string
    signs = F.array(*(F.lit(chr(ord("0") + d)) for d in range(dims)))
    found = F.transform(token_set(text), lambda t: F.element_at(signs, (F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % dims + 1).cast("int")))
    return _bind(F.array_join(found, ""), lambda s: F.transform(signs, lambda c: F.length(s) - F.length(F.replace(s, c, F.lit("")))))


def _bind(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hashed_embedding(text: Column, dims: int = 64) -> Column:
    """hashed_counts of length 1; zeros for a text without tokens."""

    def unit(counts: Column) -> Column:
        norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x))
        return _bind(norm, lambda n: F.transform(counts, lambda x: F.when(n > 0, x / n).otherwise(0.0).cast("float")))

    return _bind(hashed_counts(text, dims), unit)


def batch_ranges(total: int, size: int) -> list[tuple[int, int]]:
    return [(i, min(i + size, total)) for i in range(0, total, size)] if size > 0 else []


def backoff_ms(attempt: int) -> int:
    return min(150 * 2 ** min(attempt, 6), 3000)


def embed(rows: DataFrame, embedder: Callable[[list[str]], list[list[float]]], text: str = "content", batch: int = BATCH, retries: int = RETRIES) -> DataFrame:
    """rows with a column `vector` from an embedder of text batches; order and count are kept, failures retried."""

    def run(frames):
        for pdf in frames:
            vectors: list[list[float]] = []
            texts = pdf[text].fillna("").tolist()
            for a, b in batch_ranges(len(texts), batch):
                for attempt in range(retries + 1):
                    try:
                        got = embedder(texts[a:b])
                        if len(got) != b - a:
                            raise ValueError(f"{len(got)} vectors for {b - a} texts")
                        break
                    except (OSError, ValueError):
                        if attempt == retries:
                            raise
                        time.sleep(backoff_ms(attempt) / 1000)
                vectors += got
            yield pdf.assign(vector=pd.Series(vectors, index=pdf.index, dtype=object))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{fields}, vector array<float>")
