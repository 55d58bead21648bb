"""Substring dedup by level-wise doubling.

A window repeated at `window` words has repeated halves, so candidates are sought at half the length
first; only windows repeated at one length are extended to twice that length, until `window` is
reached or no candidate survives. At the first level a document offers not all of its windows but
those that are minimal by hash among the starts of some full window: equal full windows choose equal
parts, so nothing is lost, and about a tenth of the positions is shuffled.

Counting is a groupBy on the window's hash with partial sums, so a passage held by a third of all
documents costs one row for each task. What comes back to a document is the list of its own repeated
hashes, never longer than the document. The last level counts 128-bit hashes. Of documents with the same
text, all of whose windows are thus repeated, one stands for all from the second level on.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import ROLL, ROLL2, batches, bounded_batches, hashed_words, longs, slide, text_bytes

_COUNTED = pa.schema([("k", pa.int64()), ("h", pa.int64()), ("h2", pa.int64()), ("c", pa.int64())])


def levels(window: int) -> list[int]:
    """Lengths to look at: halves of `window`, rounded up, until one has at most 24 words; ascending. For 35: 18 and 35.

    A level of fewer words would shuffle more rows than it saves the next one, which is sampled.
    """
    out = [window]
    while out[0] > 24:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _anchors(x: np.ndarray, first: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first-level windows, and which of them are minimal in some full window."""
    h = ROLL.windows(ROLL.prefix(x), first)
    w = window - first + 1
    if len(h) < w:
        return h, np.zeros(len(h), bool)
    low = slide(h, w, np.minimum)
    edge = np.zeros(w - 1, np.uint64)
    return h, slide(np.concatenate([edge, low, edge]), w, np.maximum) == h


def _alive(x: np.ndarray, have: dict[int, np.ndarray], upto: int, lengths: list[int], window: int) -> np.ndarray:
    """Starts of windows of lengths[upto] that hold a surviving window of each length before."""
    first = lengths[0]
    h, chosen = _anchors(x, first, window)
    ok = chosen & np.isin(h, have[0])
    for level in range(1, upto + 1):
        wide = lengths[level] - lengths[level - 1] + 1
        if len(ok) < wide:
            return np.zeros(0, bool)
        ok = slide(ok.astype(np.uint8), wide, np.maximum).astype(bool)
        if level < upto:
            p = ROLL.prefix(x)
            ok &= np.isin(ROLL.windows(p, lengths[level]), have[level])
    return ok


def _ints(cell) -> np.ndarray:
    return np.asarray(cell.values, dtype=np.int64).view(np.uint64) if cell.is_valid else np.zeros(0, np.uint64)


def _counter(level: int, lengths: list[int], window: int):
    def run(it):
        for b in it:
            col = {n: b.column(n) for n in b.schema.names}
            out: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
            for i, x in enumerate(hashed_words(b.column("t"))):
                if len(x) < window or level and not (all(col[f"r{j}"][i].is_valid for j in range(level)) and col["first"][i].as_py() is not False):
                    continue
                if not level:
                    h, take = _anchors(x, lengths[0], window)
                else:
                    have = {j: _ints(col[f"r{j}"][i]) for j in range(level)}
                    h, take = ROLL.windows(ROLL.prefix(x), lengths[level]), _alive(x, have, level, lengths, window)
                at = np.flatnonzero(take)
                if not len(at):
                    continue
                h, at, n = _unique(h, at)
                if level and col["first"][i].as_py():
                    n = n + 1
                h2 = ROLL2.windows(ROLL2.prefix(x), lengths[level])[at] if level == len(lengths) - 1 else np.zeros(len(h), np.uint64)
                out.append((col["k"][i].as_py(), h, h2, n))
            if out:
                k = np.repeat(np.array([o[0] for o in out], np.int64), [len(o[1]) for o in out])
                yield batches({"k": longs(k), "h": longs(np.concatenate([o[1] for o in out])), "h2": longs(np.concatenate([o[2] for o in out])), "c": pa.array(np.concatenate([o[3] for o in out]).astype(np.int64))}, _COUNTED)

    return run


def _unique(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    u, first, n = np.unique(h[at], return_index=True, return_counts=True)
    return u, at[first], n


def _finisher(window: int, columns: list[str], schema: pa.Schema, lengths: list[int]):
    last = len(lengths) - 1

    def run(it):
        for b in it:
            col = {n: b.column(n) for n in b.schema.names}
            words_n, removed_n, digest, spans = [], [], [], []
            for i, (text, x) in enumerate(zip(col["t"].to_pylist(), hashed_words(b.column("t")), strict=True)):
                words = text.split()
                gone = np.zeros(0, np.int64)
                found: list[list[int]] = []
                if col["first"][i].is_valid and len(words) >= window:
                    found, gone = [[0, len(words)]], words
                elif col[f"r{last}"][i].is_valid:
                    hit = np.isin(ROLL.windows(ROLL.prefix(x), window), _ints(col[f"r{last}"][i]))
                    edge = np.zeros(window - 1, np.uint8)
                    cover = slide(np.concatenate([edge, hit.astype(np.uint8), edge]), window, np.maximum).astype(np.int8)
                    step = np.diff(np.concatenate([[0], cover, [0]]).astype(np.int8))
                    found = [[int(s), int(e)] for s, e in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True)]
                    gone = np.flatnonzero(cover)
                kept = words
                if found:
                    kept, at = [], 0
                    for s, e in found:
                        kept += words[at:s]
                        at = e
                    kept += words[at:]
                words_n.append(len(words))
                removed_n.append(len(gone))
                digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                spans.append(found)
            made = {"n_words": words_n, "n_removed": removed_n, "kept_sha256": digest, "removed_spans": spans}
            yield batches({n: (made[n] if n in made else col[n]) for n in columns}, schema)

    return run


def repeated_spans(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_words, n_removed, kept_sha256, removed_spans [[start, end), ...].

    Null text counts as no words; a null id stays null; repeated rows each get a row, and their windows
    repeat each other; other columns are ignored, so clashing names do no harm; an empty table gives none.
    Texts shorter than `window` words keep everything.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    lengths = levels(window)
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("t")).withColumn("k", F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "t"))
    # copies of a text: the one with the smallest key stands for all; rows that are equal in id, too, share a key
    same = keyed.select("k", F.sha1("t").alias("s")).groupBy("s", "k").agg(F.count("*").alias("n"))
    crowd = same.groupBy("s").agg(F.sum("n").alias("n"), F.min("k").alias("rep")).filter("n > 1")
    copies = same.select("s", "k").join(crowd, "s").select("k", (F.col("k") == F.col("rep")).alias("first"))
    have, lists = keyed.select("k", "t"), None
    for level in range(len(lengths)):
        counted = have.mapInArrow(_counter(level, lengths, window), "k long, h long, h2 long, c long")
        key = ["h", "h2"] if level == len(lengths) - 1 else ["h"]
        twice = counted.groupBy(*key).agg(F.sum("c").alias("n")).filter("n >= 2").drop("n")
        own = counted.select("k", *key).join(twice, key).groupBy("k").agg(F.collect_set("h").alias(f"r{level}"))
        lists = own if lists is None else lists.join(own, "k", "left")
        have = keyed.join(lists, "k", "left").join(copies, "k", "left").select("doc_id", "k", "t", "first", *(f"r{j}" for j in range(level + 1)))
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256", "removed_spans"]
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("removed_spans", pa.list_(pa.list_(pa.int64())))])
    return have.mapInArrow(_finisher(window, columns, schema, lengths), "doc_id long, n_words long, n_removed long, kept_sha256 string, removed_spans array<array<long>>")
