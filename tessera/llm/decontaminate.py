"""Benchmark decontamination by template canonicalisation.

Numbers, names and units of a text become typed placeholders; windows of the resulting templates are looked
up in a hash table of the benchmark's. Runs of matching windows on one alignment are then checked token by
token, and their slots for consistency: one benchmark value stands for one value of the document and back,
kind by kind, and no more than half of an alignment may have other values. A re-parameterised question
passes, a text that only has the same shape does not. Where the slots fail, windows that are equal token by
token count all the same.

Two forms of a text are looked up. In the first every name is a placeholder a word, except at the start of a
sentence. In the second a run of names is one placeholder, and capitalised words that start a sentence are
names too: there names may change at any place, and for names of another number of words.

The documents are read once, without a shuffle. The benchmark's windows are sent to the executors in blocks
of a fixed number of windows; a larger benchmark takes more blocks, each with a pass of its own.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import ROLL, Table, batches, bounded_batches, keep, sole, text_bytes

WINDOW = 13  #: tokens; shorter items are looked up whole
LEAST = 5  #: items with fewer tokens are too short to tell and match nothing
COVER, RUN = 0.5, 30  #: a hit covers that share of an item, or so many of its tokens
BLOCK = 200_000  #: windows of the benchmark that are sent at once
_UNITS = "kg g mg km cm mm mi mile miles ft feet inch inches lb lbs oz l ml hours hour minutes minute seconds second days day weeks week months month years year dollars euros pounds cents usd eur gbp percent degrees mph kmh".split()
_NUMBER = re.compile(r"\d[\d.,:/'-]*(?:[a-z%°]{1,3})?")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_END = re.compile(r"[.!?][\"')\]»]*$")
_NUM, _UNIT, _CAP, _LAST = 1, 2, 4, 8
_VALUE = np.uint64(2**64 - 16)
_HIT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("covered", pa.int32()), ("item_tokens", pa.int32()), ("slots", pa.int32()), ("kind", pa.string())])


def _token(word: bytes) -> bytes:
    """A word's hash in lower case, its lowest four bits being flags; nothing for words of signs only."""
    s = word.decode("utf-8", "replace")
    core = _EDGE.sub("", s)
    if not core:
        return b""
    low = core.lower()
    flags = _NUM if _NUMBER.fullmatch(low) else _UNIT if low in _UNITS else 0
    flags |= (_CAP if len(core) > 1 and core[0].isupper() and core[1:].islower() else 0) | (_LAST if _END.search(s) else 0)
    return ((xxhash.xxh64_intdigest(low) & (2**64 - 16)) | flags).to_bytes(8, "little")


_TOKENS = Table(_token, 400_000)


def tokens(text: bytes) -> np.ndarray:
    return np.frombuffer(b"".join(map(_TOKENS.__getitem__, text.split())), np.uint64)


def template(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens with placeholders, and each token's kind: 0 literal, 1 number, 2 unit (after a number), 3 name."""
    flags = (v & np.uint64(15)).astype(np.uint8)
    before = np.concatenate([[_LAST], flags[:-1]]).astype(np.uint8)
    kind = np.where(flags & _NUM, 1, np.where((flags & _UNIT > 0) & (before & _NUM > 0), 2, np.where((flags & _CAP > 0) & (before & _LAST == 0), 3, 0)))
    return np.where(kind > 0, kind.astype(np.uint64), v & _VALUE), kind


def collapsed(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The template in which any capitalised word is a name and a run of names within a sentence one unit.

    Units with placeholders, each unit's kind, and the token at which each starts, with the end of all.
    """
    flags = (v & np.uint64(15)).astype(np.uint8)
    t, kind = template(v)
    name = (kind == 3) | ((kind == 0) & (flags & _CAP > 0))
    first = np.ones(len(v), bool)
    first[1:] = ~(name[1:] & name[:-1] & (flags[:-1] & _LAST == 0))
    start = np.flatnonzero(first)
    return np.where(name, np.uint64(3), t)[start], np.where(name, 3, kind)[start], np.append(start, len(v))


def unit_values(v: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A hash of each unit's tokens; a single token's is its own."""
    prefix = ROLL.prefix(v & _VALUE)
    return (prefix[start[1:]] - prefix[start[:-1]]) * ROLL.back[start[:-1]]


def literal(j: np.ndarray) -> np.ndarray:
    """Of the ascending places j those in runs of at least WINDOW neighbours."""
    ends = np.flatnonzero(np.diff(j) != 1) + 1
    runs = [r for r in np.split(j, ends) if len(r) >= WINDOW]
    return np.concatenate(runs) if runs else j[:0]


class Block:
    """Hash tables of some items' template windows, for each form and length."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.items, found = [], {}
        for item, text in items:
            v = tokens(text)
            if len(v) < LEAST:
                continue
            t, kind = template(v)
            units, unit_kind, unit_start = collapsed(v)
            at = len(self.items)
            self.items.append((item, len(v), ((v & _VALUE, t, kind, np.arange(len(v) + 1)), (unit_values(v, unit_start), units, unit_kind, unit_start))))
            forms = [(0, t)]
            if v[0] & np.uint64(_CAP):  # in a document, what stands before may make this word a name
                forms.append((0, np.concatenate([[np.uint64(3)], t[1:]])))
            if len(units) >= LEAST:
                forms.append((1, units))
            for i, (which, form) in enumerate(forms):
                length = min(WINDOW, len(form))
                h = ROLL.windows(ROLL.prefix(form), length)
                for start in range(len(h) if i == 0 or which else 1):
                    found.setdefault((which, length), []).append((int(h[start]), at, start))
        self.tables = {}
        for key, rows in found.items():
            rows.sort()
            h, at, start = (np.array(c, d) for c, d in zip(zip(*rows, strict=True), (np.uint64, np.int64, np.int64), strict=True))
            maybe = np.zeros(1 << 20, bool)
            maybe[(h >> np.uint64(44)).astype(np.int64)] = True
            self.tables[key] = (h, at, start, maybe)

    def alignments(self, which: int, t: np.ndarray) -> dict[tuple[int, int], set[int]]:
        """(item, shift) -> the item's units in windows that it shares with the document, in one form."""
        prefix = ROLL.prefix(t)
        runs: dict[tuple[int, int], set[int]] = {}
        for (form, length), (h, at, start, maybe) in self.tables.items():
            if form != which:
                continue
            mine = ROLL.windows(prefix, length)
            i = np.flatnonzero(maybe[(mine >> np.uint64(44)).astype(np.int64)])
            if not len(i):
                continue
            lo, hi = np.searchsorted(h, mine[i], "left"), np.searchsorted(h, mine[i], "right")
            for p, a, b in zip(i[hi > lo], lo[hi > lo], hi[hi > lo], strict=True):
                for k in range(a, b):
                    runs.setdefault((int(at[k]), int(p) - int(start[k])), set()).update(range(start[k], start[k] + length))
        return runs

    def hits(self, text: bytes):
        """(item_id, covered, item_tokens, slots, kind) of each item found in the text."""
        v = tokens(text)
        if len(v) < LEAST:
            return []
        best: dict[int, list] = {}
        enough = lambda at: at in best and len(best[at][0]) >= min(RUN, COVER * self.items[at][1])
        for which in (0, 1):
            t, start = (template(v)[0], np.arange(len(v) + 1)) if which == 0 else collapsed(v)[::2]
            runs = self.alignments(which, t)
            if not runs:
                continue
            values = unit_values(v, start)
            done = {at for at, _ in runs if enough(at)}
            for (at, shift), cover in runs.items():
                if at in done:  # found in the first form
                    continue
                value, form, item_kind, item_start = self.items[at][2][which]
                j = np.array(sorted(cover))
                here = values[j + shift]
                same = (t[j + shift] == form[j]) | ((j == 0) & (here == value[j]))
                # a run of names at the item's edge may go on in the document beyond it
                edge = (item_kind[j] == 3) & ((j == 0) | (j == len(form) - 1))
                same &= ~(edge & (np.diff(start)[j + shift] > np.diff(item_start)[j]))
                j, here = j[same], here[same]
                slot = item_kind[j] > 0
                pairs = set(zip(item_kind[j][slot].tolist(), value[j][slot].tolist(), here[slot].tolist(), strict=True))
                equal = here == value[j]
                if len({(k, x) for k, x, _ in pairs}) < len(pairs) or len({(k, y) for k, _, y in pairs}) < len(pairs) or 2 * (~equal).sum() > len(j):
                    kept = literal(j[equal])
                    if not len(kept):
                        continue
                    j, slot = kept, item_kind[kept] > 0
                old = best.setdefault(at, [set(), 0, False])
                old[0].update(k for u in j.tolist() for k in range(item_start[u], item_start[u + 1]))
                old[1] = max(old[1], int(slot.sum()))
                old[2] |= bool(equal.all())
        return sorted((self.items[at][0], len(cover), self.items[at][1], slots, "exact" if exact else "template") for at, (cover, slots, exact) in best.items() if enough(at))


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text"):
    """The benchmark's items, in lists of at most BLOCK windows (or one item), read as a stream."""
    items, size = [], 0
    for r in benchmark.filter(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("binary").alias("t")).toLocalIterator():
        n = len(r["t"]) // 2
        if items and size + n > 8 * BLOCK:
            yield items
            items, size = [], 0
        items.append((r["i"], bytes(r["t"])))
        size += n
    if items:
        yield items


_BUILT: dict[int, Block] = {}
keep("decontaminate", _BUILT, _TOKENS)


def _built(cast) -> Block:
    sole("decontaminate")
    if cast.id not in _BUILT:
        _BUILT.clear()
        _BUILT[cast.id] = Block(cast.value)
    return _BUILT[cast.id]


class _Cast:
    """A broadcast and a name for it, by which a worker keeps what it built of it."""

    def __init__(self, spark, items):
        self.broadcast = spark.sparkContext.broadcast(items)
        self.id = xxhash.xxh64_intdigest(repr([(i, len(t), xxhash.xxh64_intdigest(t)) for i, t in items]))

    @property
    def value(self):
        return self.broadcast.value


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and benchmark item found in it: doc_id, item_id, covered, item_tokens, slots, kind.

    covered: the item's tokens found; slots: placeholders among them; kind: `exact` where their values are
    the item's own, else `template`. Null texts on either side match nothing; null item ids are left out, a
    null doc_id stays null; repeated rows are reported each; other columns are ignored; empty tables give none.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("t"))
    schema = "doc_id long, item_id long, covered int, item_tokens int, slots int, kind string"
    out = None
    for items in blocks(benchmark):
        cast = _Cast(spark, items)

        def run(it, cast=cast):
            block = _built(cast)
            for b in it:
                rows = [(d, *h) for d, t in zip(b.column("doc_id").to_pylist(), b.column("t").to_pylist(), strict=True) for h in block.hits(t)]
                if rows:
                    yield batches(dict(zip(_HIT.names, zip(*rows, strict=True), strict=True)), _HIT)

        part = ready.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], schema) if out is None else out


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, unchanged, in which no benchmark item is found; rows with null text stay."""
    spark = docs.sparkSession
    bounded_batches(spark)
    for items in blocks(benchmark):
        cast = _Cast(spark, items)

        def run(it, cast=cast):
            block = _built(cast)
            for b in it:
                texts = b.column("text").cast(pa.binary()).to_pylist()
                yield b.filter(pa.array([t is None or not block.hits(t) for t in texts], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
