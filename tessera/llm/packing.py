"""Packing by the online sum-of-squares rule.

Each task packs the documents of its own input partition, with no shuffle: a document's ids fill whole
windows as long as they last, and the rest goes to the fill level that minimises the sum of squares of
the counts of partially filled windows. The counts lie in an array over levels 1..capacity-1; the open
windows of a level, in a stack beside it. When the partition ends, the pieces in its open windows are written with their
ids, and further rounds pack those of many tasks by the same rule, the longest first, until one task is left; only what is
open at its end is cut and joined into full windows, and the last remainder is cut at powers of two, which need no padding.
Memory holds the open windows only, and those at most half of what one task of a later round is given: a task that has more
(documents that nothing fits beside) cuts and joins them into full ones, so that every round has at most half the tasks of
the one before. A retried task reads the same rows and makes the same windows.
"""

from __future__ import annotations

import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Table, batches, bounded_batches, cut, keep, sole

_PUNCTUATION = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_WORK = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])
#: Ids, of 4 bytes each, that a task of a later round is given.
MERGE = 1 << 24
_ROWS = 2000
#: The character by which byte-level merges name each byte: itself where that is printable, else from U+0100 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_VISIBLE = {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _PRINTED)}
_TOKENIZERS: dict[str, "WordTokenizer"] = {}
keep("packing", _TOKENIZERS)


class WordTokenizer:
    """Ids of a text as little-endian 32-bit bytes, made word by word from bounded tables.

    The vocabulary drops white space and never joins over it, nor over the border between a letter or
    digit and ASCII punctuation at a word's end, so words and their endings can be looked up apart.
    """

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(file)
        self.encode, self.merge = tokenizer.encode, tokenizer.model.tokenize
        self.core = Table(self._ids, 600_000)
        self.word = Table(self._word, 600_000)

    def _ids(self, text: bytes) -> bytes:
        """Letters alone are one piece for the merges, which are then called at once; the rest takes all steps."""
        if text.isalpha():
            return np.array([t.id for t in self.merge(text.decode().lower())], "<u4").tobytes()
        s = text.decode()
        if s.isalpha() and "Σ" not in s and (s := unicodedata.normalize("NFC", s).lower()).isalpha():
            return np.array([t.id for t in self.merge("".join(map(_VISIBLE.__getitem__, s.encode())))], "<u4").tobytes()
        return np.array(self.encode(s, add_special_tokens=False).ids, "<u4").tobytes() if s else b""

    def _word(self, word: bytes) -> bytes:
        core = word.rstrip(_PUNCTUATION)
        if len(core) < len(word) and core and (core[-1:].isalnum()):
            return self.core[core.lower() if core.isascii() else core] + self.core[word[len(core) :]]
        return self.core[word.lower() if word.isascii() else word]

    def __call__(self, text: bytes) -> bytes:
        if b"<|" in text:  # the vocabulary's own marks are found in the raw text, before anything else
            return self._ids(text)
        return b"".join(map(self.word.__getitem__, text.split()))


class SumOfSquares:
    """Online packing into windows of `capacity`, tracked in an array of counts by fill level."""

    def __init__(self, capacity: int):
        self.capacity, self.windows = capacity, 0
        self.count = np.zeros(capacity + 1)  # that of full windows stays 0
        self.closed = np.full(capacity + 1, np.inf)  # at levels without a window
        self.open: dict[int, list[list]] = {}

    def level(self, size: int) -> int:
        """The level, 0 for a new window, that keeps the sum of squared counts least; the fullest of equals."""
        n = self.capacity - size
        # from level h to h + size, N(h) falls and N(h + size) rises, which a full window doesn't
        gain = self.count[size:] - self.count[: n + 1] + self.closed[: n + 1]
        gain[n] -= 0.5
        gain[0] = self.count[size] - 0.5
        return n - int(np.argmin(gain[::-1]))

    def place(self, size: int, item) -> list | None:
        """Put an item of 1..capacity-1; the window if that fills it, else None."""
        h = self.level(size)
        window = self.open[h].pop() if h else []
        if h:
            self.count[h] -= 1
            if not self.count[h]:
                self.closed[h] = np.inf
        window.append(item)
        self.windows += (not h) - (h + size == self.capacity)
        if h + size == self.capacity:
            return window
        self.count[h + size] += 1
        self.closed[h + size] = 0
        self.open.setdefault(h + size, []).append(window)
        return None

    def rest(self) -> list[list]:
        """The windows still open, fullest first."""
        return [w for h in sorted(self.open, reverse=True) for w in self.open[h]]


class _Windows:
    """One task's packing: whole windows become result rows, pieces of open ones keep their ids."""

    def __init__(self, capacity: int, merge: int, step: int):
        self.capacity, self.packer, self.most = capacity, SumOfSquares(capacity), merge // (2 * capacity)
        self.base = step << 56 | TaskContext.get().partitionId() << 32
        self.made, self.rows = 0, []

    def emit(self, window: list[tuple]) -> None:
        at = 0
        for doc, start, total, ids in window:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.base + self.made, at, None))
            at += n
        self.made += 1

    def add(self, doc, start: int, total: int, ids: bytes) -> None:
        """A document's ids from `start`: whole windows as long as they last, the rest by the sum of squares."""
        size = 4 * self.capacity
        full = len(ids) - len(ids) % size
        for i in range(0, full, size):
            self.emit([(doc, start + i // 4, total, ids[i : i + size])])
        if full < len(ids) and (window := self.packer.place((len(ids) - full) // 4, (doc, start + full // 4, total, ids[full:]))):
            self.emit(window)
        if self.packer.windows > self.most:
            left, self.packer = self.packer.rest(), SumOfSquares(self.capacity)
            self.join([p for w in left for p in w], [])

    def join(self, pieces: list[tuple], ends: list[int]) -> None:
        """Cut and join pieces in order: full windows, then windows of the sizes in `ends`; without these, what is left stays open."""
        size = sum(len(p[3]) // 4 for p in pieces)
        cuts = [self.capacity] * (size // self.capacity) + ends
        window, room = [], 0
        for doc, start, total, ids in pieces:
            while ids:
                if not room:
                    if not cuts:
                        self.packer.place(len(ids) // 4, (doc, start, total, ids))
                        break
                    room = cuts.pop(0)
                take = ids[: 4 * room]
                window.append((doc, start, total, take))
                start, ids, room = start + len(take) // 4, ids[len(take) :], room - len(take) // 4
                if not room:
                    self.emit(window)
                    window = []

    def finish(self, last: bool) -> None:
        """The windows still open: their pieces with their ids, or, in the last task of all, cut without padding."""
        left = [p for w in self.packer.rest() for p in w]
        if not last:
            self.rows += [(doc, start, len(ids) // 4, zlib.crc32(ids), total, self.base, 0, ids) for doc, start, total, ids in left]
            return
        size = sum(len(p[3]) // 4 for p in left) % self.capacity
        self.join(left, [1 << k for k in range(self.capacity.bit_length(), -1, -1) if size >> k & 1])

    def flush(self):
        """The rows made since, in batches of bounded size."""
        rows, self.rows = self.rows, []
        for i in range(0, len(rows), _ROWS):
            yield batches(dict(zip(_WORK.names, zip(*rows[i : i + _ROWS], strict=True), strict=True)), _WORK)


def _first(file: str, capacity: int, merge: int, end_id: int):
    def run(it):
        sole("packing")
        if file not in _TOKENIZERS:
            _TOKENIZERS.clear()
            _TOKENIZERS[file] = WordTokenizer(file)
        ids_of, end = _TOKENIZERS[file], np.array([end_id], "<u4").tobytes()
        out = _Windows(capacity, merge, 0)
        for b in it:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("t").to_pylist(), strict=True):
                ids = ids_of(text) + end
                out.add(doc, 0, len(ids) // 4, ids)
            yield from out.flush()
        out.finish(False)
        yield from out.flush()

    return run


def _next(capacity: int, merge: int, step: int, last: bool):
    def run(it):
        out = _Windows(capacity, merge, step)
        for b in it:
            for row in zip(*(b.column(n).to_pylist() for n in ("doc_id", "start", "doc_tokens", "ids")), strict=True):
                out.add(*row)
            yield from out.flush()
        out.finish(last)
        yield from out.flush()

    return run


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", merge: int = MERGE) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null or empty text is the single end id; a null id stays null; repeated rows are packed each for
    itself; other columns are ignored; an empty table gives no rows. `capacity` must be a power of two for
    the remainder to need no padding. `merge`: ids in
    open windows that one task of a later round takes, about.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    work, done, step, tasks = texts.mapInArrow(_first(tokenizer_file, capacity, merge, end_id), kind), None, 0, 2
    while tasks > 1:
        work = cut(spark, work, f"packed-{step}")
        done = work if done is None else done.union(work)
        left = work.filter("ids is not null")
        tasks = max(1, -(-(left.agg(F.sum("length")).first()[0] or 0) // merge))
        step += 1
        # long pieces first: short ones then fill what these leave
        dealt = left.repartition(tasks, F.xxhash64("sequence_id", "ids_crc32", "doc_id", "start")).sortWithinPartitions(F.desc("length"), "ids_crc32", "doc_id", "start", "doc_tokens")
        work = dealt.mapInArrow(_next(capacity, merge, step, tasks == 1), kind)
    return done.filter("ids is null").union(work).drop("ids")
