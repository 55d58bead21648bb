"""What several operators use: table access, row keys, shared storage, and rolling word hashes."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch: with texts of some KB it bounds a Python worker's memory.
BATCH_ROWS = 2000
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Bound Arrow batches by rows and by bytes, for long texts; smaller settings of the session stay.

    Spark reads both settings when a query runs, which is after this returns, so they stay lowered.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = str(spark.conf.get(key)).lower().removesuffix("b")
        now = int(now) if now.lstrip("-").isdigit() else 0
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share, as a URI.

    A setting without a scheme is a path of the session's default file system. Where the session has no such setting
    (tests on one machine), a folder under the warehouse is taken.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    fs, path = _hadoop(spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    uri = fs.makeQualified(path).toString()
    return "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri


def _hadoop(spark: SparkSession, uri: str):
    """The file system of a URI, and its path there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def cut(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write df to shared storage and read it back: its lineage ends there and survives lost executors."""
    path = shared_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(*cuts: DataFrame | None) -> None:
    """Delete tables that cut() wrote, once all that was made of them is itself written."""
    for df in cuts:
        if df is not None and hasattr(df, "cut_path"):
            fs, path = _hadoop(df.sparkSession, df.cut_path)
            fs.delete(path, True)


def held_out(col: str = "doc_id") -> Column:
    """True where crc32 of the id as text is divisible by 5; rows without id are not held out."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def text_bytes(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


class Table(dict):
    """Word -> value, made on first sight. Only the first `limit` words are kept, which bounds memory."""

    def __init__(self, make, limit: int = 400_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, word):
        value = self.make(word)
        if len(self) < self.limit:
            self[word] = value
        return value


_KEPT: dict[str, list[dict]] = {}


def keep(owner: str, *tables: dict) -> None:
    """Name the tables that an operator's tasks leave in a Python worker for its next tasks."""
    _KEPT.setdefault(owner, []).extend(tables)


def sole(*owners: str) -> None:
    """Empty the tables of all other operators: workers are reused, and would hold those of each operator they ran."""
    for owner, tables in _KEPT.items():
        if owner not in owners:
            for t in tables:
                t.clear()


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CHUNK = 1 << 18  #: bytes of text that are hashed at a time


def spread(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits over the word (a finaliser of xor-shifts and products)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Rolling:
    """Hashes of all windows of a length, by prefix sums of a polynomial modulo 2**64."""

    def __init__(self, base: int):
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 2**64))
        self.power = self.back = np.ones(1, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """At least n powers of the base, and of its inverse."""
        if n > len(self.power):
            size = 1 << (n - 1).bit_length()
            self.power = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, self.base))])
            self.back = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, self.inverse))])
        return self.power, self.back

    def prefix(self, x: np.ndarray) -> np.ndarray:
        n = len(x)
        self.powers(n)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(x * self.power[:n], out=out[1:])
        return out

    def windows(self, prefix: np.ndarray, length: int) -> np.ndarray:
        if len(prefix) <= length:
            return np.zeros(0, np.uint64)
        return (prefix[length:] - prefix[:-length]) * self.back[: len(prefix) - length]


ROLL, ROLL2 = Rolling(0x9E3779B97F4A7C15), Rolling(0xC2B2AE3D27D4EB4F)


#: A value for each byte; in the second row capital A-Z have those of a-z.
_BYTE = np.stack([spread(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))] * 2)
_BYTE[1, 65:91] = _BYTE[1, 97:123]
_SPELL = Rolling(0xD6E8FEB86659FD93)


def hashed_words(column: pa.Array, lower: bool = False) -> list[np.ndarray]:
    """For each text of a binary column the 64-bit hashes of its words `[^\\x20\\x09-\\x0D]+`.

    All words of some texts are hashed at once: prefix sums of a polynomial over their bytes give any word
    by its two ends. `lower`: A-Z count as a-z. Null is no words.
    """
    n, kind = len(column), np.int64 if pa.types.is_large_binary(column.type) else np.int32
    if not n:
        return []
    if column.null_count:
        column = column.fill_null(b"")
    _, at, raw = column.buffers()
    ends = np.frombuffer(at, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    out, i = [], 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + _CHUNK, "right")) - 1)
        border = ends[i : j + 1] - ends[i]
        d = data[ends[i] : ends[j]]
        space = _SPACE[d]
        edge = np.zeros(len(d) + 1, bool)
        edge[border] = True
        before, after = np.concatenate([[True], space[:-1]])[: len(d)] | edge[:-1], np.concatenate([space[1:], [True]])[: len(d)] | edge[1:]
        first, last = np.flatnonzero(~space & before), np.flatnonzero(~space & after)
        power, back = _SPELL.powers(len(d))
        v = _BYTE[int(lower)][d]
        v *= power[: len(d)]
        total = np.cumsum(v)
        h = spread((total[last] - total[first] + v[first]) * back[first]) if len(d) else np.zeros(0, np.uint64)
        cuts = np.searchsorted(first, border)
        out += [h[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        i = j
    return out


def slide(a: np.ndarray, width: int, f) -> np.ndarray:
    """f (np.minimum or np.maximum) over every `width` neighbours, by doubling."""
    done, cur = 1, a
    while done * 2 <= width:
        cur, done = f(cur[:-done], cur[done:]), done * 2
    if done < width:
        n = len(a) - width + 1
        cur = f(cur[:n], cur[width - done : width - done + n])
    return cur


def longs(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64))


def batches(table: pa.Table | dict, schema: pa.Schema):
    """One record batch of columns in the order of the schema."""
    return pa.record_batch([pa.array(table[n], t) if not isinstance(table[n], pa.Array) else table[n].cast(t) for n, t in zip(schema.names, schema.types, strict=True)], schema=schema)
