"""WARC archives with a two-level capture index.

Writing: each task appends one gzip member per record to its archives in shared storage. Of captures with
equal payloads of some length only one is stored; the others are revisit records that refer to it.

Index: the captures' reversed-host keys are sorted by range into index files. A file's lines fill compressed
blocks; a sparse directory beside it keeps each block's first key and place, and a short list keeps each
file's first key. A lookup bisects that list, then the file's directory, and reads and unpacks one block.

Reading: looked-up captures are dealt by archive and place, and neighbouring ranges are read together.

Files appear under their names by a rename after they are complete, and a retried task writes the same
bytes; tables between the steps are written, so no step with files runs again after it is through.
"""

from __future__ import annotations

import bisect
import hashlib
import uuid
import zlib
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import batches, bounded_batches, cut, shared_dir

LEAST_SHARED = 1000  #: bytes from which equal payloads are stored once
BLOCK_LINES = 1024
ARCHIVE_BYTES = 1 << 28  #: an archive is closed from this size on
READ_BYTES = 1 << 22  #: ranges of an archive are read together up to this size
_DATE = "2000-01-01T00:00:00Z"
_ENTRY = pa.schema([("key", pa.string()), ("cid", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
_INDEX = pa.schema([("first", pa.string()), ("cid", pa.int64()), ("file", pa.string()), ("lines", pa.int64())])
_RECORD = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])
_NO_ID = -(2**63)


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def url_key(url: str | None) -> str:
    """Reversed host, then the path and query: com,example,www)/a?b. Without a host, the text itself."""
    try:
        u = urlsplit((url or "").strip())
        host = (u.hostname or "").removeprefix("www.")
        port = f":{u.port}" if u.port and (u.scheme, u.port) not in (("http", 80), ("https", 443)) else ""
    except ValueError:
        u, host, port = None, "", ""
    if not host:
        return quote(url or "", safe="/:?&=,;()!*'$@~._-")
    tail = (u.path or "/") + (f"?{u.query}" if u.query else "")
    return ",".join(reversed(host.split("."))) + port + ")" + quote(tail, safe="/:?&=,;()!*'$@~._-%").lower()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, not compressed: a response with its payload, or a revisit without."""
    name = lambda i: f"<urn:page:{'none' if i is None else i}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {_DATE}", "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"), f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's fields: page_id, url, payload (None for a revisit), payload_bytes, digest, record_type, refers_to."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    length = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    of = lambda name: None if name is None or "none" in name else int(name[10:-1])
    kind = fields["WARC-Type"]
    return {"page_id": of(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload": payload if kind == "response" else None, "payload_bytes": length, "digest": fields["WARC-Payload-Digest"][5:], "record_type": kind, "refers_to": of(fields.get("WARC-Refers-To"))}


class _File:
    """A file that gets its name when it is complete."""

    def __init__(self, uri: str):
        self.fs, self.path = _fs(uri)
        self.temporary, self.size = f"{self.path}.{uuid.uuid4().hex}.tmp", 0
        self.out = self.fs.open_output_stream(self.temporary)

    def write(self, data: bytes) -> tuple[int, int]:
        self.out.write(data)
        self.size += len(data)
        return self.size - len(data), len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.temporary, self.path)


def _gz(data: bytes) -> bytes:
    z = zlib.compressobj(1, wbits=31)
    return z.compress(data) + z.flush()


def _archiver(folder: str):
    def run(it):
        part, number, file = TaskContext.get().partitionId(), 0, None
        for b in it:
            rows = []
            for page, url, payload, digest, refers in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                if file is None:
                    uri = f"{folder}/part-{part:06d}-{number:04d}.warc.gz"
                    file, number = _File(uri), number + 1
                rows.append((url_key(url), _NO_ID if page is None else page, uri, *file.write(_gz(record(page, url, payload, digest, refers)))))
                if file.size >= ARCHIVE_BYTES:
                    file.close()
                    file = None
            if rows:
                yield batches(dict(zip(_ENTRY.names, zip(*rows, strict=True), strict=True)), _ENTRY)
        if file is not None:
            file.close()

    return run


def _indexer(folder: str):
    def run(it):
        uri = f"{folder}/index-{TaskContext.get().partitionId():06d}.cdx.gz"
        lines, directory, file, first, total = [], [], None, None, 0

        def block():
            place = file.write(_gz("".join("\t".join(map(str, x)) + "\n" for x in lines).encode()))
            directory.append((lines[0][0], lines[0][1], *place))
            lines.clear()

        for b in it:
            for row in zip(*(b.column(c).to_pylist() for c in _ENTRY.names), strict=True):
                if file is None:
                    file, first = _File(uri), row[:2]
                lines.append(row)
                total += 1
                if len(lines) == BLOCK_LINES:
                    block()
        if file is not None:
            if lines:
                block()
            file.close()
            side = _File(uri + ".dir")
            side.write(_gz("".join("\t".join(map(str, x)) + "\n" for x in directory).encode()))
            side.close()
            yield batches({"first": [first[0]], "cid": [first[1]], "file": [uri], "lines": [total]}, _INDEX)

    return run


class CaptureIndex:
    """Lookups in the index: `files` holds (first key, first capture id, file) of each index file, ascending.

    One file's directory and one block are kept, so that sorted lookups unpack each block once.
    """

    def __init__(self, files: list[tuple[str, int, str]]):
        self.files = [((k.encode(), c), f) for k, c, f in files]
        self.firsts = [x[0] for x in self.files]
        self.have = self.place = None

    def _read(self, file: str, offset: int | None = None, length: int = 0) -> list[list[str]]:
        fs, path = _fs(file)
        with fs.open_input_file(path) as f:
            raw = f.read() if offset is None else f.read_at(length, offset)
        return [x.split("\t") for x in zlib.decompress(raw, 31).decode().split("\n")[:-1]]

    def find(self, key: str, cid: int) -> list[tuple[str, int, int]]:
        """(archive, offset, length) of the captures with this key and id."""
        want, out = (key.encode(), cid), []
        # equal captures may run on over the border of a file or block: begin at the last that starts before
        at = max(0, bisect.bisect_left(self.firsts, want) - 1)
        while at < len(self.files) and self.firsts[at] <= want:
            file = self.files[at][1]
            if self.have != file:
                rows = self._read(file + ".dir")
                self.have, self.starts, self.places = file, [(r[0].encode(), int(r[1])) for r in rows], [(int(r[2]), int(r[3])) for r in rows]
            n = max(0, bisect.bisect_left(self.starts, want) - 1)
            while n < len(self.starts) and self.starts[n] <= want:
                if self.place != (file, n):
                    rows = self._read(file, *self.places[n])
                    self.place, self.keys, self.rows = (file, n), [(r[0].encode(), int(r[1])) for r in rows], rows
                i = bisect.bisect_left(self.keys, want)
                while i < len(self.keys) and self.keys[i] == want:
                    out.append((self.rows[i][2], int(self.rows[i][3]), int(self.rows[i][4])))
                    i += 1
                n += 1
            at += 1
        return out


def _finder(files):
    def run(it):
        index = CaptureIndex(files)
        schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
        for b in it:
            rows = [x for k, c in zip(b.column("key").to_pylist(), b.column("cid").to_pylist(), strict=True) for x in index.find(k, c)]
            if rows:
                yield batches(dict(zip(schema.names, zip(*rows, strict=True), strict=True)), schema)

    return run


def _reader(it):
    for b in it:
        rows, places = [], list(zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True))
        i = 0
        while i < len(places):
            file, start, _ = places[i]
            j, end = i, start
            while j < len(places) and places[j][0] == file and end <= places[j][1] + places[j][2] <= start + max(READ_BYTES, places[i][2]):
                end = max(end, places[j][1] + places[j][2])
                j += 1
            fs, path = _fs(file)
            with fs.open_input_file(path) as f:
                raw = f.read_at(end - start, start)
            for _, offset, length in places[i:j]:
                r = parse(zlib.decompress(raw[offset - start : offset - start + length], 31))
                if r["payload"] is not None and (len(r["payload"]) != r["payload_bytes"] or hashlib.sha1(r["payload"]).hexdigest() != r["digest"]):
                    raise ValueError(f"payload of {r['page_id']} in {file} differs from its header")
                rows.append((r["page_id"], r["payload_bytes"], r["digest"], r["record_type"], r["refers_to"], r["url"]))
            i = j
        if rows:
            yield batches(dict(zip(_RECORD.names, zip(*rows, strict=True), strict=True)), _RECORD)


def _keyed(it):
    schema = pa.schema([("key", pa.string()), ("cid", pa.int64())])
    for b in it:
        yield batches({"key": [url_key(u) for u in b.column("url").to_pylist()], "cid": b.column("cid")}, schema)


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_SHARED) -> DataFrame:
    """Write a record for each page; the captures' (key, cid, file, offset, length), as a written table.

    Of pages with equal payloads of `least` bytes or more, that with the largest page_id is stored. Rows
    repeated with their id are stored again, each as a response; a null id is smaller than any other.
    """
    spark = pages.sparkSession
    bounded_batches(spark, 500)
    fs, path = _fs(folder)
    fs.create_dir(path, recursive=True)
    ready = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha1("payload"))
    long = F.length("payload") >= least
    # only payloads that occur twice are looked up; the rest keep a key of their own, so none of them meet
    best = ready.filter(long).groupBy("digest").agg(F.max("page_id").alias("best"), F.count("*").alias("n")).filter("n > 1").select(F.col("digest").alias("of"), "best")
    joined = ready.join(best, long & (F.col("digest") == F.col("of")), "left")
    other = F.col("best").isNotNull() & ~F.col("best").eqNullSafe(F.col("page_id"))
    rows = joined.select("page_id", "url", "payload", "digest", F.when(other, F.col("best")).alias("refers_to"))
    return cut(spark, rows.mapInArrow(_archiver(folder), "key string, cid long, file string, offset long, length long"), "captures")


def write_index(captures: DataFrame, folder: str) -> list[tuple[str, int, str]]:
    """Write index files and directories; each file's first key, first capture id and name, ascending.

    The list has one row for each partition of the sort.
    """
    spark = captures.sparkSession
    fs, path = _fs(folder)
    fs.create_dir(path, recursive=True)
    files = captures.repartitionByRange("key", "cid", "file", "offset").sortWithinPartitions("key", "cid", "file", "offset").mapInArrow(_indexer(folder), "first string, cid long, file string, lines long")
    return sorted((r["first"], r["cid"], r["file"]) for r in cut(spark, files, "index").collect())


def read_captures(wanted: DataFrame, files: list[tuple[str, int, str]]) -> DataFrame:
    """Records of the wanted captures (page_id, url), found through the index and read from the archives."""
    spark = wanted.sparkSession
    bounded_batches(spark, 500)
    keys = wanted.select(F.col("url").cast("string").alias("url"), F.coalesce(F.col("page_id").cast("long"), F.lit(_NO_ID)).alias("cid")).mapInArrow(_keyed, "key string, cid long").distinct()
    places = keys.repartitionByRange("key", "cid").sortWithinPartitions("key", "cid").mapInArrow(_finder(files), "file string, offset long, length long")
    # with a number, as tiny index rows say nothing of the bytes that they make a task read
    dealt = places.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file", F.floor(F.col("offset") / READ_BYTES)).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(_reader, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Archive all pages, index them, and read every capture back through the index.

    One row for each row of pages: page_id, payload_bytes, payload_digest, record_type, refers_to, url.
    Null html is an empty payload, a null url is archived as an empty one; other columns are ignored; an
    empty table gives no rows. See write_archives for repeated rows and null ids.
    """
    spark: SparkSession = pages.sparkSession
    folder = folder or shared_dir(spark, "warc")
    captures = write_archives(pages, folder)
    return read_captures(pages.select("page_id", "url"), write_index(captures, folder))
