"""File changes as streams: snapshots of an inventory, debouncing, and incremental index maintenance."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..operators import store
from ..schema import CHUNK

GAP_MS = 250


def debounce(events: DataFrame, key: str = "path", ts: str = "ts", gap_ms: int = GAP_MS) -> DataFrame:
    """events with `forwarded`: true for the first of a path and after a pause of at least the gap.

    Every event starts the pause anew, forwarded or not.
    """
    before = F.lag(ts).over(W.partitionBy(key).orderBy(ts))
    pause = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(before.cast("timestamp"))
    return events.withColumn("forwarded", before.isNull() | (pause >= gap_ms * 1000))


def debounced_stream(events: DataFrame, key: str = "path", ts: str = "ts", gap_ms: int = GAP_MS, late: str = "5 seconds") -> DataFrame:
    """One row for each burst of a path: (path, first, last, events). A pause of exactly the gap parts two bursts."""
    bursts = events.withWatermark(ts, late).groupBy(F.session_window(ts, f"{gap_ms * 1000 - 1} microseconds"), key)
    return bursts.agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("events")).drop("session_window")


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, root: str):
        self.root = root

    def _snapshot(self) -> dict[str, str]:
        return {str(p): f"{p.stat().st_mtime_ns}:{p.stat().st_size}" for p in sorted(Path(self.root).rglob("*")) if p.is_file()}

    def initialOffset(self):
        return {}

    def _rows(self, start: dict, end: dict):
        """Differences of two snapshots, as an iterator that Spark can copy."""
        differ = [p for p in sorted(set(start) | set(end)) if start.get(p) != end.get(p)]
        return iter([(p, "deleted" if p not in end else "modified" if p in start else "created") for p in differ])

    def read(self, start: dict):
        end = self._snapshot()
        return self._rows(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict):
        return self._rows(start, end)

    def commit(self, end):
        pass


class FileChanges(DataSource):
    """Stream of (path, kind) below option `root`: what was created, modified or deleted since the last batch."""

    @classmethod
    def name(cls):
        return "file_changes"

    def schema(self):
        return "path string, kind string"

    def simpleStreamReader(self, schema):
        return _Reader(self.options["root"])


def changes(spark: SparkSession, root: str) -> DataFrame:
    spark.dataSource.register(FileChanges)
    return spark.readStream.format("file_changes").option("root", root).load()


def maintain(stream: DataFrame, log: str, checkpoint: str, chunks_of: Callable[[DataFrame], DataFrame], ignored=None, embed_of: Callable[[DataFrame], DataFrame] | None = None):
    """Keep a generation log up to date: each micro-batch writes its changed files' chunks, and deletions, as one generation.

    chunks_of: paths(file_path) -> chunk rows, of the files' present content; embed_of adds their vectors. Files
    whose chunks are those of the current view are skipped before they are embedded. A path that was deleted, or
    that yields no chunk any more, becomes a deletion. A batch that runs again replaces its own generation.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        paths = batch.select(F.col("path").alias("file_path"), "kind").distinct()
        if ignored is not None:
            paths = paths.filter(~ignored(F.col("file_path")))
        rows = chunks_of(paths.filter("kind != 'deleted'").select("file_path").distinct()).persist()
        earlier = store.open_log(batch.sparkSession, log, CHUNK).filter(F.col("gen") < number)
        known = store.file_signatures(store.current(earlier).join(paths.select("file_path"), "file_path", "left_semi"))
        fresh = store.file_signatures(rows).join(known, ["file_path", "signature"], "left_anti").select("file_path")
        gone = store.tombstones(paths.join(rows.select("file_path"), "file_path", "left_anti"))
        kept = rows.join(fresh, "file_path", "left_semi")
        ready = kept if embed_of is None else embed_of(kept)
        store.append(ready.withColumn("is_tombstone", F.lit(False)).unionByName(gone, allowMissingColumns=True), log, number)
        rows.unpersist()

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
