"""Replace-by-file upserts as an append-only generation log, its current view, and changed-file detection."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def append(rows: DataFrame, path: str, generation: int) -> None:
    """Write the replacement rows of a generation; a file's rows of it supersede all before. Empty input writes nothing.

    Each generation is a folder of its own, so writing it again replaces it and adds nothing twice.
    """
    ready = rows if "is_tombstone" in rows.columns else rows.withColumn("is_tombstone", F.lit(False))
    if ready.limit(1).count():
        ready.drop("gen").write.mode("overwrite").parquet(f"{path.rstrip('/')}/gen={generation}")


def open_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The log with these columns, is_tombstone and gen; empty where nothing has been written yet."""
    whole = T.StructType([*(T.StructField(f.name, f.dataType) for f in schema), T.StructField("is_tombstone", T.BooleanType()), T.StructField("gen", T.LongType())])
    try:
        return spark.read.schema(whole).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], whole)


def file_signatures(chunks: DataFrame) -> DataFrame:
    """(file_path, signature): a hash of each file's spans and their contents' hashes, in whatever order they come."""
    spans = F.array_sort(F.collect_set(F.struct("start_line", "end_line", "content_hash")))
    return chunks.groupBy("file_path").agg(F.sha2(F.to_json(spans), 256).alias("signature"))


def tombstones(paths: DataFrame) -> DataFrame:
    """Rows that delete files: (file_path, is_tombstone)."""
    return paths.select("file_path", F.lit(True).alias("is_tombstone")).distinct()


def current(log: DataFrame, upto: int | None = None) -> DataFrame:
    """Each file's rows of its latest generation, unless that is a deletion. The join is on one aggregated row per file."""
    seen = log if upto is None else log.filter(F.col("gen") <= upto)
    last = seen.groupBy("file_path").agg(F.max("gen").alias("gen"))
    return seen.join(last, ["file_path", "gen"]).filter(~F.col("is_tombstone")).drop("is_tombstone")


def changed(new: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of new(file_path, content_hash, ...) that known doesn't hold with the same hash."""
    return new.join(known.select("file_path", "content_hash").distinct(), ["file_path", "content_hash"], "left_anti")


def first_spans(chunks: DataFrame) -> DataFrame:
    """One row per (file_path, start_line, end_line, content_hash)."""
    return chunks.dropDuplicates(["file_path", "start_line", "end_line", "content_hash"])
