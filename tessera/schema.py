"""The chunk table's schema, and conforming older or partial tables to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = T.StructType([
    T.StructField("file_path", T.StringType(), False),
    T.StructField("content", T.StringType(), False),
    T.StructField("start_line", T.IntegerType(), False),
    T.StructField("end_line", T.IntegerType(), False),
    T.StructField("language", T.StringType(), False),
    T.StructField("symbol_name", T.StringType()),
    T.StructField("symbol_kind", T.StringType()),
    T.StructField("signature_fragment", T.StringType()),
    T.StructField("visibility", T.StringType()),
    T.StructField("arity", T.IntegerType()),
    T.StructField("doc_comment_proximity", T.IntegerType()),
    T.StructField("content_hash", T.StringType(), False),
    T.StructField("vector", T.ArrayType(T.FloatType())),
])


def content_hash(content):
    return F.substring(F.sha2(F.col(content) if isinstance(content, str) else content, 256), 1, 16)


def conform(df: DataFrame) -> DataFrame:
    """Add what an older table lacks: language 'unknown', the hash of the content, null metadata."""
    have = set(df.columns)
    cols = []
    for f in CHUNK:
        c = F.col(f.name) if f.name in have else F.lit(None)
        if f.name == "language":
            c = F.coalesce(c, F.lit("unknown"))
        elif f.name == "content_hash":
            c = F.coalesce(c, content_hash("content"))
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)
