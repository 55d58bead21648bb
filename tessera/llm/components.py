"""Connected components of links, without collecting any: local union-find, then star contraction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import batches, cut, discard

_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _contract(it):
    """Each batch's links, replaced by links from every node to the smallest of its component."""
    for batch in it:
        root: dict[int, int] = {}

        def find(x, root=root):
            while (p := root.setdefault(x, x)) != x:
                root[x] = x = root[p] if p in root else p
            return x

        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
        edges = [(find(x), x) for x in list(root) if find(x) != x]
        if edges:
            a, b = np.array(edges, np.int64).T
            yield batches({"a": pa.array(a), "b": pa.array(b)}, _EDGE)


def components(links: DataFrame) -> DataFrame:
    """links(a, b) of longs -> (node, label): the smallest node reachable, for every node of a link but the smallest.

    Rows with a null and links from a node to itself count for nothing; order and repeats don't matter.
    Each turn moves every neighbour of a node to the smallest in reach, so a chain of n nodes takes about
    log n turns; a turn ends in a written table.
    """
    spark = links.sparkSession
    edges = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct().mapInArrow(_contract, "a long, b long").distinct()
    edges = cut(spark, edges, "links")
    while True:
        # each node's smallest neighbour, itself included; then all its neighbours, and itself, point there
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        new = both.join(low, "a").select(F.col("m").alias("a"), "b").union(low.select(F.col("m").alias("a"), F.col("a").alias("b"))).filter("a < b").distinct()
        new = cut(spark, new.mapInArrow(_contract, "a long, b long").distinct(), "links")
        # finished when no node is on both sides: every edge then leads to its component's smallest node, once
        ends = new.select(F.col("a").alias("x"), F.lit(True).alias("low")).union(new.select("b", F.lit(False)))
        if ends.groupBy("x").agg(F.max("low").alias("low"), F.count_if(~F.col("low")).alias("n")).filter("n > 1 or n > 0 and low").limit(1).count() == 0:
            discard(edges)
            return new.select(F.col("b").alias("node"), F.col("a").alias("label"))
        discard(edges)
        edges = new
