"""Exact top-k inner products by a score-at-a-time index in impact order.

Integer vectors are shifted to non-negative impacts, once for positive and once for negative query
components. A block of candidates is an index whose postings (dimension, vector, impact) are grouped into
segments by quantised impact. For a query, segments are processed by descending impact; what is unprocessed
of a vector is worth at most the unprocessed query weights times the next segment's greatest impact. When
that bound proves that no further vector can reach the k-th best lower bound, processing stops, and the
vectors that may still be members are scored exactly.

Queries and candidates are dealt into blocks of bounded size, and each pair of blocks is one row of work:
the stated query set is held against all rows. A pair of blocks yields at most k rows for each query, and
partial maxima are merged on the query's id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import batches

BLOCK = 4096  #: vectors in a block, about; ids are dealt by hash
_SEGMENTS = (0.75, 0.62, 0.5, 0.42, 0.34, 0.26, 0.18, 0.1, 0.0)  #: lower ends, as shares of the greatest impact
_OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


class ImpactIndex:
    """Segments of a block of integer vectors, for queries of either sign."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors.astype(np.int64)
        low, high = vectors.min(axis=0), vectors.max(axis=0)
        # term d: impact of a positive component; term d + dims: of a negative one
        self.offset = np.concatenate([low, -high]).astype(np.int64)
        impact = np.hstack([vectors - low, high - vectors]).astype(np.float32)
        top = float(impact.max()) if impact.size else 0.0
        self.segments, above = [], np.inf
        for share in _SEGMENTS:
            end = np.ceil(share * top)
            if end < above:
                inside = (impact >= end) & (impact < above)
                # postings of the segment, what they add, and the greatest impact that is left after it
                self.segments.append((np.where(inside, impact, 0), inside.astype(np.float32), max(0.0, end - 1) if share else 0.0))
                above = end

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        """(query_id, vec_id, score) of each query's k best in this block, its own id left out."""
        q = queries.astype(np.int64)
        weight = np.hstack([np.maximum(q, 0), np.maximum(-q, 0)])
        w32 = weight.astype(np.float32)
        known = np.zeros((len(q), len(self.ids)), np.float32)
        unseen = np.repeat(w32.sum(axis=1, keepdims=True), len(self.ids), axis=1)
        own = query_ids[:, None] == self.ids[None, :]
        k_at = min(k, len(self.ids))
        pending = np.arange(len(q))
        members: list[tuple[int, np.ndarray]] = []
        for n, (value, flag, left) in enumerate(self.segments):
            # sums of integers under 2**24 are exact in float32; larger ones are only bounds, hence the slack
            known[pending] += w32[pending] @ value.T
            unseen[pending] -= w32[pending] @ flag.T
            lower = np.where(own[pending], -np.inf, known[pending])
            upper = lower + unseen[pending] * left
            slack = 1e-5 * np.abs(known[pending]).max(initial=0) + 1
            least = -np.partition(-lower, k_at - 1, axis=1)[:, k_at - 1] - slack
            may = upper + slack >= least[:, None]
            last = n == len(self.segments) - 1
            proven = may.sum(axis=1) <= 4 * k_at
            for r in np.flatnonzero(proven | last):
                members.append((pending[r], np.flatnonzero(may[r])))
            pending = pending[~(proven | last)]
            if not len(pending):
                break
        for r, at in members:
            at = at[self.ids[at] != query_ids[r]]
            score = self.vectors[at] @ q[r]
            order = np.lexsort((self.ids[at], -score))[:k]
            for o in order:
                yield int(query_ids[r]), int(self.ids[at[o]]), int(score[o])


def _pack(key, table):
    ids = table.column("id").to_numpy().astype(np.int64)
    flat = table.column("v").combine_chunks()
    v = np.asarray(flat.values if isinstance(flat, pa.Array) else flat.chunk(0).values, np.int64)
    return pa.table({"b": pa.array([key[0].as_py()], pa.int64()), "ids": pa.array([ids.tobytes()], pa.binary()), "v": pa.array([v.tobytes()], pa.binary())})


def _searcher(k: int):
    def run(it):
        have, index = None, None
        for b in it:
            for c, ids, v, qids, qv in zip(*(b.column(n).to_pylist() for n in ("b", "ids", "v", "qids", "qv")), strict=True):
                if c != have:
                    have, n = c, len(ids) // 8
                    index = ImpactIndex(np.frombuffer(ids, np.int64), np.frombuffer(v, np.int64).reshape(n, -1))
                q = np.frombuffer(qids, np.int64)
                rows = list(index.search(q, np.frombuffer(qv, np.int64).reshape(len(q), -1), k))
                if rows:
                    yield batches(dict(zip(_OUT.names, zip(*rows, strict=True), strict=True)), _OUT)

    return run


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, v): floor(scale * x) of each component. Null ids, null or empty vectors, and vectors that hold
    null or non-finite components are left out."""
    x = F.col(vector_col)
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double")) == float("inf")))
    return vectors.filter(F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~bad).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long")).alias("v"))


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose id is divisible by `every`, its k best others.

    Fewer than k others: all of them. Ties go to the smaller id. Repeated rows count once; rows that share an id
    but not their vector all take part. Vectors are
    compared with those of their own length. Other columns are ignored; an empty table gives no rows.
    """
    ints = integer_vectors(vectors, id_col, vector_col).distinct().withColumn("dims", F.size("v"))
    n = vectors.count()
    blocks, query_blocks = max(1, -(-n // BLOCK)), max(1, -(-n // (BLOCK // 8 * every)))
    spread = lambda m, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(m))
    # blocks hold vectors of one length
    deal = lambda df, m, seed: df.groupBy((F.col("dims").cast("long") * 1_000_000_000 + spread(m, seed)).alias("b")).applyInArrow(_pack, "b long, ids binary, v binary")
    candidates = deal(ints, blocks, 1)
    queries = deal(ints.filter(F.col("id") % every == 0), query_blocks, 2).select(F.col("b").alias("qb"), F.col("ids").alias("qids"), F.col("v").alias("qv"))
    dims = (F.col("b") / 1_000_000_000).cast("long") * 1_000_000_000
    work = candidates.withColumn("qb", F.explode(F.sequence(dims, dims + (query_blocks - 1)))).join(queries, "qb")
    found = work.mapInArrow(_searcher(k), "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
