"""Exact nearest neighbours by squared distance, for one query or a batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Components of query vectors that are sent to all tasks at once, and of rows that a task holds at once.
COMPONENTS = 2**20
#: Rows of the table in a task, at least.
ROWS = 16384
#: Queries and rows whose distances are worked out at once.
_QUERIES, _TABLE = 256, 2048
#: What a distance is: a number, NaN, unknown (no component in both vectors), or not there yet; in the order of ranks.
_NUMBER, _NAN, _NULL, _NONE = range(4)


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, d: s + d)


def nearest(table: DataFrame, query: list[float], k: int, vector: str = "vector", keys: tuple[str, ...] = ("file_path", "start_line", "end_line")) -> DataFrame:
    """The k rows nearest to one vector, ties by keys: a scan with local top-k, no shuffle of the table."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return table.withColumn("distance", squared_l2(F.col(vector), q)).orderBy("distance", *keys).limit(k)


class _Vectors:
    """Vectors of one length. Plain ones have all components, and none that is not finite or huge."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, there: np.ndarray):
        self.ids, self.x, self.there = ids, x, there
        self.plain = (there & (np.abs(x) < 1e100)).all(axis=1) & (x.shape[1] > 0)

    def take(self, rows) -> _Vectors:
        return _Vectors(self.ids[rows], self.x[rows], self.there[rows])


def _by_length(ids: np.ndarray, lists: pa.Array) -> list[_Vectors]:
    """Null vectors count as empty ones."""
    sizes, flat = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64), lists.flatten()
    there, x = pc.is_valid(flat).to_numpy(zero_copy_only=False), pc.fill_null(flat, 0).to_numpy().astype(np.float64)
    starts, out = np.cumsum(sizes) - sizes, []
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        at = starts[rows][:, None] + np.arange(n)
        out.append(_Vectors(ids[rows], x[at], there[at]))
    return out


def _few_copies(v: _Vectors, k: int) -> np.ndarray:
    """Of rows with the same vector those with the k + 1 smallest ids: a query needs no more, its own left out."""
    whole = np.ascontiguousarray(v.x).view(np.dtype((np.void, v.x.itemsize * v.x.shape[1]))).ravel()
    group = np.unique(whole, return_inverse=True)[1]
    order = np.lexsort((v.ids, group))
    first = np.diff(group[order], prepend=-1) != 0
    n = np.cumsum(first | np.r_[True, v.ids[order][1:] != v.ids[order][:-1]])
    return np.sort(order[n - np.maximum.accumulate(np.where(first, n, 0)) <= k])


def _augmented(x: np.ndarray, query: bool) -> np.ndarray:
    """Rows whose inner products, of a query's and a table's, are squared distances, less room for rounding.

    That room goes with the square of both lengths' sum, so that a long vector takes none from other pairs.
    """
    square, one = (x * x).sum(axis=1), np.ones(len(x))
    # far above the rounding of the products and of the sums
    room = 1e-15 * (x.shape[1] + 102)
    less, length = square * (1 - room), np.sqrt(square)
    return np.column_stack([-2 * x, one, less, -2 * room * length] if query else [x, less, one, length])


def _summed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of pairs, summed component by component as SQL does."""
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        t = x[:, d] - y[:, d]
        out += t * t
    return out


class _Search:
    """The k nearest rows that a task has met so far, for each of some queries of one length."""

    def __init__(self, queries: _Vectors, k: int):
        self.k = k
        # plain ones and others apart
        order = np.argsort(~queries.plain, kind="stable")
        self.q, self.n_plain = queries.take(order), int(queries.plain.sum())
        self.kind, self.d, self.ids = np.full((len(order), k), _NONE, np.int8), np.zeros((len(order), k)), np.zeros((len(order), k), np.int64)
        self.augmented = _augmented(self.q.x[: self.n_plain], True)

    def meet(self, rows: _Vectors) -> None:
        same, n, p = rows.x.shape[1] == self.q.x.shape[1], len(self.q.ids), self.n_plain
        plain = rows.take(np.flatnonzero(rows.plain)) if same and p else None
        if plain is not None and len(plain.ids):
            plain = plain.take(_few_copies(plain, self.k))
            for c in range(0, len(plain.ids), _TABLE):
                piece = plain.take(slice(c, c + _TABLE))
                table = _augmented(piece.x, False)
                for a in range(0, p, _QUERIES):
                    self._by_products(a, min(a + _QUERIES, p), piece, table)
        # what the products don't serve: every row for odd queries, odd rows for plain ones
        odd = rows.take(np.flatnonzero(~rows.plain)) if same else rows
        for first, last, part in ((0, p, odd), (p, n, rows)):
            for c in range(0, len(part.ids), _QUERIES):
                for a in range(first, last, _QUERIES):
                    self._by_components(a, min(a + _QUERIES, last), part.take(slice(c, c + _QUERIES)))

    def _by_products(self, a: int, b: int, piece: _Vectors, table: np.ndarray) -> None:
        least = self.augmented[a:b] @ table.T
        bound = np.where(self.kind[a:b, -1] == _NUMBER, self.d[a:b, -1], np.inf)
        new = np.flatnonzero(np.isinf(bound))
        if len(new) and len(piece.ids) >= self.k:
            others = np.where(self.q.ids[a:b][new][:, None] == piece.ids[None, :], np.inf, least[new])
            first = np.argpartition(others, self.k - 1, axis=1)[:, : self.k]
            d = _summed(piece.x[first.ravel()], np.repeat(self.q.x[a:b][new], self.k, axis=0)).reshape(first.shape)
            bound[new] = np.where(np.isinf(np.take_along_axis(others, first, axis=1)), np.inf, d).max(axis=1)
        q, c = np.nonzero(least <= (bound + 1e-300)[:, None])
        q = q + a
        other = self.q.ids[q] != piece.ids[c]
        q, c = q[other], c[other]
        for i in range(0, len(q), 65536):
            qi, ci = q[i : i + 65536], c[i : i + 65536]
            self._add(qi, np.zeros(len(qi), np.int8), _summed(piece.x[ci], self.q.x[qi]), piece.ids[ci])

    def _by_components(self, a: int, b: int, piece: _Vectors) -> None:
        d, known = np.zeros((b - a, len(piece.ids))), np.zeros((b - a, len(piece.ids)), bool)
        with np.errstate(all="ignore"):
            for i in range(min(piece.x.shape[1], self.q.x.shape[1])):
                both = self.q.there[a:b, i][:, None] & piece.there[:, i][None, :]
                t = piece.x[:, i][None, :] - self.q.x[a:b, i][:, None]
                d += np.where(both, t * t, 0.0)
                known |= both
        kind = np.where(known, np.where(np.isnan(d), _NAN, _NUMBER), _NULL).astype(np.int8)
        d[kind != _NUMBER] = 0
        k0, d0, i0 = (x[a:b, -1][:, None] for x in (self.kind, self.d, self.ids))
        ids = piece.ids[None, :]
        better = (kind < k0) | ((kind == k0) & ((d < d0) | ((d == d0) & (ids <= i0))))
        q, c = np.nonzero(better & (self.q.ids[a:b][:, None] != ids))
        self._add(q + a, kind[q, c], d[q, c], piece.ids[c])

    def _add(self, q: np.ndarray, kind: np.ndarray, d: np.ndarray, ids: np.ndarray) -> None:
        rows = np.unique(q)
        q, kind, d, ids = np.r_[np.repeat(rows, self.k), q], np.r_[self.kind[rows].ravel(), kind], np.r_[self.d[rows].ravel(), d], np.r_[self.ids[rows].ravel(), ids]
        order = np.lexsort((ids, d, kind, q))
        rank = np.arange(len(q)) - np.searchsorted(q[order], q[order])
        order, rank = order[rank < self.k], rank[rank < self.k]
        for held, new in ((self.kind, kind), (self.d, d), (self.ids, ids)):
            held[q[order], rank] = new[order]

    def found(self, names: list[str]) -> pa.RecordBatch:
        q, r = np.nonzero(self.kind != _NONE)
        d = np.where(self.kind[q, r] == _NAN, np.nan, self.d[q, r])
        distance = pa.array(d, pa.float64(), mask=self.kind[q, r] == _NULL)
        return pa.RecordBatch.from_arrays([pa.array(self.q.ids[q], pa.int64()), pa.array(self.ids[q, r], pa.int64()), distance], names)


def _searcher(queries: pa.Table, k: int, names: list[str]):
    def run(batches):
        held = queries.combine_chunks()
        searches = [_Search(v, k) for v in _by_length(held.column(0).to_numpy(), held.column(1).chunk(0))] if len(held) else []
        for batch in batches:
            step = max(1, COMPONENTS * len(batch) // max(1, len(batch.column(1).flatten())))
            for a in range(0, len(batch), step):
                part = batch.slice(a, step)
                for rows in _by_length(part.column(0).to_numpy(), part.column(1)):
                    for s in searches:
                        s.meet(rows)
        for s in searches:
            yield s.found(names)

    return run


def nearest_batch(table: DataFrame, queries: DataFrame, k: int, key: str, vector: str) -> DataFrame:
    """(query_id, rank, key, distance): each query's k nearest, itself left out. queries: (query_id, q); keys are integers.

    Every query is held against every row. Queries go to all tasks in blocks of COMPONENTS; a task goes through
    its rows once and keeps k for each query. Matrix products tell, with room for their rounding, which rows may
    be among the k; those are summed component by component. Components that either vector lacks are left out;
    unknown distances rank last, ties by key.
    """
    queries = queries.filter(F.col("query_id").isNotNull())
    size = queries.agg(F.coalesce(F.sum(F.greatest(F.size("q"), F.lit(1)).cast("long")), F.lit(0))).collect()[0][0]
    blocks = max(1, -(-size // COMPONENTS))
    tasks = max(1, min(-(-table.count() // ROWS), 4 * table.sparkSession.sparkContext.defaultParallelism))
    rows = table.filter(F.col(key).isNotNull()).select(F.col(key).cast("long"), vector).repartition(tasks)
    names, out = ["query_id", key, "distance"], None
    for b in range(blocks):
        part = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        found = rows.mapInArrow(_searcher(part.select(F.col("query_id").cast("long"), "q").toArrow(), k, names), f"query_id long, `{key}` long, distance double")
        out = found if out is None else out.unionByName(found)
    ranked = out.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.asc_nulls_last("distance"), key))).filter(F.col("rank") <= k)
    return ranked.select(F.col("query_id").cast(queries.schema["query_id"].dataType), "rank", F.col(key).cast(table.schema[key].dataType), "distance")


def scope_rescue(ranked: DataFrame, limit: int, in_scope: Column) -> DataFrame:
    """Of rows ranked by column r: those in scope among the first `limit`, or else among min(3 * limit, 120)."""
    wide = max(limit, min(3 * limit, 120))
    every = ranked.filter(F.col("r") <= wide).withColumn("__s", in_scope).withColumn("__n", F.count_if((F.col("r") <= limit) & F.col("__s")).over(W.partitionBy()))
    return every.filter(F.col("__s") & ((F.col("r") <= limit) | (F.col("__n") == 0))).drop("__s", "__n")
