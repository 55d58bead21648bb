"""Exact self-join of documents on the Jaccard similarity of word n-grams, by a grouped prefix join.

Two sets as similar as asked share one of their first n - ceil(t n) + 1 elements in any order that is the
same for all; here rare ones come first, by a count of all n-grams in a table of fixed size, then by hash.

  1. documents with the same set become one class, and classes with the same size and prefix one group;
  2. the groups' prefix elements are dealt by element, in packed arrays and one exchange. Where two groups meet on an
     element, the pair is filtered by size, by the element's place in either prefix, and by the element before it: if that
     is the same in both, the pair meets there as well, so only the first element in common counts;
  3. group pairs that are left are expanded to their classes, filtered by the parity of their elements' hashes in at
     least BITS bits and two for each element, whose distance never exceeds that of the sets, and verified on the whole texts.

An element that more than RUN groups hold is not expanded into all pairs, nor is a pair of groups with many classes.
Each holder is compared with a few others, the hubs, chosen by size and hash, and verified links join components. In
later rounds the postings of those holders are dealt again, with the components; only holders in different components
and with different elements before are paired, all of them where they are FEW, and with new hubs else. A last step pairs
what is left in blocks of bounded size. No link between two components can thus be lost, and the rows of a round grow
with the holders, not with their square. Elements that may be held by very many groups are salted by group before they are
dealt, so that none of them fills a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import ROLL, batches, bounded_batches, cut, discard, hashed_words, longs, sole, spread, text_bytes
from .components import components

CELLS = 1 << 20  #: counters of n-grams; 1 byte each in a task's row, and on the way to the executors
MAP = 1 << 23  #: bits of a map of elements
SLICES = 32
BITS = 1024  #: of a class's parity map, at least; a power of two, as are those of larger sets
RUN = 10  #: groups on one element, or classes of a group, whose pairs are all made at once
FEW = 64  #: holders in other components, or with other elements before, that are paired with all others
ROUNDS = 1  #: in which holders of common elements are dealt anew
HOT = 14  #: bit length of an element's count from which it is salted; more, where the cells are fuller
BANDS = 25  #: hubs are told apart by that many bands of a size's logarithm
STAR = 32  #: texts that are compared with one copy of a hub's text
BLOCK = 1024  #: holders in a block of the last step
POSTINGS = 1 << 21  #: in one task, about
SMALL = 1 << 21  #: row keys that may be broadcast: 16 MB; more are joined by a shuffle
_FLUSH = 1 << 20  #: postings a task gathers before it deals them
_SEEN = 200_000  #: groups a task remembers so as not to emit their elements twice

_SIG = pa.schema([("doc_id", pa.int64()), ("r", pa.int64()), ("n", pa.int64()), ("k", pa.int64()), ("g", pa.int64()), ("bits", pa.binary()), ("pre", pa.binary())])
_SLICE = pa.schema([("slice", pa.int32()), ("counts", pa.binary())])
_DEALT = pa.schema([("bucket", pa.int32()), ("posts", pa.binary())])
_MET = pa.schema([("kind", pa.int32()), ("x", pa.int64()), ("y", pa.int64()), ("tok", pa.int64()), ("prev", pa.int64()), ("n", pa.int64()), ("i", pa.int64())])
_MET_SQL = "kind int, x long, y long, tok long, prev long, n long, i long"
_PAIR, _HUB, _HELD, _OPEN = 0, 1, 2, 3  #: kinds of rows: a pair, a holder and its hub, a holder of an element with many, and that element


def _of_words(x: np.ndarray, width: int) -> np.ndarray:
    if len(x) >= width:
        h = spread(ROLL.windows(ROLL.prefix(x), width))
        h.sort()
        return h[np.concatenate([[True], h[1:] != h[:-1]])]
    return spread(spread(ROLL.windows(ROLL.prefix(x), len(x))) ^ np.uint64(len(x))) if len(x) else x


def shingles(column: pa.Array, width: int) -> list[np.ndarray]:
    """For each text the distinct hashes of its n-grams; with fewer words, of the whole sequence; none without words."""
    return [_of_words(x, width) for x in hashed_words(column, lower=True)]


def _count(width: int):
    def run(it):
        sole()
        total = np.zeros(CELLS, np.uint8)
        for b in it:
            h = shingles(b.column("t"), width)
            c = np.bincount((np.concatenate(h) & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS) if h else np.zeros(CELLS, int)
            total = np.minimum(total + c, 255).astype(np.uint8)
        yield batches({"slice": list(range(SLICES)), "counts": [s.tobytes() for s in total.reshape(SLICES, -1)]}, _SLICE)

    return run


def _sum(it):
    """Sums of the batches of each slice; kept as 64-bit counts."""
    total: dict[int, np.ndarray] = {}
    for b in it:
        for s, c in zip(b.column("slice").to_pylist(), b.column("counts").to_pylist(), strict=True):
            a = np.frombuffer(c, np.uint8).astype(np.int64)
            total[s] = total[s] + a if s in total else a
    if total:
        yield batches({"slice": list(total), "counts": [a.tobytes() for a in total.values()]}, _SLICE)


def rarity(docs: DataFrame, width: int) -> tuple[bytes, int]:
    """For each of CELLS cells the bit length of its count over all documents, one byte each; and the sum of the counts.

    A task's own counts stop at 255, which blurs the order of elements, and what is salted, and nothing else. What
    reaches the driver is SLICES rows for each partition of the sums, CELLS * 8 bytes in all for one partition.
    """
    rows = docs.mapInArrow(_count(width), "slice int, counts binary").repartition(SLICES, "slice").mapInArrow(_sum, "slice int, counts binary").collect()
    total = np.zeros((SLICES, CELLS // SLICES), np.int64)
    for r in rows:
        total[r["slice"]] += np.frombuffer(r["counts"], np.int64)
    out = np.zeros(CELLS, np.uint8)
    left = total.reshape(-1).copy()
    while left.any():
        out += left > 0
        left >>= 1
    return np.minimum(out, 31).tobytes(), int(total.sum())


def _ordered(h: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """Elements as longs whose order is: rarer cells first, then by hash. The upper six bits are the cell's."""
    cell = rare[(h & np.uint64(CELLS - 1)).astype(np.int64)].astype(np.uint64)
    out = (cell << np.uint64(58)) | (h >> np.uint64(6))
    out.sort()
    return out


def _parity(h: np.ndarray) -> bytes:
    """Whether the number of elements is odd, for each remainder of their hashes; about n / 4 to n / 2 bytes for n of them."""
    bits = max(BITS, 1 << (2 * len(h) - 1).bit_length()) if len(h) else BITS
    odd = np.bincount((h >> np.uint64(20) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _folded(maps: list[bytes], width: int) -> np.ndarray:
    """Maps of one length as rows of `width` words: a map for half as many remainders is the sum of its halves."""
    out = np.frombuffer(b"".join(maps), np.uint64).reshape(len(maps), -1)
    while out.shape[1] > width:
        half = out.shape[1] // 2
        out = out[:, :half] ^ out[:, half:]
    return out


def _key(h: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(h.tobytes())


def _signer(width: int, percent: int, rare):
    def run(it):
        table, seen = np.frombuffer(rare.value, np.uint8), set()
        for b in it:
            n, k, g, bits, pres = [], [], [], [], []
            for h in shingles(b.column("t"), width):
                n.append(len(h))
                k.append(_key(h))
                bits.append(_parity(h))
                pre = _ordered(h, table)[: len(h) - (percent * len(h) + 99) // 100 + 1] if len(h) else h
                raw = pre.tobytes()
                group = xxhash.xxh64_intdigest(raw + len(h).to_bytes(8, "little"))
                g.append(group)
                pres.append(None if group in seen or not len(h) else raw)
                if len(seen) < _SEEN:
                    seen.add(group)
            yield batches({"doc_id": b.column("doc_id"), "r": b.column("r"), "n": n, "k": longs(np.array(k, np.uint64)), "g": longs(np.array(g, np.uint64)), "bits": bits, "pre": pres}, _SIG)

    return run


_TYPES = (np.uint64, np.uint64, np.uint64, np.uint32, np.uint32, np.uint64)  #: element, that before it, holder, size, place; label, if any


def _columns(labelled: bool):
    types = _TYPES if labelled else _TYPES[:-1]
    return types, sum(np.dtype(t).itemsize for t in types)


def _mapper(it):
    """Elements x -> a map of MAP bits in which each has one, in slices."""
    out = np.zeros(MAP, bool)
    for b in it:
        out[(spread(b.column("x").to_numpy().view(np.uint64)) % np.uint64(MAP)).astype(np.int64)] = True
    yield batches({"slice": list(range(SLICES)), "counts": [np.packbits(p).tobytes() for p in out.reshape(SLICES, -1)]}, _SLICE)


def _either(it):
    total: dict[int, np.ndarray] = {}
    for b in it:
        for s, c in zip(b.column("slice").to_pylist(), b.column("counts").to_pylist(), strict=True):
            a = np.frombuffer(c, np.uint8)
            total[s] = total[s] | a if s in total else a
    if total:
        yield batches({"slice": list(total), "counts": [a.tobytes() for a in total.values()]}, _SLICE)


def _open(elements: DataFrame) -> bytes:
    """The map of the elements x, of MAP bits however many they are; a fuller one only rules out less."""
    rows = elements.mapInArrow(_mapper, "slice int, counts binary").repartition(SLICES, "slice").mapInArrow(_either, "slice int, counts binary").collect()
    out = np.zeros((SLICES, MAP // 8 // SLICES), np.uint8)
    for r in rows:
        out[r["slice"]] |= np.frombuffer(r["counts"], np.uint8)
    return out.tobytes()


def _dealer(buckets: int, hot: int, seed: int, wanted=None):
    """Prefixes (x: holder, label, n, pre) -> their postings as packed columns, by bucket; without labels in round 0.

    `wanted`: a map of elements; others are left out, unless they are salted.
    """

    def dealt(rows):
        pres, holders, labels, sizes = zip(*rows, strict=True)
        tok, length = np.frombuffer(b"".join(pres), np.uint64), np.array([len(p) // 8 for p in pres])
        x, label, n = (np.repeat(np.array(v, t), length) for v, t in ((holders, np.int64), (labels, np.int64), (sizes, np.uint32)))
        x, label = x.view(np.uint64), label.view(np.uint64)
        first = np.concatenate([[0], np.cumsum(length)[:-1]])
        i = (np.arange(len(tok)) - np.repeat(first, length)).astype(np.uint32)
        prev = np.concatenate([tok[:1], tok[:-1]])
        prev[first] = spread(x[first])  # nothing stands before the first, which is never the same
        if wanted is not None:
            bits = np.unpackbits(np.frombuffer(wanted.value, np.uint8)).astype(bool)
            keep = bits[(spread(tok) % np.uint64(MAP)).astype(np.int64)] | ((tok >> np.uint64(58)).astype(np.int64) > hot)
            tok, prev, x, label, n, i = (v[keep] for v in (tok, prev, x, label, n, i))
        # an element that up to 2**bits groups hold goes to one bucket for each 2**hot of them
        salts = np.left_shift(1, np.maximum((tok >> np.uint64(58)).astype(np.int64) - hot, 0)).astype(np.uint64)
        bucket = (spread(tok + spread(spread(x) + np.uint64(seed)) % salts) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        cols = [v[order] for v in ((tok, prev, x, n, i, label) if seed else (tok, prev, x, n, i))]
        edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
        used = np.flatnonzero(edge[1:] > edge[:-1])
        return batches({"bucket": used.astype(np.int32), "posts": [b"".join(v[edge[u] : edge[u + 1]].tobytes() for v in cols) for u in used]}, _DEALT)

    def run(it):
        rows, held = [], 0
        for b in it:
            for p, x, label, n in zip(*(b.column(c).to_pylist() for c in ("pre", "x", "label", "n")), strict=True):
                rows.append((p, x, 0 if label is None else label, n))
                held += len(p) // 8
                if held >= _FLUSH:
                    yield dealt(rows)
                    rows, held = [], 0
        if rows:
            yield dealt(rows)

    return run


def _unpacked(blobs: list[bytes], labelled: bool) -> list[np.ndarray]:
    types, width = _columns(labelled)
    cols = [[] for _ in types]
    for blob in blobs:
        m, at = len(blob) // width, 0
        for c, t in zip(cols, types, strict=True):
            c.append(np.frombuffer(blob, t, m, at))
            at += m * np.dtype(t).itemsize
    return [np.concatenate(c) for c in cols]


def _distinct(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of the first of equal pairs (x, y), in order of x, then y."""
    if not len(x):
        return np.zeros(0, np.int64)
    order = np.lexsort((y, x))
    u, v = x[order], y[order]
    return order[np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])])]


def _partnered(run: np.ndarray, n: np.ndarray, i: np.ndarray, percent: int) -> np.ndarray:
    """Which rows may have a partner of their run by size and place: the smallest that is large enough allows most."""
    order = np.lexsort((n, run))
    key, size, place = (run[order].astype(np.int64) << 32) + n[order], n[order], i[order]
    base = key - size
    lo = np.searchsorted(key, base - (-percent * size // 100), "left")
    hi = np.searchsorted(key, base + 100 * size // percent, "right")
    at = np.where(lo == np.arange(len(key)), lo + 1, lo)  # another than itself
    least = -(-percent * (size + size[np.minimum(at, len(key) - 1)]) // (100 + percent))
    out = np.zeros(len(n), bool)
    out[order] = (at < hi) & (place <= size - least)
    return out


def _others(values: np.ndarray) -> np.ndarray:
    """Places of the values that aren't the most frequent one."""
    u, back, n = np.unique(values, return_inverse=True, return_counts=True)
    return np.flatnonzero(back != np.argmax(n))


def _meeter(percent: int, hot: int, most: int, round_: int, rounds: int):
    """Packed postings -> pairs of holders, holders with hubs, and holders that later rounds look at.

    All pairs are made on an element of up to `most` holders, or with few that differ from the others; the rest is left to
    later rounds.
    """

    def run(it):
        blobs = [p for b in it for p in b.column("posts").to_pylist()]
        if not blobs:
            return
        tok, prev, x, n, i, *labels = _unpacked(blobs, round_ > 0)
        label = labels[0] if labels else x  # at first each is alone
        blobs.clear()
        salted = (tok >> np.uint64(58)).astype(np.int64) > hot
        order = np.argsort(tok, kind="stable")
        t = tok[order]
        alone = np.concatenate([[True], t[1:] != t[:-1]]) & np.concatenate([t[1:] != t[:-1], [True]])
        keep = order[~alone | salted[order]]
        tok, prev, x, label, n, i = (v[keep] for v in (tok, prev, x, label, n, i))
        order = _distinct(tok, x)  # by element, then holder; copies that several tasks emitted go
        tok, prev, x, label, n, i = (v[order] for v in (tok, prev, x, label, n, i))
        if not len(tok):
            return
        n, i = n.astype(np.int64), i.astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
        length = np.diff(np.append(start, len(tok)))
        salted = (tok[start] >> np.uint64(58)).astype(np.int64) > hot
        same = np.minimum.reduceat(prev, start) == np.maximum.reduceat(prev, start)
        same |= np.minimum.reduceat(label, start) == np.maximum.reduceat(label, start)
        many = salted | (length > most) & ~same
        few = ~salted & (length > 1) & (length <= most) & ~same

        def possible(a, b):
            """Whether these may be the two of a link of two components whose first common element this is."""
            least = -(-percent * (n[a] + n[b]) // (100 + percent))  # elements in common; what stands before the first can be but few
            return (prev[a] != prev[b]) & (label[a] != label[b]) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])) & (i[a] <= n[a] - least) & (i[b] <= n[b] - least)

        def rows(kind, **cols):
            size = len(cols["x"])
            for at in range(0, size, 100_000):
                part = slice(at, min(size, at + 100_000))
                zero = np.zeros(part.stop - at, np.int64)
                yield batches({"kind": (zero + kind).astype(np.int32), **{c: longs(cols[c][part] if c in cols else zero) for c in _MET.names[1:]}}, _MET)

        def pairs(kind, found):
            if found:
                a, b = (np.concatenate(v) for v in zip(*found, strict=True))
                a, b = x[a], x[b]
                first = _distinct(a, b)
                yield from rows(kind, x=a[first], y=b[first])

        at = np.flatnonzero(np.repeat(few, length))
        found = []
        for d in range(1, most):
            a, b = at[:-d], at[d:]
            near = tok[a] == tok[b]
            if not near.any():
                break
            a, b = a[near], b[near]
            ok = possible(a, b)
            found.append((a[ok], b[ok]))
        yield from pairs(_PAIR, found)

        at = np.flatnonzero(np.repeat(many & ~salted, length))
        useful = np.ones(len(tok), bool)
        useful[at] = _partnered(np.repeat(np.arange(len(start)), length)[at], n[at], i[at], percent)
        found, left, needed = [], [], []
        for s, size, is_salted in zip(start[many].tolist(), length[many].tolist(), salted[many].tolist(), strict=True):
            run_ = s + np.flatnonzero(useful[s : s + size])
            size = len(run_)
            if size < 2 and not is_salted:
                continue
            if not is_salted and round_:
                strangers, turned = _others(label[run_]), _others(prev[run_])
                small = min(strangers, turned, key=len)
                if len(small) <= (FEW if round_ == rounds else 2):
                    # whichever pairs are possible, one of the two is in the smaller set, and is the hub
                    inside = np.zeros(size, bool)
                    inside[small] = True
                    a, b = np.tile(np.arange(size), len(small)), np.repeat(small, size)
                    ok = ~inside[a] | (a < b)
                    a, b = run_[a[ok]], run_[b[ok]]
                    ok = possible(a, b)
                    found.append((a[ok], b[ok]))
                    continue
                # those like most in both are needed only if another is like them in neither
                other = np.zeros(size, bool)
                other[strangers] = True
                mine = np.zeros(size, bool)
                mine[turned] = True
                needed.append(run_ if (other & mine).any() else run_[other | mine])
            else:
                needed.append(run_)
            left.append(run_)
        yield from pairs(_PAIR, found)
        if not left:
            return
        at, needed = np.concatenate(left), np.concatenate(needed)
        found = []
        # those with the fewest elements of their own before a common one are nearest to what all have in common
        rank = i[at] if round_ % 2 == 0 else spread(x[at])
        for part in (np.floor(np.log(n[at]) * BANDS).astype(np.int64), np.zeros(len(at), np.int64)):
            order = np.lexsort((spread(x[at] + np.uint64(round_)), rank, part, tok[at]))
            u, v = tok[at][order], part[order]
            edge = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])]))
            hub = np.repeat(at[order[edge]], np.diff(np.append(edge, len(at))))
            mine = at[order]
            ok = possible(mine, hub)
            found.append((mine[ok], hub[ok]))
        yield from pairs(_HUB, found)
        if round_ < rounds:
            yield from rows(_HELD, x=np.unique(x[needed]))
            yield from rows(_OPEN, x=np.unique(tok[at]))
        else:
            yield from rows(_HELD, x=x[needed], tok=tok[needed], prev=prev[needed], n=n[needed], i=i[needed])

    return run


def _near(percent: int):
    """Keep pairs that the parity maps cannot rule out."""

    def run(it):
        for b in it:
            if not b.num_rows:
                continue
            n = b.column("na").to_numpy() + b.column("nb").to_numpy()
            least = -(-percent * n // (100 + percent))  # elements in common
            x, y = (b.column(c).to_pylist() for c in ("bits_a", "bits_b"))
            sizes = np.array([(len(p), len(q)) for p, q in zip(x, y, strict=True)])
            ok = np.zeros(len(n), bool)
            for size in np.unique(sizes, axis=0):
                at = np.flatnonzero((sizes == size).all(axis=1))
                p, q = (_folded([maps[i] for i in at], int(size.min()) // 8) for maps in (x, y))
                ok[at] = np.bitwise_count(p ^ q).sum(axis=1, dtype=np.int64) <= (n - 2 * least)[at]
            yield b.select(["a", "b", "ra", "rb"]).filter(pa.array(ok))

    return run


def _verifier(width: int, percent: int):
    """Rows (u, s, v, t), sorted: a hub's text, where v is null, then the texts of its partners v. The links of those."""

    def run(it):
        hub, have, last = None, None, None
        for batch in it:
            a, b = [], []
            for u, s, v, x in zip(batch.column("u").to_pylist(), batch.column("s").to_pylist(), batch.column("v").to_pylist(), shingles(batch.column("t"), width), strict=True):
                if _key(x) != (u if v is None else v) % 2**64 or (u, s, v) == last:  # another text whose row has the same key, or a repeated row
                    continue
                last = (u, s, v)
                if v is None:
                    hub, have = (u, s), x
                elif hub == (u, s):
                    same = len(np.intersect1d(x, have, assume_unique=True))
                    if 100 * same >= percent * (len(x) + len(have) - same):
                        a.append(min(u, v))
                        b.append(max(u, v))
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The links among the written pairs (a, b, ra, rb) of classes, by the whole texts of their rows; b is the hub.

    A hub's text is sent once for STAR partners, so that no hub's pairs meet in one task. Only texts that are asked for
    are shuffled, once, if what is asked for is small enough to be sent to all.
    """
    spark = pairs.sparkSession
    degree = pairs.groupBy("b").agg(F.ceil(F.count("*") / STAR).alias("d"), F.first("rb").alias("rb"))
    partners = pairs.select("a", "ra", "b").join(degree.select("b", "d"), "b").select(F.col("ra").alias("r"), F.col("b").alias("u"), F.pmod(F.xxhash64("a"), "d").alias("s"), F.col("a").alias("v"))
    hubs = degree.select(F.col("rb").alias("r"), F.col("b").alias("u"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("d") - 1)).alias("s"), F.lit(None).cast("long").alias("v"))
    need = partners.union(hubs)
    if 2 * pairs.count() <= SMALL:
        rows = texts.join(F.broadcast(need), "r")
    else:
        rows = need.join(texts.groupBy("r").agg(F.first("t").alias("t")), "r")
    rows = rows.select("u", "s", "v", "t").repartition("u", "s").sortWithinPartitions("u", "s", F.col("v").asc_nulls_first())
    return cut(spark, rows.mapInArrow(_verifier(width, percent), "a long, b long"), "found")


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 75, rounds: int = ROUNDS, run: int = RUN, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id (smallest id reachable by links).

    Two documents link when 100 * common >= percent * union. Null and empty texts have no n-grams and link
    with nothing: their component is themselves. Repeated rows are copies of one another. Rows of one id
    with different texts are told apart. A null id stays null; its text links others all the same, and its component is
    the smallest id reachable, or null. Other columns are ignored; an empty table gives no rows.
    `run`: up to how many holders of an element are all compared at once; `rounds`: how often holders of others are dealt
    anew before the last step; `hot`: the bit length of counts from which elements are salted, at least.
    """
    sigs, parts = _parts(docs, width, percent, rounds, run, hot, id_col, text_col)
    rows = sigs.join(parts.withColumnRenamed("k", "key"), (sigs["k"] == F.col("key")) & (sigs["n"] > 0), "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def _parts(docs: DataFrame, width: int, percent: int, rounds: int = ROUNDS, run: int = RUN, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, r, n, k: class, g) of all documents; and (k, label, component) of all classes, component being the
    smallest id of the label's classes."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("t")).withColumn("r", F.xxhash64("doc_id", "t"))
    cells, total = rarity(texts.select("t"), width)
    rare = spark.sparkContext.broadcast(cells)
    wide = cut(spark, texts.mapInArrow(_signer(width, percent, rare), "doc_id long, r long, n long, k long, g long, bits binary, pre binary"), "wide")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total * (100 - percent) // 100 // POSTINGS)
    hot = max(hot, (total // CELLS).bit_length() + 3)
    prefixes = wide.filter("pre is not null").select("g", "n", "pre")

    def met(rows: DataFrame, n: int, wanted=None) -> DataFrame:
        dealt = rows.select("x", "label", "n", "pre").mapInArrow(_dealer(4 * tasks, hot, n, wanted), "bucket int, posts binary").repartition(tasks, "bucket")
        return cut(spark, dealt.mapInArrow(_meeter(percent, hot, run, n, rounds), _MET_SQL), "met")

    first = met(prefixes.withColumn("x", F.col("g")).withColumn("label", F.lit(None).cast("long")), 0)
    sigs = cut(spark, wide.select("doc_id", "r", "n", "k", "g"), "sigs")
    classes = wide.filter("n > 0").groupBy("k", "n", "g").agg(F.min("doc_id").alias("c"), F.min("r").alias("r"), F.first("bits").alias("bits"))
    classes = cut(spark, classes, "classes")

    def hubs(found: DataFrame) -> DataFrame:
        """Pairs (x, y) of a round: all that are made at once, and of each holder a few with hubs."""
        few = F.slice(F.array_sort(F.collect_set(F.struct(F.xxhash64("y").alias("z"), "y"))), 1, 2)  # later steps look at the others
        some = found.filter(F.col("kind") == _HUB).groupBy("x").agg(few.alias("y")).select("x", F.explode("y.y").alias("y"))
        return found.filter(F.col("kind") == _PAIR).select("x", "y").union(some).distinct()

    def side(e: str, by: str, of: DataFrame = classes) -> DataFrame:
        return of.select(F.col(by).alias(f"by_{e}"), F.col("k").alias(e), F.col("n").alias(f"n{e}"), F.col("bits").alias(f"bits_{e}"), F.col("r").alias(f"r{e}"))

    tried: list[DataFrame] = []

    def compared(pairs: DataFrame) -> DataFrame | None:
        """pairs(a, b, na, nb, bits_a, bits_b, ra, rb) -> links(a, b); None where there is none.

        Pairs of the first step, which are most, aren't compared again."""
        near = pairs.filter(f"a != b and 100 * least(na, nb) >= {percent} * greatest(na, nb)").mapInArrow(_near(percent), "a long, b long, ra long, rb long")
        if tried:
            near = near.join(tried[0].select(F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q")), F.expr("least(a, b) = p and greatest(a, b) = q"), "left_anti")
        near = cut(spark, near, "pairs")
        found = None if near.limit(1).count() == 0 else _verified(near, texts, width, percent)
        if tried:
            discard(near)
        else:
            tried.append(near)
        return None if found is None or found.limit(1).count() == 0 else found

    # classes of a crowd, a group with several: all pairs of up to `run`; else each class with the crowd's hub, its least key
    crowds = cut(spark, classes.groupBy("g").agg(F.count("*").alias("m"), F.min("k").alias("hub")).filter("m > 1"), "crowds")
    big = crowds.filter(F.col("m") > run)
    shown = classes.join(big, "g", "left").filter("hub is null or k = hub").select(*classes.columns)
    groups = cut(spark, hubs(first).union(crowds.filter(F.col("m") <= run).select("g", F.col("g").alias("h"))), "groups")
    expanded = groups.join(side("a", "g", shown), F.col("x") == F.col("by_a")).join(side("b", "g", shown), F.col("y") == F.col("by_b"))
    expanded = expanded.filter("x != y or a < b").select("a", "b", "na", "nb", "bits_a", "bits_b", "ra", "rb")
    of_hubs = side("a", "g").join(big, F.col("by_a") == F.col("g")).join(side("b", "k"), F.col("hub") == F.col("by_b")).select(*expanded.columns)
    links = compared(expanded.union(of_hubs))
    links = links if links is not None else spark.createDataFrame([], "a long, b long")
    # in the last step, classes of big crowds are holders of an element for each group that theirs is paired with
    pairs = groups.join(big.select(F.col("g").alias("x"), F.lit(1).alias("bx")), "x", "left").join(big.select(F.col("g").alias("y"), F.lit(1).alias("by")), "y", "left").filter("bx = 1 or by = 1").select("x", "y")
    pairs = pairs.union(big.select("g", F.col("g").alias("h"))).select(F.xxhash64("x", "y").alias("tok"), F.explode(F.array_distinct(F.array("x", "y"))).alias("g"))
    crowded = pairs.join(classes, "g").select("tok", F.col("k").alias("x"), F.col("k").alias("prev"), "n", F.lit(0).cast("long").alias("i"))
    crowded = cut(spark, crowded, "crowded")
    discard(groups)

    labels, held = components(links), first.filter(F.col("kind") == _HELD).select("x").distinct()
    wanted = spark.sparkContext.broadcast(_open(first.filter(F.col("kind") == _OPEN).select("x")))
    for n in range(1, rounds + 1):
        held = cut(spark, held, "held")
        size = held.count()
        if not size:
            break
        # holders are groups in the first round's rows, and classes from now on
        of = classes.join(held, classes["g" if n == 1 else "k"] == held["x"], "left_semi").select("g", F.col("k").alias("x"))
        of = of.join(labels, F.col("x") == F.col("node"), "left").select("g", "x", "label")
        # a prefix that several tasks wrote is dealt as often, and counts once where it meets others
        found = met(prefixes.join(F.broadcast(of) if size <= SMALL else of, "g").withColumn("label", F.coalesce("label", "x")), n, wanted)
        discard(held)
        pairs = hubs(found).join(side("a", "k"), F.col("x") == F.col("by_a")).join(side("b", "k"), F.col("y") == F.col("by_b"))
        more = compared(pairs)
        if more is not None:
            links = links.union(more)
            labels = components(links)
        held = found.filter(F.col("kind") == _HELD)
        if n < rounds:
            held = held.select("x").distinct()
            wanted = spark.sparkContext.broadcast(_open(found.filter(F.col("kind") == _OPEN).select("x")))
        else:
            crowded = crowded.union(held.select("tok", "x", "prev", "n", "i"))
    discard(first)

    # an element's holders fall into blocks, and each pair of blocks is a key of its own
    rows = crowded.join(labels, F.col("x") == F.col("node"), "left").select("tok", "x", "prev", "n", "i", F.coalesce("label", "x").alias("label"))
    split = rows.groupBy("tok").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).filter("lo != hi").select("tok", "blocks")
    rows = cut(spark, rows.join(split, "tok"), "last")
    if rows.limit(1).count():
        rows = rows.withColumn("p", F.pmod(F.xxhash64("x"), "blocks").cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.select("tok", F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi"), "x", "prev", "n", "i", "label", "p")
        x, y = (rows.select("tok", "lo", "hi", *(F.col(c).alias(f"{c}_{e}") for c in ("x", "prev", "n", "i", "label", "p"))) for e in "ab")
        least = F.ceil(percent * (F.col("n_a") + F.col("n_b")) / (100 + percent))
        fits = (F.col("prev_a") != F.col("prev_b")) & (F.col("label_a") != F.col("label_b")) & (F.col("i_a") <= F.col("n_a") - least) & (F.col("i_b") <= F.col("n_b") - least)
        once = (F.col("p_a") < F.col("p_b")) | ((F.col("lo") == F.col("hi")) & (F.col("x_a") < F.col("x_b")))
        pairs = x.join(y, ["tok", "lo", "hi"]).filter(once & fits & F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"))
        pairs = pairs.select(F.least("x_a", "x_b").alias("x"), F.greatest("x_a", "x_b").alias("y")).distinct()
        more = compared(pairs.join(side("a", "k"), F.col("x") == F.col("by_a")).join(side("b", "k"), F.col("y") == F.col("by_b")))
        if more is not None:
            labels = components(links.union(more))
    discard(wide, *tried)

    labelled = classes.select("k", "c").join(labels, F.col("k") == F.col("node"), "left").select("k", "c", F.coalesce("label", "k").alias("label"))
    least_ids = labelled.groupBy("label").agg(F.min("c").alias("component"))
    return sigs, labelled.select("k", "label").join(least_ids, "label")


def keep_first(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """The rows of docs, unchanged, less the near copies: of each component one row stays, that with the smallest id.

    Of the component's rows with that id, the one whose text sorts first stays; rows with an id come before those
    without. Rows without words are no copies of anything and stay, repeated ones too.
    """
    spark = docs.sparkSession
    sigs, parts = _parts(docs, width, percent)
    of = sigs.filter("n > 0").join(parts.select("k", "label"), "k").select("r", "doc_id", "label")
    first = of.groupBy("label").agg(F.min_by("r", F.struct(F.col("doc_id").isNull(), "doc_id", "r")).alias("first"))
    rows = of.groupBy("r", "label").agg(F.count("*").alias("rows")).join(first, "label")
    # rows of a text that goes, or that is there several times with its id; of the latter one may stay
    odd = cut(spark, rows.filter("r != first or rows > 1").select("r", (F.col("r") == F.col("first")).alias("stays")), "odd")
    keyed = docs.withColumn("__r", F.xxhash64(F.col("doc_id").cast("long"), text_bytes()))
    gone, one = odd.select(F.col("r").alias("__r")), odd.filter("stays").select(F.col("r").alias("__r"))
    if odd.count() <= SMALL:
        gone, one = F.broadcast(gone), F.broadcast(one)
    kept = keyed.join(gone, "__r", "left_anti").unionByName(keyed.join(one, "__r", "left_semi").dropDuplicates(["__r"]))
    return kept.select(*docs.columns)
