"""Approximate nearest neighbours by collision-counting hashing.

Every vector is projected on ``PROJECTIONS`` random lines, and each line has one
sorted array of projections.  A query opens a window around its own projection
on every line; the window's half width is ``WIDTH / 2`` times a radius, and
raising the radius widens all windows over the same arrays (virtual rehashing),
so only the newly covered entries are counted.  A vector that lies in the windows
of at least ``SHARE`` of the lines is verified: its cosine with the query is
computed in double precision on the original vectors.

The search of a block ends at the radius within which as many verified vectors as
wanted lie (a vector at the radius lies in a window with probability 0.82,
independently for each line, and so is verified with probability 0.99), or as soon
as ``wanted + SPARE + BUDGET x rows of the block`` vectors were verified.  Where no
neighbour is near, vectors pass the threshold in the order of their distances, give
or take the spread of the counts, and the budget is what ends the search; the
radius is then raised by ``FINE`` at a time from where windows cover ``START`` of
the entries, at which few vectors pass.  At an unbounded window all vectors collide,
so no query ends short.

Directions are compared, so vectors are scaled to length 1 for the projections.
Vectors are hashed into blocks of about ``BLOCK_ROWS``, each with its own sorted
arrays, and queries into blocks of ``QUERY_ROWS``.  Every query has to meet every
block: what is sent for that is a block of vectors for ``QUERY_ROWS`` queries and
the queries for a block of vectors, and the arrays of a block are sorted once for
so many queries.  The best of all blocks are merged by a group limit.  A task holds
one block of each, whatever the input.

Defined edge cases: vectors that are null, zero, or hold null or non-finite
components, and rows without an id, take no part; rows with the same id and vector
count once, and different vectors of one id are rows of their own, each with its own
ranks; vectors of different lengths are not compared; ties go to the smaller id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PROJECTIONS = 240
WIDTH = 2.7
SHARE = 0.7
FIRST_RADIUS = 0.3
GROWTH = 3.0
#: Cover of the entries from which the radius grows finely, and by how much.
START, FINE = 0.61, 1.02
#: Verified vectors that end a search, beside those wanted: a number, and a share of the block.
SPARE, BUDGET = 64, 0.125
BLOCK_ROWS = 32768
QUERY_ROWS = 65536
QUERIES_AT_ONCE = 128
#: Entries of a line that are compared at once, so that they stay in the processor's cache.
ENTRIES_AT_ONCE = 1 << 18
SEED = 5


class Block:
    """Sorted projections of one block of vectors; id and key, a hash of the vector, tell rows apart."""

    def __init__(self, ids: np.ndarray, keys: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((keys, ids))
        self.ids, self.keys, self.vectors = ids[order], keys[order], vectors[order].astype(np.float64)
        self.norms = _norms(self.vectors)
        self.lines = np.random.default_rng(SEED).standard_normal((vectors.shape[1], PROJECTIONS))
        n = len(ids)
        kind = np.uint16 if n < 1 << 16 else np.uint32
        unit = _unit(self.vectors)
        self.order, self.place = np.empty((PROJECTIONS, n), kind), np.empty((PROJECTIONS, n), kind)
        self.sorted = np.empty((PROJECTIONS, n))
        for j in range(PROJECTIONS):
            p = unit @ self.lines[:, j]
            self.order[j] = np.argsort(p, kind="stable")
            self.sorted[j] = p[self.order[j]]
            self.place[j, self.order[j]] = np.arange(n, dtype=kind)
        #: No two projections are further apart.
        self._span = 2 * float(np.sqrt((self.lines**2).sum(axis=0)).max())

    def search(self, qids: np.ndarray, qkeys: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        """Return (query id, query key, id, key, cosine, verified) of up to k nearest found for each query.

        ``verified`` is how many vectors were verified for the query.
        """
        found = [self._some(qids[i : i + QUERIES_AT_ONCE], qkeys[i : i + QUERIES_AT_ONCE], queries[i : i + QUERIES_AT_ONCE].astype(np.float64), k) for i in range(0, len(qids), QUERIES_AT_ONCE)]
        return tuple(np.concatenate([f[c] for f in found]) for c in range(6))

    def _windows(self, at: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Return first and end entry, lines x queries, of the windows at each query's radius."""
        half = WIDTH * radius / 2
        low, high = np.empty(at.shape, np.int64), np.empty(at.shape, np.int64)
        for j, (entries, a) in enumerate(zip(self.sorted, at)):
            low[j] = np.searchsorted(entries, a - half)
            high[j] = np.searchsorted(entries, a + half, side="right")
        return low, high

    def _covering(self, at: np.ndarray) -> np.ndarray:
        """Return the radius at which each query's windows cover START of the entries."""
        low, high = np.zeros(at.shape[1]), np.full(at.shape[1], 2 * self._span / WIDTH)
        for _ in range(12):
            mid = (low + high) / 2
            a, b = self._windows(at, mid)
            wide = (b - a).sum(axis=0) >= START * self.sorted.size
            low, high = np.where(wide, low, mid), np.where(wide, mid, high)
        return high

    def _count_all(self, counts: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Count, queries x vectors, the lines on which a vector's place is in the window."""
        n, kind = len(self.ids), self.place.dtype.type
        size = (high - low).astype(np.int64)
        tile = max(1, ENTRIES_AT_ONCE // n)
        for q in range(0, len(counts), tile):
            own = counts[q : q + tile]
            own[:] = 0
            for j in range(PROJECTIONS):
                w = size[j, q : q + tile]
                # A place below the window wraps around and is large.
                inside = self.place[j][None, :] - low[j, q : q + tile].astype(kind)[:, None] < np.minimum(w, np.iinfo(kind).max).astype(kind)[:, None]
                own += inside.view(np.uint8)

    def _some(self, qids: np.ndarray, qkeys: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        n, least = len(self.ids), math.ceil(SHARE * PROJECTIONS)
        budget = k + SPARE + BUDGET * n
        at, norms = (_unit(queries) @ self.lines).T, _norms(queries)
        fine = self._covering(at)
        counts = np.zeros((len(qids), n), np.uint8)
        checked = (self.ids[None, :] == qids[:, None]) & (self.keys[None, :] == qkeys[:, None])  # the query's own row is no candidate
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0))] * len(qids)
        verified = np.zeros(len(qids), np.int64)
        going = np.arange(len(qids))
        radius = np.minimum(FIRST_RADIUS, fine)
        low = high = None
        while len(going):
            last = WIDTH * radius[going] / 2 >= self._span
            new_low, new_high = self._windows(at[:, going], radius[going])
            if low is None or (new_high - new_low).sum() > 1.25 * (high - low).sum():
                part = counts[going]
                self._count_all(part, new_low, new_high)
                counts[going] = part
            else:
                for i, q in enumerate(going.tolist()):
                    spans = [*zip(new_low[:, i].tolist(), low[:, i].tolist()), *zip(high[:, i].tolist(), new_high[:, i].tolist())]
                    fresh = np.concatenate([self.order[j % PROJECTIONS, a:b] for j, (a, b) in enumerate(spans)])
                    counts[q] += np.bincount(fresh, minlength=n).astype(np.uint8)
            stay = np.ones(len(going), bool)
            for i, q in enumerate(going.tolist()):
                rows, score = best[q]
                new = np.flatnonzero((counts[q] >= least) & ~checked[q])
                if len(new):
                    checked[q, new] = True
                    verified[q] += len(new)
                    own = (self.vectors[new] * queries[q]).sum(axis=1) / (self.norms[new] * norms[q])
                    rows, score = np.concatenate([rows, new]), np.concatenate([score, own])
                    top = np.lexsort((rows, -score))[:k]  # rows are in the order of ids
                    best[q] = rows, score = rows[top], score[top]
                # Unit vectors with cosine s are sqrt(2 - 2 s) apart.
                stay[i] = not (last[i] or checked[q].all() or len(rows) >= k and (verified[q] >= budget or 2 - 2 * score[-1] <= radius[q] ** 2))
            going, low, high = going[stay], new_low[:, stay], new_high[:, stay]
            r = radius[going]
            radius[going] = np.where(r < fine[going], np.minimum(r * GROWTH, fine[going]), r * FINE)
        size = [len(b[0]) for b in best]
        rows = np.concatenate([b[0] for b in best])
        return np.repeat(qids, size), np.repeat(qkeys, size), self.ids[rows], self.keys[rows], np.concatenate([b[1] for b in best]), np.repeat(verified, size)


def _norms(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, keepdims=True)  # against overflow and underflow of squares
    return (top[:, 0]) * np.sqrt(((x / top) ** 2).sum(axis=1))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / _norms(x)[:, None]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def neighbours(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Return (query_id, rank, vec_id, score): the k nearest found to each row whose id ``every`` divides."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False)))
    rows = rows.distinct().withColumn("dim", F.size("v")).withColumn("key", F.xxhash64("v"))
    asked = F.col("vec_id") % every == 0
    size = rows.agg(F.count("*").alias("n"), F.count_if(asked).alias("q")).first()
    blocks, query_blocks = max(1, math.ceil(size["n"] / BLOCK_ROWS)), max(1, math.ceil(size["q"] / QUERY_ROWS))
    block = lambda salt, n: F.pmod(F.xxhash64("vec_id", "key", F.lit(salt)), F.lit(n))
    every_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    data = rows.select("dim", block(1, blocks).alias("b"), every_of(query_blocks).alias("qb"), "vec_id", "key", "v")
    queries = rows.where(asked).select("dim", every_of(blocks).alias("b"), block(2, query_blocks).alias("qb"), "vec_id", "key", "v")

    names = ["query_id", "query_key", "vec_id", "key", "score"]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({name: pa.array([], pa.float64() if name == "score" else pa.int64()) for name in names})
        own = [[t.column("vec_id").to_numpy(), t.column("key").to_numpy(), _matrix(t.column("v"))] for t in (left, right)]
        return pa.table(dict(zip(names, Block(*own[0]).search(*own[1], k)[:5])))

    keys = ["dim", "b", "qb"]
    found = data.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(meet, "query_id long, query_key long, vec_id long, key long, score double")
    order = Window.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), "vec_id", "key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
