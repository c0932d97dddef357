"""Approximate nearest neighbours by collision counting (largest inner product).

Every block of vectors gets one sorted array per random projection (no
compound keys, no fixed buckets).  A query puts a window around its own
projection in each array; a row that lies in enough of the windows is verified
by its exact inner product in double precision.

The windows are ``WINDOW`` times a radius wide to either side.  A projected difference is
normal with the distance as its deviation, so a row within the radius lies in each window
with at least one known chance, whatever the radius is, and the number of windows asked for leaves out
``MISSED`` deviations below the mean of such a row.  Virtual rehashing starts from a
small radius and widens it until the ``k`` best rows verified lie within it: no row further
away can matter.  What is verified so depends on how many rows are as near as the
neighbours, and not on the size of the block.

Rows in windows are counted for all rows and many queries at once: beside each sorted array lie
bitmaps of its first places, a window is the difference of two of them (its ends rounded outward
to the next of ``STEPS`` places), and a tree of full adders adds the bitmaps up, 64 rows a word.

Inner products become distances by one more coordinate: with M the largest norm
of the block, x gets sqrt(M*M - |x|*|x|), the query is scaled to norm M and
gets 0; then |x - q|**2 = 2*M*M - 2*<x, q>.

The vectors are read where they lie, in blocks of ``BLOCK`` rows of a task; the
queries come to them as broadcasts of at most ``QUERY_BYTES`` each, group after
group.  A task keeps the best ``k`` of the blocks it has seen; the last of them bounds the
radius in the next block, and where it lies above anything that the block's norms
allow, the block is passed over.  Each task gives its best ``k``, a ranking per query merges them.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part, neither as query nor as candidate; a query meets only
candidates of its own dimension and none of its own id; rows that repeat an
id are candidates each, as queries they are one; a query without candidates has no rows;
equal scores go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mojiframe.llm.common import materialise

BLOCK = 16_384
QUERY_BYTES = 32 << 20
PROJECTIONS = 128
WINDOW = 1.5          # half width of a window, in units of the radius
MISSED = 1.0          # deviations below the mean count of a row at the radius
FIRST_RADIUS = 0.7    # in units of M
WIDER = 1.1
STEPS = 64            # bitmaps beside each sorted array
QUERY_BATCH = 128

_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _added(bitmaps: Iterable[np.ndarray]) -> list[np.ndarray]:
    """How many of the bitmaps hold each row, as binary digits (lowest first), each a bitmap."""
    waiting: list[list[np.ndarray]] = [[]]
    for carry in bitmaps:
        for digit in range(len(waiting) + 1):
            if digit == len(waiting):
                waiting.append([])
            waiting[digit].append(carry)
            if len(waiting[digit]) < 3:
                break
            x, y, z = waiting[digit]
            either = x ^ y
            waiting[digit], carry = [either ^ z], x & y | either & z
    digits: list[np.ndarray] = []
    while len(digits) < len(waiting):
        here = waiting[len(digits)]
        while len(here) > 1:  # what waits, and one carry from below
            x, y = here.pop(), here.pop()
            here.append(x ^ y)
            if len(digits) + 1 == len(waiting):
                waiting.append([])
            waiting[len(digits) + 1].append(x & y)
        digits.append(here[0] if here else np.zeros_like(digits[-1]))
    return digits


def _at_least(digits: list[np.ndarray], need: int) -> np.ndarray:
    """The rows whose number is ``need`` or more."""
    if need >> len(digits):
        return np.zeros_like(digits[0])
    more, equal = np.zeros_like(digits[0]), np.full_like(digits[0], _ALL)
    for k in range(len(digits) - 1, -1, -1):
        if need >> k & 1:
            equal &= digits[k]
        else:
            more |= equal & digits[k]
            equal &= ~digits[k]
    return more | equal


class Best:
    """The best ``k`` rows of each query so far: score downward, then the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, k), -np.inf)
        self.id = np.zeros((queries, k), np.int64)
        self.found = np.zeros(queries, np.int64)

    def offer(self, q: int, ids: np.ndarray, score: np.ndarray) -> None:
        known = self.found[q]
        ids, score = np.append(self.id[q, :known], ids), np.append(self.score[q, :known], score)
        if len(ids) > 4 * self.k:
            near = score >= np.partition(score, -self.k)[-self.k]
            ids, score = ids[near], score[near]
        by = np.lexsort((ids, -score))[:self.k]
        self.found[q] = len(by)
        self.id[q, :len(by)], self.score[q, :len(by)] = ids[by], score[by]

    def last(self, q) -> np.ndarray:
        """The score that a further row must reach; minus infinity while there are fewer than ``k``."""
        return self.score[q, -1]


class CollisionIndex:
    """Sorted projections of one block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projections: int = PROJECTIONS, seed: int = 17):
        self.ids, self.vectors = ids, vectors
        n, d = vectors.shape
        square = np.einsum("ij,ij->i", vectors, vectors)
        self.top = float(np.sqrt(square.max()))
        a = np.random.default_rng([seed, d]).standard_normal((d + 1, projections))
        h = vectors @ a[:d] + np.sqrt(np.maximum(self.top ** 2 - square, 0))[:, None] * a[d]
        self.a = a[:d]
        order = np.argsort(h, axis=0, kind="stable")
        self.sorted = np.ascontiguousarray(np.take_along_axis(h, order, 0).T)
        places = np.arange(STEPS + 1) * n // STEPS
        self.below = np.searchsorted(places, np.arange(n + 1), "right") - 1
        self.above = np.searchsorted(places, np.arange(n + 1), "left")
        self.firsts = np.empty((projections, STEPS + 1, -(-n // 64)), np.uint64)  # rows at the first places
        rank, bits = np.empty(n, np.int64), np.zeros((STEPS + 1, self.firsts.shape[2] * 64), bool)
        for j in range(projections):
            rank[order[:, j]] = np.arange(n)
            np.less(rank, places[:, None], out=bits[:, :n])
            self.firsts[j] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
        chance = 2 * NormalDist().cdf(WINDOW) - 1
        self.need = max(1, int(np.ceil(projections * chance - MISSED * np.sqrt(projections * chance * (1 - chance)))))
        self.verified = 0

    def colliding(self, h: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Bitmaps of the rows that reach the threshold, one for each query."""

        def windows():
            for j, s in enumerate(self.sorted):
                lo = self.below[np.searchsorted(s, h[:, j] - WINDOW * radius, "left")]
                hi = self.above[np.searchsorted(s, h[:, j] + WINDOW * radius, "right")]
                yield self.firsts[j, hi] ^ self.firsts[j, lo]

        return _at_least(_added(windows()), self.need)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, best: Best) -> None:
        """Offer ``best`` the rows of the block that may be among the best of each query."""
        n, far = len(self.ids), 2 * self.top  # no two rows lie further apart
        norm = np.sqrt(np.einsum("ij,ij->i", queries, queries))
        reach = self.top * norm  # no row has a larger product

        def distance(q: np.ndarray) -> np.ndarray:
            """Of the last of the best, rounded up."""
            return np.sqrt(np.maximum(2 * self.top ** 2 * (1 + 1e-9 - best.last(q) / reach[q]), 0))

        first = FIRST_RADIUS * self.top
        for at in range(0, len(queries), QUERY_BATCH):
            live = np.arange(at, min(at + QUERY_BATCH, len(queries)))
            live = live[best.last(live) <= reach[live] * (1 + 1e-9)]
            radius = np.minimum(first, distance(live))
            stopped: list[float] = []
            seen = np.zeros((len(live), self.firsts.shape[2]), np.uint64)
            while len(live):
                hits = self.colliding((queries[live] * (self.top / norm[live])[:, None]) @ self.a, radius)
                hits[radius >= far] = _ALL
                fresh = np.unpackbits((hits & ~seen).view(np.uint8), axis=1, count=n, bitorder="little").view(bool)
                seen |= hits
                for i, q in enumerate(live.tolist()):
                    rows = np.flatnonzero(fresh[i])
                    rows = rows[self.ids[rows] != query_ids[q]]
                    if len(rows):
                        best.offer(q, self.ids[rows], self.vectors[rows] @ queries[q])
                        self.verified += len(rows)
                limit = np.minimum(distance(live), far)
                open_ = radius < limit
                stopped += radius[~open_].tolist()
                live, seen = live[open_], seen[open_]
                radius = np.minimum(radius[open_] * WIDER, limit[open_])
            if stopped:
                first = np.quantile(stopped, 0.1) / WIDER  # of the next queries; a start that is too wide costs time only


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): the vectors that take part, as doubles."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    d = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    return d.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))


def _matrix(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and flat values of a list column."""
    return col.value_lengths().to_numpy(), col.flatten().to_numpy()


def nearest(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
            query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``is_query`` holds, its ``k``
    nearest rows found.  ``is_query`` speaks of the columns of ``df``."""
    spark = df.sparkSession
    vectors = usable(df, id_col, vector_col)
    queries = usable(df.where(is_query), id_col, vector_col).dropDuplicates(["id"])
    size = queries.agg(F.sum(F.size("v") * 8 + 16)).first()[0] or 0
    groups = max(1, -(-2 * size // query_bytes))  # hashed groups stay below the bound at twice the mean
    found = []
    for g in range(groups):
        t = queries.where(F.pmod(F.xxhash64("id"), F.lit(groups)) == g).toArrow()
        dims, flat = _matrix(t.column("v").combine_chunks()) if t.num_rows else (np.zeros(0, int), np.zeros(0))
        shared = spark.sparkContext.broadcast((t.column("id").to_numpy(), dims, flat))
        found.append(materialise(vectors.mapInArrow(_searcher(shared, k), "query_id long, vec_id long, score double"), "block-answers"))
        shared.unpersist()
    answers = found[0]
    for f in found[1:]:
        answers = answers.union(f)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return answers.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searcher(shared, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q_dims, q_flat = shared.value
        q_at = np.append(0, np.cumsum(q_dims))

        best = {d: Best(int((q_dims == d).sum()), k) for d in np.unique(q_dims).tolist()}

        def look(held: list[pa.RecordBatch]) -> None:
            t = pa.Table.from_batches(held).combine_chunks()
            ids, (dims, flat) = t.column(0).to_numpy(), _matrix(t.column(1).chunk(0))
            at = np.append(0, np.cumsum(dims))
            for d in np.unique(dims).tolist():
                rows, qs = np.flatnonzero(dims == d), np.flatnonzero(q_dims == d)
                if len(qs):
                    index = CollisionIndex(ids[rows], flat[at[rows][:, None] + np.arange(d)])
                    index.search(q_ids[qs], q_flat[q_at[qs][:, None] + np.arange(d)], best[d])

        held, n = [], 0
        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                part = b.slice(i, BLOCK)
                if n + part.num_rows > BLOCK:
                    look(held)
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if n:
            look(held)
        for d, found in best.items():
            has = np.arange(k) < found.found[:, None]
            for i in range(0, len(has), QUERY_BATCH * 32):
                cut = slice(i, i + QUERY_BATCH * 32)
                own = np.repeat(q_ids[q_dims == d][cut], found.found[cut])
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(found.id[cut][has[cut]]), pa.array(found.score[cut][has[cut]])],
                                                 names=["query_id", "vec_id", "score"])

    return search


def op5_collision_search(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
