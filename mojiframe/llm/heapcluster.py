"""Centroid clustering with heap-ordered bounds (operator 11).

Vectors become integers, ``floor(scale * x)``, so every distance, sum and mean
is exact.  A block of vectors keeps, for each cluster, a binary heap of its
members' gaps between the lower bound on the distance to any other centroid and
the upper bound on that to their own.  When centroids move, a member's gap
shrinks by at most its own centroid's drift and the largest drift of another;
instead of touching the members, a cluster adds that to its offset and a gap is
stored with the offset of the time it went in.  While a heap's top is at or
under the offset it is popped; the vectors popped, and no others, are compared
with all centroids exactly and pushed into the heap of the nearest.

A round is one pass over the blocks, a table in the shared folder that holds
vectors and heaps; the table before it is deleted.  Only sums per cluster and
component (at most ``k * (dim + 1)`` numbers) reach the driver; centroids and
offsets go to the tasks.

Defined results: vectors that are null, of another length or hold null or
non-finite components take no part, nor do those with an integer beyond
+-2**27, whose squared distances a long cannot hold; a null id is in no start
hash, so it starts no cluster; equal vectors may start several clusters, then
ties go to the smaller number and the others stay empty and in their place;
fewer kept vectors than ``k`` start fewer clusters; repeated rows count each; extra
columns are not carried; no vectors give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mojiframe.llm.common import give_back, materialise, narrow, release

#: Largest magnitude of an integer component.
LIMIT = 1 << 27
#: What rounding may add to a bound, as a share of the numbers it came from.
SLACK, OFFSET_SLACK = 1e-9, 1e-12


def heapify(keys: np.ndarray, rows: np.ndarray) -> None:
    """Order both arrays as a binary heap with the smallest key on top.  The nodes of a level
    have subtrees apart, so they all sift down in one step after the other."""
    n = len(keys)
    level = max(0, (n // 2)).bit_length() - 1
    while level >= 0:
        at = np.arange((1 << level) - 1, min((2 << level) - 1, n // 2))
        while len(at):
            child = 2 * at + 1
            right = np.minimum(child + 1, n - 1)
            child = np.where(keys[right] < keys[child], right, child)
            down = keys[child] < keys[at]
            at, child = at[down], child[down]
            keys[at], keys[child] = keys[child], keys[at]
            rows[at], rows[child] = rows[child], rows[at]
            at = child[2 * child + 1 < n]
        level -= 1


def expired(keys: np.ndarray, offset: float) -> np.ndarray:
    """Places of all keys at or under the offset: from the top down, and never below one that is above it."""
    found, at = [], np.zeros(min(1, len(keys)), np.int64)
    while len(at):
        at = at[keys[at] <= offset]
        found.append(at)
        at = np.concatenate([2 * at + 1, 2 * at + 2])
        at = at[at < len(keys)]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows (n x k)."""
    v, c = v.astype(np.int64), c.astype(np.int64)
    big = max(int(np.abs(v).max(initial=0)), int(np.abs(c).max(initial=0)))
    if v.shape[1] * big * big < 1 << 53:  # every partial sum is a whole number that a double holds
        cross = (v.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    else:
        cross = v @ c.T
    return (v * v).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * cross


def rescan(v: np.ndarray, c: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (ties: smaller number) and the key of each vector for that cluster's heap."""
    d = distances(v, c)
    own = np.argmin(d, axis=1)
    if len(c) == 1:
        return own, np.full(len(v), np.inf)
    rows = np.arange(len(v))
    upper = np.sqrt(d[rows, own].astype(np.float64))
    d[rows, own] = np.iinfo(np.int64).max
    lower = np.sqrt(d.min(axis=1).astype(np.float64))
    at = offsets[own]
    return own, at + (lower - upper) - SLACK * (lower + upper) - OFFSET_SLACK * at


class Heaps:
    """The heaps of a block: for each cluster an array of keys and of row numbers."""

    def __init__(self, keys: list[np.ndarray], rows: list[np.ndarray]):
        self.keys, self.rows = keys, rows

    @classmethod
    def empty(cls, k: int) -> Heaps:
        return cls([np.zeros(0)] * k, [np.zeros(0, np.int32)] * k)

    @classmethod
    def loads(cls, sizes: list[int], keys: bytes, rows: bytes) -> Heaps:
        ends = np.cumsum(sizes)[:-1]
        return cls(np.split(np.frombuffer(keys, np.float64), ends), np.split(np.frombuffer(rows, np.int32), ends))

    def dumps(self) -> tuple[list[int], bytes, bytes]:
        return [len(k) for k in self.keys], np.concatenate(self.keys).tobytes(), np.concatenate(self.rows).tobytes()

    def pop(self, cluster: int, offset: float) -> np.ndarray:
        """Rows whose gap has expired; they leave the heap."""
        keys, rows = self.keys[cluster], self.rows[cluster]
        at = expired(keys, offset)
        if not len(at):
            return rows[:0]
        gone = rows[at]
        self.keys[cluster], self.rows[cluster] = np.delete(keys, at), np.delete(rows, at)
        return gone

    def push(self, cluster: int, keys: np.ndarray, rows: np.ndarray) -> None:
        self.keys[cluster] = np.append(self.keys[cluster], keys)
        self.rows[cluster] = np.append(self.rows[cluster], rows.astype(np.int32))

    def settle(self, cluster: int) -> None:
        heapify(self.keys[cluster], self.rows[cluster])

    def owners(self, n: int) -> np.ndarray:
        own = np.zeros(n, np.int64)
        for a, rows in enumerate(self.rows):
            own[rows] = a
        return own


def step(v: np.ndarray, heaps: Heaps, c: np.ndarray, offsets: np.ndarray, popped: list[np.ndarray] | None = None) -> tuple[np.ndarray, int]:
    """One round of a block: changes of the clusters' sums and counts (k x (dim + 1)), and the number of vectors
    rescanned.  ``popped`` names the rows by old cluster at the start (then the heaps are empty)."""
    k, first = len(c), popped is not None
    if not first:
        popped = [heaps.pop(a, offsets[a]) for a in range(k)]
    rows = np.concatenate(popped).astype(np.int64)
    before = np.repeat(np.arange(len(popped)), [len(p) for p in popped])
    change = np.zeros((k, v.shape[1] + 1), np.int64)
    if not len(rows):
        return change, 0
    own, keys = rescan(v[rows], c, offsets)
    touched = set() if first else {a for a, p in enumerate(popped) if len(p)}
    for a in np.unique(own).tolist():
        heaps.push(a, keys[own == a], rows[own == a])
        touched.add(a)
    for a in touched:
        heaps.settle(a)
    for a in range(k):
        came = own == a if first else (own == a) & (before != a)
        left = np.zeros(len(rows), bool) if first else (before == a) & (own != a)
        change[a, :-1] = v[rows[came]].sum(0, dtype=np.int64) - v[rows[left]].sum(0, dtype=np.int64)
        change[a, -1] = came.sum() - left.sum()
    return change, len(rows)


def _blocks_ddl(kind: str) -> str:
    return f"ids array<{kind}>, vectors binary, width int, sizes array<int>, keys binary, members binary, change array<bigint>, rescanned bigint, inertia array<bigint>"


def _names() -> list[str]:
    return ["ids", "vectors", "width", "sizes", "keys", "members", "change", "rescanned", "inertia"]


def _block(ids: pa.Array, v: np.ndarray, heaps: Heaps, change: np.ndarray, scanned: int, c: np.ndarray, last: bool) -> pa.RecordBatch:
    sizes, keys, members = heaps.dumps()
    width = next((w for w in (2, 4) if not len(v) or np.abs(v).max() < 1 << (8 * w - 1)), 8)
    inertia = None
    if last:
        own = heaps.owners(len(v))
        d = _to_own(v, c, own)
        inertia = [[int(d[own == a].sum()) for a in range(len(c))]]
    ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    columns = [ids, pa.array([v.astype(f"i{width}").tobytes()], pa.binary()), pa.array([width], pa.int32()),
               pa.array([sizes], pa.list_(pa.int32())), pa.array([keys], pa.binary()), pa.array([members], pa.binary()),
               pa.array([change.ravel().tolist() if change.any() else None], pa.list_(pa.int64())), pa.array([scanned], pa.int64()),
               pa.array(inertia or [None], pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, names=_names())


def _to_own(v: np.ndarray, c: np.ndarray, own: np.ndarray) -> np.ndarray:
    gap = v.astype(np.int64) - c[own]
    return (gap * gap).sum(1)


def _read(b: pa.RecordBatch, i: int, dim: int) -> tuple[pa.Array, np.ndarray, Heaps]:
    at = lambda name: b.column(b.schema.get_field_index(name))[i]
    v = np.frombuffer(at("vectors").as_py(), f"i{at('width').as_py()}").reshape(-1, dim)
    return at("ids").values, v, Heaps.loads(at("sizes").as_py(), at("keys").as_py(), at("members").as_py())


def _first_pass(kept: DataFrame, kind: str, centroids: list[list[int]], dim: int, scale: int, last: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.array(centroids, np.int64)
        offsets = np.zeros(len(c))
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            v = np.floor(x * scale).astype(np.int64)
            heaps = Heaps.empty(len(c))
            change, scanned = step(v, heaps, c, offsets, [np.arange(len(v))])
            yield _block(b.column(0), v, heaps, change, scanned, c, last)
        give_back()

    return kept.mapInArrow(run, _blocks_ddl(kind))


def _next_pass(blocks: DataFrame, kind: str, centroids: list[list[int]], offsets: list[float], dim: int, last: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, offset = np.array(centroids, np.int64), np.array(offsets)
        for b in batches:
            for i in range(b.num_rows):
                ids, v, heaps = _read(b, i, dim)
                change, scanned = step(v, heaps, c, offset)
                yield _block(ids, v, heaps, change, scanned, c, last)
        give_back()

    return blocks.mapInArrow(run, _blocks_ddl(kind))


def _drift(old: list[list[int]], new: list[list[int]], offsets: list[float]) -> list[float]:
    """Offsets after a move: a cluster's own drift and the largest of another."""
    moved = [sum((a - b) ** 2 for a, b in zip(x, y)) ** 0.5 * (1 + SLACK) for x, y in zip(old, new)]
    out = []
    for a, offset in enumerate(offsets):
        other = max((m for b, m in enumerate(moved) if b != a), default=0.0)
        out.append((offset + moved[a] + other) * (1 + OFFSET_SLACK))
    return out


def _start(kept: DataFrame, k: int, scale: int, salt: int) -> list[list[int]]:
    """The k vectors of smallest hash; equal hashes by their components."""
    rows = kept.where(F.col("id").isNotNull()).withColumn(
        "h", F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)).orderBy("h", "v").limit(k)
    return [[int(np.floor(float(x) * scale)) for x in r.v] for r in rows.collect()]


def heap_kmeans(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = 64, k: int = 40,
                rounds: int = 5, scale: int = 256, salt: int = 2, statistics: list | None = None) -> DataFrame:
    """One row per kept vector: id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.
    ``statistics`` receives the number of vectors rescanned in each pass."""
    spark = vectors.sparkSession
    t = narrow(vectors, id=id_col, v=vec_col)
    kind = t.schema["id"].dataType.simpleString()
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * scale < LIMIT))
    kept = t.where((F.size("v") == dim) & fine).select("id", F.col("v").cast("array<double>").alias("v"))
    empty = f"{id_col} {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    c = _start(kept, k, scale, salt)
    if not c:
        return spark.createDataFrame([], empty)
    offsets, sums, blocks = [0.0] * len(c), [[0] * (dim + 1) for _ in c], None
    for r in range(rounds + 1):
        last = r == rounds
        made = _first_pass(kept, kind, c, dim, scale, last) if blocks is None else _next_pass(blocks, kind, c, offsets, dim, last)
        made = materialise(made, f"cluster-blocks-{r}")
        if blocks is not None:
            release(blocks)
        blocks = made
        if statistics is not None:
            statistics.append(blocks.agg(F.sum("rescanned")).first()[0])
        if last:
            break
        change = blocks.select(F.posexplode("change").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
        for row in change.collect():  # at most k * (dim + 1) numbers
            sums[row.at // (dim + 1)][row.at % (dim + 1)] += int(row.x)
        new = [[x // s[-1] for x in s[:-1]] if s[-1] else own for s, own in zip(sums, c)]
        offsets, c = _drift(c, new, offsets), new

    per = blocks.select(F.posexplode("inertia").alias("cluster", "x")).groupBy("cluster").agg(F.sum("x").alias("x")).collect()
    inertia = {row.cluster: int(row.x) for row in per}
    digests = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    report = spark.createDataFrame([(a, inertia.get(a, 0), sum(inertia.values()), digests[a]) for a in range(len(c))],
                                   "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = np.array(c, np.int64)
        for b in batches:
            for i in range(b.num_rows):
                ids, v, heaps = _read(b, i, dim)
                own = heaps.owners(len(v))
                yield pa.RecordBatch.from_arrays([ids, pa.array(own, pa.int32()), pa.array(_to_own(v, centroids, own))], names=[id_col, "cluster", "distance"])
        give_back()

    found = blocks.mapInArrow(rows, f"`{id_col}` {kind}, cluster int, distance long")
    return found.join(F.broadcast(report), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


DIM, K, ROUNDS, SCALE, SALT = 64, 40, 5, 256, 2


def op11_heap_clusters(spark, sf_dir: str) -> DataFrame:
    return heap_kmeans(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), dim=DIM, k=K, rounds=ROUNDS, scale=SCALE, salt=SALT)


def _sql() -> str:
    def assign(r: int) -> str:
        return f"""
a{r} AS MATERIALIZED (SELECT p, arg_min(no, dist * 1000 + no)::INT AS cluster, min(dist) AS distance FROM
    (SELECT v.p, c.no, list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS dist
     FROM v, c{r} c) GROUP BY p)"""

    def move(r: int) -> str:
        return f"""
m{r} AS MATERIALIZED (SELECT a.cluster AS no, i, CAST(sum(v.x[i]) AS HUGEINT) AS s, count(*) AS n
    FROM a{r} a JOIN v USING (p), range(1, {DIM + 1}) t(i) GROUP BY ALL),
n{r} AS MATERIALIZED (SELECT no, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM m{r} GROUP BY no),
c{r + 1} AS MATERIALIZED (SELECT c.no, coalesce(n.x, c.x) AS x FROM c{r} c LEFT JOIN n{r} n USING (no))"""

    parts = [f"""
v AS MATERIALIZED (SELECT row_number() OVER () AS p, vec_id, list_transform(embedding, lambda e: CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS x
    FROM embeddings WHERE len(embedding) = {DIM} AND list_bool_and(list_transform(embedding, lambda e: coalesce(isfinite(e), false)))),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS no, x FROM
    (SELECT sha256('{SALT}:' || vec_id) AS h, x FROM v WHERE vec_id IS NOT NULL ORDER BY h, x LIMIT {K}))"""]
    for r in range(ROUNDS):
        parts += [assign(r), move(r)]
    parts.append(assign(ROUNDS))
    return "WITH " + ",".join(parts) + f"""
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN v USING (p) JOIN c{ROUNDS} c ON c.no = a.cluster"""


SQL = _sql()
