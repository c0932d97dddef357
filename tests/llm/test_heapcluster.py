"""Clustering with heaps of gaps, against plain rounds over all distances."""

import hashlib
import heapq
import math

import numpy as np
import pytest

from mojiframe.llm import catalog
from mojiframe.llm.heapcluster import Heaps, distances, expired, heap_kmeans, heapify, rescan, step

SMALL = "/root/testdata/sf0.001"


def plain(rows, dim, k, rounds=5):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    c = [v for _, v in start[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x)), no) for no, x in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for no in range(len(c)):
            mine = [v for (_, v), o in zip(kept, own) if o == no]
            if mine:
                c[no] = [sum(x) // len(mine) for x in zip(*mine)]
    last = [(i, *near(v)) for i, v in kept]
    total = sum(d for _, d, _ in last)
    by = {no: sum(d for _, d, o in last if o == no) for no in range(len(c))}
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted(((i, o, d, by[o], total, sha[o]) for i, d, o in last), key=repr)


def check(df, want):
    got = [tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()]
    assert sorted(got, key=repr) == want


@pytest.mark.parametrize("k", [1, 7, 500])
def test_edge_table(spark, edge, read, k):
    check(heap_kmeans(spark.read.parquet(f"{edge}/embeddings.parquet"), dim=8, k=k),
          plain(read(edge, "embeddings", "vec_id", "embedding"), 8, k))


def test_query(spark, read):
    check(catalog.queries()["op11_heap_clusters"](spark, SMALL), plain(read(SMALL, "embeddings", "vec_id", "embedding"), 64, 40))


def test_other_lengths_take_no_part(spark, edge):
    assert catalog.queries()["op11_heap_clusters"](spark, edge).count() == 0


def test_most_vectors_are_not_rescanned(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(0, 5, (12, 16))
    rows = [(i, (centre[i % 12] + rng.normal(0, .3, 16)).tolist()) for i in range(3000)]
    seen = []
    df = heap_kmeans(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), dim=16, k=12, statistics=seen)
    check(df, plain(rows, 16, 12))
    assert seen[0] == 3000 and sum(seen[2:]) < 3000 * len(seen[2:]) / 2


def test_large_components_are_exact():
    rng = np.random.default_rng(1)
    v, c = rng.integers(-2**27, 2**27, (50, 64)), rng.integers(-2**27, 2**27, (9, 64))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y)) for y in c] for x in v]
    assert distances(v, c).tolist() == want


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 4097])
def test_heap_order(n):
    rng = np.random.default_rng(n)
    keys, rows = rng.integers(0, 50, n).astype(float), np.arange(n, dtype=np.int32)
    had = keys.copy()
    heapify(keys, rows)
    assert (had[rows] == keys).all()
    assert all(keys[(i - 1) // 2] <= keys[i] for i in range(1, n))
    assert sorted(keys[expired(keys, 17.0)]) == sorted(had[had <= 17])
    own = had.tolist()
    heapq.heapify(own)
    assert not n or keys[0] == own[0]


def test_bounds_keep_what_a_scan_finds():
    rng = np.random.default_rng(8)
    v = rng.integers(-300, 300, (800, 6))
    v[100:200] = v[0]
    c = v[:20].copy()
    offsets, heaps = np.zeros(20), Heaps.empty(20)
    step(v, heaps, c, offsets, [np.arange(len(v))])
    for _ in range(6):
        new = c + rng.integers(-3, 4, c.shape)
        moved = np.sqrt(((new - c) ** 2).sum(1).astype(float)) * (1 + 1e-9)
        offsets = offsets + moved + np.array([np.delete(moved, a).max() for a in range(20)])
        c = new
        step(v, heaps, c, offsets)
        assert (heaps.owners(len(v)) == rescan(v, c, offsets)[0]).all()
        assert sorted(np.concatenate(heaps.rows).tolist()) == list(range(len(v)))
