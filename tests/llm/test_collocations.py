"""Phrase mining, against counting in plain dictionaries."""

import re
from collections import Counter

import numpy as np
import pytest

from mojiframe.llm import catalog, quotient
from mojiframe.llm.collocations import _Level, collocations

from .brute import LOWER

SMALL = "/root/testdata/sf0.001"


def plain(rows, max_words=5, min_count=100, scale=1000, cover=100, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, max_words + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i:i + m])] += 1
    long = [(lang, p) for (lang, p), a in f.items() if len(p) > 1 and a >= min_count]
    inside = Counter()
    for lang, p in long:
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                inside[lang, p[i:i + m]] = max(inside[lang, p[i:i + m]], f[lang, p])
    out = {}
    for lang, p in long:
        a = f[lang, p]
        cuts = [(scale * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        if 100 * inside[lang, p] < cover * a:
            score, _, left, right = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, rank, p.decode(), -a, left, right, n[lang], -score) for lang, all_ in out.items()
                  for rank, (score, a, p, left, right) in enumerate(sorted(all_)[:top], 1))


def result(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("params", [{"min_count": 2}, {"min_count": 5, "cover": 60, "top": 7}, {"min_count": 3, "max_words": 3}])
def test_edge_table(spark, edge, read, params):
    docs = spark.read.parquet(f"{edge}/documents.parquet").repartition(3)
    want = plain(read(edge, "documents", "lang", "text"), **params)
    assert want and result(collocations(docs, chunk_bytes=3_000, shard_items=500, **params)) == want


def test_query(spark, edge, read):
    for folder in (edge, SMALL):
        assert result(catalog.queries()["op12_quotient_phrases"](spark, folder)) == plain(read(folder, "documents", "lang", "text"))


def test_nothing_frequent(spark):
    docs = spark.createDataFrame([("one two three", "en"), (None, None), ("", "de")], "text string, lang string")
    assert collocations(docs, min_count=2).count() == 0


def test_products_beyond_a_long(spark):
    docs = spark.createDataFrame([("a b " * 30, "en")] * 40, "text string, lang string")
    got = result(collocations(docs, min_count=100, scale=10**14))
    assert got == plain([("en", "a b " * 30)] * 40, min_count=100, scale=10**14)


@pytest.mark.parametrize("bits", [1, 2, 7, 33, 63, 64])
def test_permutation_is_undone(bits):
    rng = np.random.default_rng(bits)
    x = np.arange(1 << bits, dtype=np.uint64) if bits < 12 else rng.integers(0, (1 << bits) - 1, 5000, dtype=np.uint64)
    p = quotient.Permutation(bits)
    assert (p.inverse(p(x)) == x).all() and int(p(x).max()) < 1 << bits
    assert bits >= 12 or len(set(p(x).tolist())) == 1 << bits


@pytest.mark.parametrize("bits, n", [(1, 0), (1, 2), (4, 16), (9, 300), (30, 1), (30, 5000), (64, 3000)])
def test_filter_gives_back_values_and_counts(bits, n):
    rng = np.random.default_rng(n)
    top = (1 << bits) - 1
    values = np.unique(rng.integers(0, top, 3 * n, dtype=np.uint64, endpoint=True) if bits > 12 else rng.permutation(top + 1).astype(np.uint64))[:n]
    if bits == 30 and n > 1:
        values = np.unique(values >> np.uint64(9))  # many values in few buckets
    counts = rng.choice([1, 1, 1, 2, 255, 256, 257, 70_000, 2**40], len(values)).astype(np.int64)
    got = quotient.read(quotient.build(values, counts, bits))
    assert got[0].tolist() == values.tolist() and got[1].tolist() == counts.tolist()


def test_merge_adds_counts():
    a, b = (np.array([1, 5, 9], np.uint64), np.array([1, 2, 3])), (np.array([5, 7], np.uint64), np.array([10, 1]))
    values, counts = quotient.merge([a, b, (a[0][:0], a[1][:0])])
    assert values.tolist() == [1, 5, 7, 9] and counts.tolist() == [1, 12, 1, 3]


def test_requests_fall_into_their_shards():
    rng = np.random.default_rng(2)
    grams = rng.integers(0, 9, 500).astype(np.uint64)
    level = _Level(4, 4, 3)
    total = Counter()
    for *_, shard, data in level.requests(7, "en", grams, grams):
        values, counts = quotient.read(data)
        keys = level.order.inverse(values | np.uint64(shard << 5))
        total.update(dict(zip(keys.tolist(), counts.tolist())))
    g = grams.tolist()
    assert total == Counter(16 * x + y for x, y in zip(g, g[1:]) if x and y)
