"""What the language model has on disk: counts that go part by part, compact requests and levels."""

import os

import numpy as np

from mojiframe.llm import ngramlm
from mojiframe.llm.eliasfano import Counts, TrieLevel


def test_counts_go_as_the_level_comes(spark, monkeypatch):
    from pyspark.sql import functions as F

    docs = [(i, " ".join(f"w{(i * k * k) % 89}" for k in range(80))) for i in range(20)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    score = lambda: sorted(tuple(r) for r in ngramlm.score_texts(frame, F.col("doc_id") < 15).collect())
    whole = score()
    left, learn = [], ngramlm.learn_grams

    def watched(asked, order, *rest):
        folder = asked.inputFiles()[0].removeprefix("file:").replace("//", "/").split("/turn=")[0]
        left.append((order, sum(d.startswith("turn=") for d in os.listdir(folder))))
        return learn(asked, order, *rest)

    monkeypatch.setattr(ngramlm, "learn_grams", watched)
    monkeypatch.setattr(ngramlm, "SHARD_BYTES", 16)
    assert score() == whole
    assert left == [(k, ngramlm.TURNS - t) for k in (2, 3) for t in range(ngramlm.TURNS)]


def test_rare_short_contexts_below_the_least_count(spark):
    """An n-gram whose tail is too rare to be a context is still learned from."""
    from pyspark.sql import functions as F

    from . import brute

    docs = [(1, "a b c a b d a b c"), (2, "b c a b c a"), (3, "a b c d a"), (4, "x a b c a b d")]
    train = [i < 4 for i, _ in docs]
    want = {i: r for (i, _), r in zip(docs, brute.Lm(docs, train, 4, ngramlm.MU, ngramlm.POWER, 3, ngramlm.STEP).rows())}
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for r in ngramlm.score_texts(frame, F.col("doc_id") < 4, order=4, min_context=3).collect():
        assert abs(r.score - want[r.doc_id][4]) <= 2 * ngramlm.STEP * r.n_tokens ** 0.5


def test_levels_are_compact():
    rng = np.random.default_rng(5)
    n = 40_000
    context, word = rng.permutation(n * 4)[:n], rng.integers(2, 5000, n)
    short = context % 900
    count = np.where(rng.random(n) < 0.01, rng.integers(255, 1 << 40, n), rng.integers(1, 9, n))
    level, at = TrieLevel.build(context, short, word, np.zeros(n, np.uint16), count)
    data = level.to_bytes()
    assert len(data) < 9.5 * n
    level = TrieLevel.open(data)
    assert (level.counts[at] == count).all() and (level.find(context, word) == at).all()
    by = np.argsort(at)
    c, w = level.grams(at[by])
    assert (w == word[by]).all() and (c == context[by]).all()
    assert len(Counts.build(count).small) == n


def test_select_in_long_runs():
    """Values that lie close together and far apart: words of ones alone, and of zeros."""
    from mojiframe.llm.eliasfano import EliasFano

    v = np.concatenate([np.arange(9000), [1 << 33, (1 << 33) + 5], (1 << 34) + np.arange(7000) * 3])
    e = EliasFano.build(v)
    i = np.arange(len(v))
    assert (e[i] == v).all()
    a, b = e.pairs(i[:-1])
    assert (a == v[:-1]).all() and (b == v[1:]).all()
    x = np.concatenate([v, v + 1, v - 1])[1:]
    x = x[x >= 0]
    zero = np.zeros(len(x), np.int64)
    at, hit = e.successor(x.astype(np.uint64), zero, zero + len(v))
    assert (at == np.searchsorted(v, x)).all() and (hit == np.isin(x, v)).all()


def test_a_task_maps_each_level_once(tmp_path, monkeypatch):
    """With more shards than a task held mapped every chunk opened every level anew; words need few shards."""
    opened = []
    monkeypatch.setattr(ngramlm.Levels, "_open", lambda self, order, shard: opened.append((order, shard)))
    levels = ngramlm.Levels(str(tmp_path), 700, 1)
    shard = np.arange(700)
    for _ in range(3):
        for order in (2, 3):
            levels.find(order, shard, shard, shard)
        levels.find(1, shard % levels.of(1), shard.astype(np.uint64))
    assert len(opened) == len(set(opened)) == 1400 + levels.of(1) and levels.of(1) < 50


def test_scores_do_not_depend_on_word_shards(spark, monkeypatch):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(i, " ".join(f"w{(i * k * k) % 89}" for k in range(60))) for i in range(16)], "doc_id long, text string")
    monkeypatch.setattr(ngramlm, "SHARD_BYTES", 16)
    score = lambda: sorted(tuple(r) for r in ngramlm.score_texts(frame, F.col("doc_id") < 12).collect())
    few = score()
    monkeypatch.setattr(ngramlm, "WORD_SHARE", 1)
    assert score() == few
