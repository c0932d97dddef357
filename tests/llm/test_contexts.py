"""The language model uses contexts from their first count on."""

import pytest

from mojiframe.llm import ngramlm

from . import brute


@pytest.mark.parametrize("order", [2, 3, 4])
def test_rare_contexts_are_learned(spark, order):
    from pyspark.sql import functions as F

    docs = [(1, "once upon a time there was one rare context"), (2, "twice seen words here twice seen words there"),
            (3, "a rare context and a rare context once upon a time"), (4, "words here there was a time"), (5, "unknown things upon a time")]
    train = [i < 4 for i, _ in docs]
    want = {i: r for (i, _), r in zip(docs, brute.Lm(docs, train, order, ngramlm.MU, ngramlm.POWER, 1, ngramlm.STEP).rows())}
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in ngramlm.score_texts(frame, F.col("doc_id") < 4, order=order).collect()}
    assert got.keys() == want.keys()
    for i, r in got.items():
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[i][:3]
        assert r.score == pytest.approx(want[i][4], abs=2 * ngramlm.STEP * r.n_tokens ** 0.5)
    assert got[1].score > got[1].base_score + 1


def test_shards_grow_with_the_input(spark, monkeypatch):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 97}" for k in range(60))) for i in range(20)], "doc_id long, text string")
    score = lambda: sorted(tuple(r) for r in ngramlm.score_texts(frame, F.col("doc_id") < 15, order=2).collect())
    used, count = [], ngramlm.count_words
    monkeypatch.setattr(ngramlm, "count_words", lambda chunks, levels: used.append(levels.shards) or count(chunks, levels))
    few = score()
    monkeypatch.setattr(ngramlm, "SHARD_BYTES", 16)
    many = score()
    assert used[0] == 1 < used[1]
    for a, b in zip(few, many, strict=True):
        assert a == pytest.approx(b)
