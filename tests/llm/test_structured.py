"""Words made to meet under polynomial hashes stay apart: a Thue-Morse word and its complement."""

import numpy as np
import pytest
import tiktoken
from tiktoken.load import load_tiktoken_bpe

from mojiframe.llm import bpe, ngramlm, setjoin
from mojiframe.llm.decontaminate import find_contamination
from mojiframe.llm.words import LONG_SPAN, mix, span_hashes

from . import brute


def pair(n: int) -> tuple[str, str]:
    a = "".join("ab"[i.bit_count() & 1] for i in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


SIZES = [64, 1024, 4096]


@pytest.mark.parametrize("n", SIZES)
def test_hashes_differ(n):
    a, b = pair(n)
    data = np.frombuffer((a + b + a).encode(), np.uint8)
    h = span_hashes(data, np.array([0, n, 2 * n]), np.array([n, 2 * n, 3 * n]))
    assert h[0] == h[2] != h[1]


def test_hash_of_a_span_is_that_of_its_bytes():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 3, 4000).astype(np.uint8)
    starts = rng.integers(0, 3990, 3000)
    ends = np.minimum(starts + rng.integers(0, 12, 3000), 4000)
    ends[:20] = np.minimum(starts[:20] + rng.integers(LONG_SPAN - 3, LONG_SPAN + 9, 20), 4000)
    by = {}
    for h, s, e in zip(span_hashes(data, starts, ends).tolist(), starts, ends):
        assert by.setdefault(data[s:e].tobytes(), h) == h
    assert len(set(by.values())) == len(by)


@pytest.mark.parametrize("n", SIZES)
def test_bpe(spark, n):
    texts = [*pair(n), *[f"x {t} y" for t in pair(n)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in bpe.encode(docs, round_trip=True).collect()}
    plain = bpe.load(bpe.default_ranks())
    import public_tokenizers

    ranks = load_tiktoken_bpe(bpe.default_ranks())
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, t in enumerate(texts):
        assert list(got[i].ids) == want.encode_ordinary(t) and bytes(got[i].decoded) == t.encode() == plain.decode(list(got[i].ids))


@pytest.mark.parametrize("n", SIZES)
def test_decontamination(spark, n):
    a, b = pair(n)
    nine = " ".join(f"w{k}" for k in range(9))
    items, docs = [(1, f"{a} {nine}"), (2, f"{b} {nine}")], [(1, f"{b} {nine}"), (2, f"{a} {nine} {b}"), (3, nine)]
    got = find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = {r[0]: r[2:4] for r in brute.decontaminate(docs, items)}
    assert {r.doc_id: (r.n_hit, len(r["items"])) for r in got.collect()} == want


@pytest.mark.parametrize("n", SIZES)
def test_set_join(spark, n):
    a, b = pair(n)
    docs = spark.createDataFrame([(1, f"{a} x y z"), (2, f"{b} x y z"), (3, f"{a} x y z")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in setjoin.jaccard_components(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_language_model_words():
    words = [w for n in SIZES for w in pair(n)]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    h = span_hashes(data, ends - [len(w) for w in words], ends)
    assert len(set(h.tolist())) == len(words) and ngramlm.END not in h and len(set(mix(h).tolist())) == len(words)
