"""Kernels against plain versions, and damaged archives."""

import gzip
import random

import numpy as np
import pytest

from mojiframe.llm import annsearch, bpe, langid, linededup, warc
from mojiframe.llm.annsearch import Best, CollisionIndex
from mojiframe.llm.decontaminate import Patterns, _scan
from mojiframe.llm.eliasfano import EliasFano, TrieLevel
from mojiframe.llm.setjoin import parity_bitmaps, shared_counts
from mojiframe.llm.words import ALNUM_WORDS, SPACE_WORDS, split

from . import brute


def buffer(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(x) for x in raw])).astype(np.int64)


@pytest.mark.parametrize("seps, plain", [(SPACE_WORDS, brute.space_words), (ALNUM_WORDS, brute.alnum_words)])
def test_words(seps, plain):
    rng = random.Random(3)
    texts = ["", "".join(rng.choice(" \t\n\x0b\x1f\x20aBZé€-_'0　") for _ in range(400)), "x", "", " y "] + ["a b"] * 3
    w = split(*buffer(texts), seps)
    assert [[w.word(k).decode() for k in range(w.first[i], w.first[i + 1])] for i in range(len(texts))] == [plain(t) for t in texts]
    h = w.hashes()
    by = {}
    for k in range(len(h)):
        assert by.setdefault(w.word(k), h[k]) == h[k]
    assert len(set(by.values())) == len(by)


@pytest.mark.parametrize("n, top", [(1, 1), (7, 100), (2000, 1 << 40), (2000, 30), (3, 1 << 61)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    v = np.sort(rng.integers(0, top, n))
    e = EliasFano.build(v)
    assert (e[np.arange(n)] == v.astype(np.uint64)).all()
    x, zero = np.concatenate([rng.integers(0, top, 300), v[:50], v[-1:] + 1, v[-1:] * 2 + 7]), np.zeros(302 + min(n, 50), np.int64)
    at, hit = e.successor(x.astype(np.uint64), zero, zero + n)
    assert (at == np.searchsorted(v, x)).all() and (hit == np.isin(x, v)).all()
    lo = rng.integers(0, n + 1, len(x))
    hi = np.minimum(lo + rng.integers(0, n + 1, len(x)), n)
    at, hit = e.successor(x.astype(np.uint64), lo, hi)
    want = [a + int(np.searchsorted(v[a:b], y)) for a, b, y in zip(lo, hi, x)]
    assert at.tolist() == want and hit.tolist() == [w < b and v[w] == y for w, b, y in zip(want, hi, x)]


@pytest.mark.parametrize("n", [0, 1, 40, 5000])
def test_trie_level(n):
    rng = np.random.default_rng(n)
    context = rng.integers(2, max(3, n // 3 + 3), n)
    grams = np.unique(np.stack([context, context % 7, rng.integers(2, 300, n)], 1), axis=0)[::-1]
    codes = rng.integers(0, 65535, len(grams)).astype(np.uint16)
    level, at = TrieLevel.build(*grams.T, codes)
    assert (level.find(grams[:, 0], grams[:, 2]) == at).all()
    level = TrieLevel.open(TrieLevel.build(*grams.T, codes, at % 200)[0].to_bytes())
    assert (level.find(grams[:, 0], grams[:, 2]) == at).all() and (level.codes[at] == codes).all() and (level.counts[at] == at % 200).all()
    for m in (0, 3, 4000):
        q = np.stack([rng.integers(0, n + 3, m), rng.integers(0, 310, m)], 1)
        known = {(c, w) for c, _, w in grams.tolist()}
        assert [x >= 0 for x in level.find(*q.T)] == [tuple(x) in known for x in q.tolist()]


def test_wu_manber_on_repetitive_words():
    rng = random.Random(8)
    docs = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 1500))) for _ in range(20)]
    items = [(str(k), " ".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))) for k in range(40)]
    w = split(*buffer(docs), ALNUM_WORDS)
    hit, seen = np.zeros(len(w.starts), bool), [set() for _ in docs]
    _scan(w, w.hashes(), Patterns(items, 10), hit, seen)
    for i, r in enumerate(brute.decontaminate(list(enumerate(docs)), items)):
        assert (int(hit[w.first[i]:w.first[i + 1]].sum()), len(seen[i])) == (r[2], r[3])


def test_parity_bitmaps_bound_the_difference():
    rng = np.random.default_rng(4)

    class One:
        def __init__(self, val):
            self.val, self.size = val, np.array([len(val)])

    for n in (1, 60, 500):
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.concatenate([a[:n * 2 // 3], rng.integers(0, 1 << 63, n // 3).astype(np.uint64)])
        x, y = (np.frombuffer(parity_bitmaps(One(v))[0], np.uint8) for v in (a, b))
        width = min(len(x), len(y))
        x, y = (np.bitwise_xor.reduce(v.reshape(-1, width), axis=0) for v in (x, y))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_shared_counts():
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 60, 25)).astype(np.uint64) for _ in range(50)]
    got = shared_counts(rows)
    for i in range(50):
        for j in range(50):
            assert i == j or got[i, j] == len(np.intersect1d(rows[i], rows[j]))


def test_line_chunks():
    rng = random.Random(6)
    texts = []
    for _ in range(60):
        lines = [" ".join(rng.choice(["ab", "c.", "dd!", "e", "f?"]) for _ in range(rng.choice([0, 1, 2, 5, 9, 30]))) for _ in range(rng.randint(0, 14))]
        texts.append("\n".join(lines) + rng.choice(["", "\n", " "]))
    raw, offsets = buffer(texts)
    for size in [(4, 20), (10, 24), (2, 6), (1, 3)]:
        doc, a, b, c, _ = linededup.chunks(raw, offsets, *size)
        for i, t in enumerate(texts):
            own = doc == i
            got = [tuple(int(v) for v in x) for x in zip(a[own] - offsets[i], b[own] - offsets[i], c[own] - offsets[i])]
            assert got == brute.line_chunks(t, *size), repr(t)


def test_chunk_starts_depend_on_what_is_near():
    rng = random.Random(9)
    for _ in range(20):
        words = [f"w{rng.randrange(1 << 30)}" for _ in range(400)]
        starts = []
        for t in (" ".join(words), " ".join(["an", "odd", "start", *words])):
            raw, offsets = buffer([t])
            starts.append({len(t) - int(x) for x in linededup.chunks(raw, offsets)[1]})
        far = {x for x in starts[0] if x < len(" ".join(words[60:]))}
        assert far == {x for x in starts[1] if x < len(" ".join(words[60:]))}


def test_a_paragraph_is_cut_alike_wherever_it_stands():
    rng = random.Random(10)
    fresh = lambda n: " ".join(f"w{rng.randrange(1 << 30)}" + rng.choice(["", "", "", "", "."]) for _ in range(n))
    for _ in range(200):
        p, cuts = fresh(rng.randint(24, 90)), []
        for before, after in [("", ""), (fresh(30) + "\n", "\n" + fresh(30)), (fresh(3) + "\n", "\n" + fresh(2))]:
            raw, offsets = buffer([before + p + after])
            _, a, _, c, _ = linededup.chunks(raw, offsets)
            cuts.append([(int(x) - len(before), int(y) - len(before)) for x, y in zip(a, c) if len(before) <= x < len(before) + len(p)])
        assert cuts[0] == cuts[1] == cuts[2]


def test_language_features_by_block(monkeypatch):
    rng = random.Random(1)
    texts = ["", None, "..", "a", "é bc"] + ["".join(rng.choice("abcé .1") for _ in range(rng.randint(0, 300))) for _ in range(30)]
    model = langid.fit([t for t in texts[5:]], [("x", "y")["a" in (t or "")[:3]] for t in texts[5:]], dims=1 << 10, epochs=1)
    one = langid.score(model, texts)
    monkeypatch.setattr(langid, "BLOCK", 37)
    two = langid.score(model, texts)
    assert (one[0] == two[0]).all() and np.allclose(one[1], two[1])


def test_long_slices_merge_like_short_ones():
    own = bpe.load(bpe.default_ranks())
    rng = random.Random(2)
    for _ in range(200):
        piece = "".join(rng.choice("abcdeting é") for _ in range(rng.randint(1, 60))).encode()
        assert own.merge_long(piece) == own.merge_many([piece])[0]


def test_pieces_and_decoding(spark):
    texts = ["", None, "don't  stop é 😀", "a\n b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.decode(bpe.encode(df, keep=("text",))).collect():
        raw, own = (r.text or "").encode(), bpe.load(bpe.default_ranks())
        assert bytes(r.decoded) == raw
        ends, cuts = [*r.piece_starts[1:], len(raw)], [*r.piece_ids[1:], len(r.ids)]
        assert [own.decode(r.ids[i:j]) for i, j in zip(r.piece_ids, cuts)] == [raw[i:j] for i, j in zip(r.piece_starts, ends)]


def test_collision_search_widens_until_enough():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 16)) * rng.uniform(0.2, 3, (400, 1))
    best = Best(40, 10)
    CollisionIndex(np.arange(400), x).search(np.arange(40), x[:40], best)
    got = {i: set(a.tolist()) for i, a in enumerate(best.id)}
    want = {i: set([k for k in np.argsort(-(x @ x[i]), kind="stable").tolist() if k != i][:10]) for i in range(40)}
    assert np.mean([len(got[i] & want[i]) / 10 for i in range(40)]) >= 0.9


def test_bitmaps_added():
    rng = np.random.default_rng(4)
    for m in (1, 2, 3, 7, 64, 129):
        bits = rng.random((m, 3, 128)) < rng.random((3, 128))
        digits = annsearch._added(np.packbits(b, axis=1, bitorder="little").view(np.uint64) for b in bits)
        for need in (1, 2, m // 2 + 1, m, m + 1, 4 * m):
            got = np.unpackbits(annsearch._at_least(digits, need).view(np.uint8), axis=1, bitorder="little").view(bool)
            assert (got == (bits.sum(0) >= need)).all()


def test_windows_of_sorted_arrays():
    """Rows that collide against a plain count, windows as wide or a place wider."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((900, 12))
    index = CollisionIndex(np.arange(900), x)
    h, radius = rng.standard_normal((30, 128)) * 2, rng.uniform(0.1, 4, 30)
    got = np.unpackbits(index.colliding(h, radius).view(np.uint8), axis=1, count=900, bitorder="little").view(bool)
    lift = np.sqrt(np.maximum(index.top ** 2 - (x * x).sum(1), 0))
    own = np.column_stack([x, lift]) @ np.random.default_rng([17, 12]).standard_normal((13, 128))
    inside = (np.abs(own[None] - h[:, None]) <= annsearch.WINDOW * radius[:, None, None]).sum(2)
    assert got[inside >= index.need].all() and not got[inside < index.need - 40].any()


def test_blocks_one_after_the_other():
    """The best of the blocks before bound the radius: fewer rows are verified, none is lost beyond the stated recall; a block
    whose norms allow nothing better is passed over; few rows are all found."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((6_000, 24))
    best, verified = Best(60, 20), []
    for at in range(0, 6_000, 1_000):
        index = CollisionIndex(np.arange(at, at + 1_000), x[at:at + 1_000])
        index.search(np.arange(60), x[:60], best)
        verified.append(index.verified)
    assert verified[-1] < verified[0]
    want = [set([k for k in np.argsort(-(x @ x[i]), kind="stable").tolist() if k != i][:20]) for i in range(60)]
    assert np.mean([len(set(best.id[i].tolist()) & want[i]) / 20 for i in range(60)]) >= 0.9
    small = CollisionIndex(np.arange(9_000, 9_100), x[:100] * 1e-3)
    small.search(np.arange(60), x[:60], best)
    assert small.verified == 0
    few = Best(3, 20)
    CollisionIndex(np.arange(5), x[:5]).search(np.arange(3), x[:3], few)
    assert few.found.tolist() == [4, 4, 4]


def _records():
    return [warc.encode_record(i, f"http://a/{i}", f"<p>{i}</p>".encode() * i, None if i != 5 else 2) + b"\r\n\r\n" for i in range(12)]


@pytest.mark.parametrize("pack", [bytes, gzip.compress])
def test_salvage(pack):
    parts = [pack(r) for r in _records()]
    at = np.append(0, np.cumsum([len(p) for p in parts])).tolist()
    data = b"".join(parts)
    gaps = lambda d: [(a, b) for a, b, r, _ in warc.salvage(d) if r is None]
    count = lambda d: sum(r is not None for _, _, r, _ in warc.salvage(d))
    assert (gaps(data), count(data)) == ([], 12)
    hurt = bytearray(data)
    hurt[at[5] - 10] ^= 0x41  # in the payload, or in the checksum of the member
    assert (gaps(bytes(hurt)), count(bytes(hurt))) == ([(at[4], at[5])], 11)
    assert count(data[:at[6] + 30]) == 6 and gaps(data[:at[6] + 30]) == [(at[6], at[6] + 30)]
    assert gaps(b"junk" + data) == [(0, 4)]
    cut = data[:at[2] + 20] + data[at[3] + 10:]  # the end of one and the start of the next are lost
    assert count(cut) == 10 and len(gaps(cut)) == 1
    assert gaps(b"nothing of use") == [(0, 14)] and list(warc.salvage(b"")) == []


def test_salvage_in_files(spark, tmp_path):
    data = bytearray(b"".join(_records()))
    data[len(data) - 10] ^= 0xFF  # in the payload of the last
    (tmp_path / "a.warc").write_bytes(bytes(data))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, _records())))
    (tmp_path / "c.warc").write_bytes(b"")
    got = warc.read_archives(spark, str(tmp_path)).collect()
    assert sum(r.reason is None for r in got) == 23 and sum(r.reason is not None for r in got) == 1
    for r in got:
        if r.type == "response":
            assert bytes(r.payload) == f"<p>{(n := int(r.record_id[12:-1]))}</p>".encode() * n
