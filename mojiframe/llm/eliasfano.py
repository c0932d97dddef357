"""Elias-Fano sequences and the levels of an n-gram trie, in flat buffers that
lie in memory-mapped files.  All queries are vectorised and work on the compact form."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_ONE = _U(1)
#: Values that are compared one after the other before a binary search takes the rest.
STEPS = 3
#: One of so many ones or zeros has its word listed.
EVERY = 64
_BYTES, _TOPS = _U(0x0101010101010101), _U(0x8080808080808080)
#: The places of the ones of each byte, in order.
_PLACES = np.zeros((256, 8), _U)
for _b in range(256):
    _PLACES[_b, :_b.bit_count()] = [k for k in range(8) if _b >> k & 1]


def _pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """``width`` low bits of each value, one after the other, in 64-bit words."""
    out = np.zeros(len(values) * width // 64 + 2, _U)
    if width and len(values):
        at = np.arange(len(values), dtype=np.int64) * width
        word, shift = at >> 6, (at & 63).astype(_U)
        np.bitwise_or.at(out, word, values << shift)
        spill = (shift > _U(0)) & (shift + _U(width) > _U(64))
        np.bitwise_or.at(out, word[spill] + 1, values[spill] >> (_U(64) - shift[spill]))
    return out


def _read_bits(words: np.ndarray, i: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros(len(i), _U)
    at = i * width
    word, shift = at >> 6, (at & 63).astype(_U)
    high = np.where(shift > _U(0), words[word + 1] << ((_U(64) - shift) & _U(63)), _U(0))
    return (words[word] >> shift | high) & ((_ONE << _U(width)) - _ONE)


class EliasFano:
    """A monotone sequence: low bits in an array, high bits as a unary bit vector with a directory
    of the ones before each word and of the words of every 64th one and zero."""

    FIELDS = ("head", "low", "high", "ones", "one_words", "zero_words")

    def __init__(self, head, low, high, ones, one_words, zero_words):
        self.head, self.low, self.high, self.ones, self.one_words, self.zero_words = head, low, high, ones, one_words, zero_words
        self.n, self.width, self.last = head.tolist()  # last: the greatest high bits

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        v = values.astype(_U)
        n = len(v)
        ratio = (int(v[-1]) + 1) // n if n else 0
        width = min(62, max(0, ratio.bit_length() - 1))
        top = (v >> _U(width)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(top[-1]) >> 6) + 1 if n else 0, _U)
        np.bitwise_or.at(high, top >> 6, _ONE << (top & 63).astype(_U))
        kind = np.int32 if len(high) < 1 << 25 else np.int64
        ones = np.append(0, np.cumsum(np.bitwise_count(high), dtype=kind)).astype(kind)
        zeros = (np.arange(len(ones), dtype=kind) << 6) - ones
        listed = [np.searchsorted(x, np.arange(0, int(x[-1]), EVERY, kind), "right").astype(kind) - 1 for x in (ones, zeros)]
        head = np.array([n, width, int(v[-1]) >> width if n else 0], np.int64)
        return cls(head, _pack_bits(v & ((_ONE << _U(width)) - _ONE), width), high, ones, *(x.astype(kind) for x in listed))

    def _zeros(self) -> np.ndarray:
        """The zeros before each word."""
        return (np.arange(len(self.ones), dtype=self.ones.dtype) << 6) - self.ones

    def _word(self, t: np.ndarray, ones: bool) -> np.ndarray:
        """The word of the one or zero that comes after ``t`` others: a few words from the last that is listed."""
        before = (lambda w: self.ones[w]) if ones else lambda w: (w << 6) - self.ones[w]
        word = (self.one_words if ones else self.zero_words)[t >> EVERY.bit_length() - 1].astype(np.int64)
        rows = np.flatnonzero(before(word + 1) <= t)
        for _ in range(STEPS):
            if not len(rows):
                return word
            word[rows] += 1
            rows = rows[before(word[rows] + 1) <= t[rows]]
        if len(rows):
            word[rows] = np.searchsorted(self.ones if ones else self._zeros(), t[rows].astype(self.ones.dtype), "right") - 1
        return word

    @staticmethod
    def _nth(w: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The place of the one in each word that comes after ``left`` others: sums of ones up to each byte
        tell the byte, a table the place in it."""
        left = left.astype(_U)
        x = w - (w >> _ONE & _U(0x5555555555555555))
        x = (x & _U(0x3333333333333333)) + (x >> _U(2) & _U(0x3333333333333333))
        sums = (x + (x >> _U(4)) & _U(0x0F0F0F0F0F0F0F0F)) * _BYTES
        past = (left * _BYTES | _TOPS) - sums & _TOPS  # bytes that end with no more than ``left`` ones
        shift = np.bitwise_count(past).astype(_U) << _U(3)
        left -= sums << _U(8) >> shift & _U(0xFF)
        return (shift + _PLACES[w >> shift & _U(0xFF), left]).astype(np.int64)

    def _places(self, i: np.ndarray) -> np.ndarray:
        """The places in the unary bits of the values at the positions ``i``."""
        word = self._word(i, True)
        return (word << 6) + self._nth(self.high[word], (i - self.ones[word]).astype(np.int64))

    def _values(self, i: np.ndarray, at: np.ndarray) -> np.ndarray:
        return ((at - i).astype(_U) << _U(self.width)) | _read_bits(self.low, i, self.width)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        """The values at the positions ``i``."""
        return self._values(i, self._places(i))

    def pairs(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at the positions ``i`` and behind them: the next one in the unary bits is the next value's."""
        at = self._places(i)
        word, after = at >> 6, (at & 63).astype(_U)
        rest = self.high[word] >> after >> _ONE << _ONE << after
        open_ = np.flatnonzero(rest == 0)
        while len(open_):
            word[open_] += 1
            rest[open_] = self.high[word[open_]]
            open_ = open_[rest[open_] == 0]
        following = (word << 6) + np.bitwise_count((rest & -rest) - _ONE)
        return self._values(i, at), self._values(i + 1, following)

    def _starts(self, top: np.ndarray) -> np.ndarray:
        """How many values have high bits below ``top``, from the zero before them in the unary bits."""
        word = self._word(top - 1, False)
        at = (word << 6) + self._nth(~self.high[word], top - 1 - (word << 6) + self.ones[word])
        return at - (top - 1)

    def successor(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First position in [lo, hi) with a value of at least x (hi if none), and whether it is x.  The
        high bits of x lead to the few values that share them; the low bits decide among those."""
        if not self.n:
            return hi.copy(), np.zeros(len(x), bool)
        top = (x >> _U(self.width)).astype(np.int64)
        low = x & ((_ONE << _U(self.width)) - _ONE)
        begin, same = np.full(len(x), self.n), np.zeros(len(x), bool)
        begin[top == 0] = 0
        some = np.flatnonzero((top <= self.last) & (top > 0))
        begin[some] = self._starts(top[some])
        live = np.flatnonzero(top <= self.last)
        for _ in range(STEPS):  # mostly one or two values share the high bits
            at = begin[live]
            bit = at + top[live]
            live = live[(self.high[bit >> 6] >> (bit & 63).astype(_U) & _ONE).astype(bool)]
            found = _read_bits(self.low, begin[live], self.width)
            same[live] = found == low[live]
            live = live[found < low[live]]
            begin[live] += 1
            if not len(live):
                break
            live = live[begin[live] < self.n]
        if len(live):
            end = np.full(len(live), self.n)
            inner = np.flatnonzero(top[live] < self.last)
            end[inner] = self._starts(top[live[inner]] + 1)
            stop, first, least, rows = end.copy(), begin[live], low[live], np.arange(len(live))
            rows = rows[first < end]
            while len(rows):
                mid = (first[rows] + end[rows]) >> 1
                less = _read_bits(self.low, mid, self.width) < least[rows]
                first[rows] = np.where(less, mid + 1, first[rows])
                end[rows] = np.where(less, end[rows], mid)
                rows = rows[first[rows] < end[rows]]
            begin[live] = first
            inner = np.flatnonzero(first < stop)
            same[live[inner]] = _read_bits(self.low, first[inner], self.width) == least[inner]
        at = np.clip(begin, lo, hi)
        hit = same & (at == begin) & (at < hi)
        behind = np.flatnonzero((begin < lo) & (lo < hi))  # equal values may lie on both sides of lo
        if len(behind):
            hit[behind] = self[lo[behind]] == x[behind]
        return at, hit


class Counts:
    """Counts, nearly all small, in a byte each; those from 255 on lie apart with their positions."""

    def __init__(self, small: np.ndarray, where: np.ndarray, great: np.ndarray):
        self.small, self.where, self.great = small, where, great

    @classmethod
    def build(cls, counts: np.ndarray) -> Counts:
        where = np.flatnonzero(counts >= 255)
        return cls(np.minimum(counts, 255).astype(np.uint8), where.astype(np.uint32), counts[where].astype(np.int64))

    def __len__(self) -> int:
        return len(self.small)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        out = self.small[at].astype(np.int64)
        apart = np.flatnonzero(out == 255)
        out[apart] = self.great[np.searchsorted(self.where, at[apart].astype(np.uint32))]
        return out


def _pair_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An order by a, then b; equal pairs in any order."""
    if len(a) and (int(a.max()) + 1) * (int(b.max()) + 1) >= 1 << 63:
        return np.lexsort((b, a))
    return np.argsort(a.astype(np.int64) * (int(b.max()) + 1 if len(b) else 1) + b.astype(np.int64))


def _relative(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Ranges that ascend become one ascending sequence: each starts above the last of the one before."""
    last = values[ptr[1:] - 1].astype(np.int64) + 1
    base = np.append(0, np.cumsum(last))[:-1]
    return values + np.repeat(base, np.diff(ptr))


def to_bytes(arrays: list[np.ndarray]) -> bytes:
    """Arrays one after the other, each from a place divisible by eight, behind their types and sizes."""
    raw = [np.ascontiguousarray(a).tobytes() for a in arrays]
    head = [a.dtype.str.encode().ljust(8) + np.int64(len(x)).tobytes() for a, x in zip(arrays, raw)]
    return np.int64(len(raw)).tobytes() + b"".join(head) + b"".join(x + bytes(-len(x) % 8) for x in raw)


def views(buffer) -> list[np.ndarray]:
    """The arrays of ``to_bytes`` as views of a buffer, such as a mapped file; nothing is copied."""
    count = int(np.frombuffer(buffer, np.int64, 1)[0])
    at, out = 8 + 16 * count, []
    for k in range(count):
        kind = np.dtype(bytes(np.frombuffer(buffer, np.uint8, 8, 8 + 16 * k)).decode().strip())
        size = int(np.frombuffer(buffer, np.int64, 1, 16 + 16 * k)[0])
        out.append(np.frombuffer(buffer, kind, size // kind.itemsize, at))
        at += size + -size % 8
    return out


class WordLevel:
    """The words of a shard: their hashes in order, and their counts."""

    def __init__(self, hashes: EliasFano, counts: np.ndarray):
        self.hashes, self.counts = hashes, counts

    def to_bytes(self) -> bytes:
        return to_bytes([*(getattr(self.hashes, f) for f in EliasFano.FIELDS), self.counts])

    @classmethod
    def open(cls, buffer) -> WordLevel:
        *parts, counts = views(buffer)
        return cls(EliasFano(*parts), counts)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Positions of the hashes, -1 where there is none."""
        zero = np.zeros(len(h), np.int64)
        at, hit = self.hashes.successor(h, zero, zero + self.hashes.n)
        return np.where(hit, at, -1)


class TrieLevel:
    """N-grams of one order.  An n-gram is (context, short, word): ``context``
    numbers the n-1 words before, ``short`` the context without its first word.
    A word is coded by its place among the successors of the short context, and
    the places of each context's successors are one range of a monotone sequence.
    With each n-gram lie its code and, where given, its count."""

    PARTS = ("short_ptr", "short_words", "contexts", "ptr", "places")

    def __init__(self, parts: dict[str, EliasFano], own_short: np.ndarray, codes: np.ndarray, counts: Counts):
        self.parts, self.own_short, self.codes, self.counts = parts, own_short, codes, counts
        self.short_bits = max(0, parts["short_ptr"].n - 2).bit_length()  # of the number of a short context

    @classmethod
    def build(cls, context: np.ndarray, short: np.ndarray, word: np.ndarray, codes: np.ndarray,
              counts: np.ndarray | None = None) -> tuple[TrieLevel, np.ndarray]:
        """The level and, for each n-gram given, its position in it."""
        n = len(context)
        by = _pair_order(short, word)
        s, w = short[by], word[by]
        new_s = np.append(True, s[1:] != s[:-1])[:n]
        new = np.append(True, (s[1:] != s[:-1]) | (w[1:] != w[:-1]))[:n]
        starts = np.flatnonzero(new_s[new])
        pair = np.cumsum(new) - 1
        place = np.empty(n, np.int64)
        place[by] = pair - starts[np.cumsum(new_s) - 1] if n else pair
        short_ptr = np.append(starts, new.sum())
        if (context[1:] >= context[:-1]).all():
            # contexts side by side: only those with several words are left to order
            several = np.zeros(n, bool)
            several[1:] = context[1:] == context[:-1]
            several[:-1] |= several[1:].copy()
            rows, order = np.flatnonzero(several), np.arange(n)
            order[rows] = rows[_pair_order(context[rows], place[rows])]
        else:
            order = _pair_order(context, place)
        c = context[order]
        first = np.flatnonzero(np.append(True, c[1:] != c[:-1])[:n])
        ptr = np.append(first, n)
        parts = {
            "short_ptr": short_ptr, "short_words": _relative(w[new].astype(np.int64), short_ptr) if n else w,
            "contexts": c[first], "ptr": ptr, "places": _relative(place[order], ptr) if n else place,
        }
        of = np.empty(n, np.int64)
        of[by] = np.cumsum(new_s) - 1
        at = np.empty(n, np.int64)
        at[order] = np.arange(n)
        level = cls({k: EliasFano.build(v) for k, v in parts.items()}, np.zeros(0, _U), codes[order],
                    Counts.build(counts[order] if counts is not None else np.zeros(0, np.int64)))
        level.own_short = _pack_bits(of[order][first].astype(_U), level.short_bits)
        return level, at

    def to_bytes(self) -> bytes:
        return to_bytes([*(getattr(self.parts[p], f) for p in self.PARTS for f in EliasFano.FIELDS), self.own_short, self.codes,
                         self.counts.small, self.counts.where, self.counts.great])

    @classmethod
    def open(cls, buffer) -> TrieLevel:
        *flat, own_short, codes, small, where, great = views(buffer)
        m = len(EliasFano.FIELDS)
        return cls({p: EliasFano(*flat[m * i:m * i + m]) for i, p in enumerate(cls.PARTS)}, own_short, codes, Counts(small, where, great))

    def _short(self, k: np.ndarray) -> np.ndarray:
        return _read_bits(self.own_short, k, self.short_bits).astype(np.int64)

    @staticmethod
    def _base(seq: EliasFano, lo: np.ndarray) -> np.ndarray:
        """Where ranges that start at ``lo`` begin to count: one above the last value of the range before."""
        base = np.zeros(len(lo), _U)
        inner = np.flatnonzero(lo > 0)
        base[inner] = seq[lo[inner] - 1] + _ONE
        return base

    def grams(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The contexts and words of the n-grams at the positions ``at``, which ascend."""
        p = self.parts
        zero = np.zeros(len(at), np.int64)
        k = p["ptr"].successor((at + 1).astype(_U), zero, zero + p["ptr"].n)[0] - 1
        own = np.append(True, k[1:] != k[:-1])[:len(k)]
        of, k = np.cumsum(own) - 1, k[own]
        place = p["places"][at] - self._base(p["places"], p["ptr"][k].astype(np.int64))[of]
        place = place.astype(np.int64)
        if self.short_bits:
            begin = p["short_ptr"][self._short(k)].astype(np.int64)
            word = p["short_words"][begin[of] + place] - self._base(p["short_words"], begin)[of]
        else:  # one short context: one range from zero
            word = p["short_words"][place]
        return p["contexts"][k].astype(np.int64)[of], word.astype(np.int64)

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Positions of the n-grams, -1 where there is none; quickest with equal contexts side by side."""
        out = np.full(len(context), -1, np.int64)
        if not len(self.codes) or not len(out):
            return out
        p = self.parts
        own = np.append(True, context[1:] != context[:-1])
        seen, inverse = context[own], np.cumsum(own) - 1
        zero = np.zeros(len(seen), np.int64)
        k, known = p["contexts"].successor(seen.astype(_U), zero, zero + p["contexts"].n)
        k = k[known]
        at = np.cumsum(known) - 1  # of a context among those known
        live = np.flatnonzero(known[inverse])

        def within(seq: EliasFano, ptr: EliasFano, r: np.ndarray, of: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Successors of x in the ranges r[of]: positions, hits, places in the range."""
            lo, hi = (v.astype(np.int64) for v in ptr.pairs(r))
            found, hit = seq.successor(x.astype(_U) + self._base(seq, lo)[of], lo[of], hi[of])
            return found, hit, found - lo[of]

        own = at[inverse[live]]
        if self.short_bits:
            _, hit, place = within(p["short_words"], p["short_ptr"], self._short(k), own, word[live])
        else:  # one short context: one range from zero
            zero = np.zeros(len(live), np.int64)
            place, hit = p["short_words"].successor(word[live].astype(_U), zero, zero + p["short_words"].n)
        live, own, place = live[hit], own[hit], place[hit]
        found, hit, _ = within(p["places"], p["ptr"], k, own, place)
        out[live[hit]] = found[hit]
        return out
