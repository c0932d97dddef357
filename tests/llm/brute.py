"""Plain versions of the operators, on lists in memory."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def crc_mod(value, n):
    return None if value is None else zlib.crc32(str(value).encode()) % n


def space_words(text):
    return SPACE_WORDS.findall((text or "").translate(LOWER))


def alnum_words(text):
    return ALNUM_WORDS.findall((text or "").translate(LOWER))


def decontaminate(docs, items, window=10):
    """[(id, n_words, n_hit, n_items, sha, contaminated)]"""
    where = defaultdict(set)
    for item, text in items:
        w = alnum_words(text)
        m = min(window, len(w))
        if m and item is not None:
            for k in range(len(w) - m + 1):
                where[tuple(w[k:k + m])].add(str(item))
    sizes, out = sorted({len(k) for k in where}), []
    for i, text in docs:
        w, hit, found = alnum_words(text), set(), set()
        for m in sizes:
            for k in range(len(w) - m + 1):
                if own := where.get(tuple(w[k:k + m])):
                    found |= own
                    hit.update(range(k, k + m))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def jaccard(docs, n=3, num=90, den=100):
    """[(id, size, component, links)]; rows without an id take no part."""
    sets = []
    for _, text in docs:
        w = space_words(text)
        sets.append({tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    lists = defaultdict(list)
    for k, s in enumerate(sets):
        if docs[k][0] is not None:
            for g in s:
                lists[g].append(k)
    up, links = list(range(len(docs))), Counter()

    def top(a):
        while up[a] != a:
            a = up[a]
        return a

    for k, s in enumerate(sets):
        if docs[k][0] is None:
            continue
        for j, c in Counter(j for g in s for j in lists[g] if j > k).items():
            if den * c >= num * (len(s) + len(sets[j]) - c):
                links[k] += 1
                links[j] += 1
                up[top(j)] = top(k)
    low = {}
    for k in range(len(docs)):
        if docs[k][0] is not None:
            low[top(k)] = min(low.get(top(k), docs[k][0]), docs[k][0])
    return [(i, len(sets[k]), None if i is None else low[top(k)], links[k]) for k, (i, _) in enumerate(docs)]


class Lm:
    """The model of ngramlm, from plain counters."""

    def __init__(self, docs, train, order, mu, power, min_context, step):
        self.texts = [space_words(t) + ["\n"] for _, t in docs]
        self.c = [Counter() for _ in range(order + 1)]
        for w, learn in zip(self.texts, train):
            if learn:
                w = [" ", *w]
                for k in range(1, order + 1):
                    self.c[k].update(tuple(w[p:p + k]) for p in range(k == 1, len(w) - k + 1))
        self.n, self.v = sum(self.c[1].values()), len(self.c[1])
        self.context = Counter(self.c[1])
        self.context[(" ",)] = sum(map(bool, train))
        self.order, self.mu, self.power, self.min_context, self.step = order, mu, power, min_context, step

    def code(self, x, w):
        q = lambda p: min(round(-math.log10(p) / self.step), 65534)
        if not x:
            return q((self.c[1][(w,)] + 1) / (self.n + self.v + 1))
        lower = self.code(x[1:], w)
        total = self.context[x] if len(x) == 1 else self.c[len(x)][x]
        if total < self.min_context:
            return lower
        m = self.mu * total ** self.power
        return q((self.c[len(x) + 1][(*x, w)] + m * 10 ** (-lower * self.step)) / (total + m))

    def rows(self):
        for w in self.texts:
            x = [" ", *w]
            yield (len(w), sum(self.c[1][(t,)] > 0 for t in w), self.n,
                   sum(math.log10((self.c[1][(t,)] + 1) / (self.n + self.v + 1)) for t in w),
                   sum(-self.step * self.code(tuple(x[max(0, p - self.order + 1):p]), x[p]) for p in range(1, len(x))))


def line_chunks(text, min_words=10, paragraph_words=24):
    """(start, end, end without white space), in bytes, of the line chunks that count, a word at a time."""
    import numpy as np

    from mojiframe.llm.words import mix, span_hashes

    raw = text.encode()
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    words = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    n = len(words)
    if not n:
        return []

    def hashed(a, b):
        return int(span_hashes(np.frombuffer(low[a:b], np.uint8), np.array([0]), np.array([b - a]))[0])

    h = [hashed(a, b) for a, b in words]
    line = [k == 0 or b"\n" in raw[words[k - 1][1]:words[k][0]] for k in range(n)]
    sentence = [line[k] or raw[words[k - 1][1] - 1:words[k - 1][1]] in (b".", b"!", b"?") for k in range(n)]
    opens = [k for k in range(n) if sentence[k] or (0 < k < n - 1 and not sentence[k + 1] and h[k] < h[k - 1] and h[k] < h[k + 1])]
    own = [hashed(words[k][0], words[(*opens[1:], n)[j] - 1][1]) for j, k in enumerate(opens)]
    paragraphs = [k for k in range(n) if line[k]] + [n]
    fixed = {0, n}
    for a, b in zip(paragraphs, paragraphs[1:]):
        if b - a >= paragraph_words:
            fixed |= {a, b}
    rank = {}
    for j, k in enumerate(opens):
        rolled = (own[j] * 0x9E3779B97F4A7C15 + (0 if (*opens[1:], n)[j] in fixed else own[j + 1])) % 2**64
        kind = 0 if line[k] else 1 if sentence[k] else 2
        rank[k] = (kind, int(mix(np.array([rolled], np.uint64))[0]) >> 2)
    none = (3, 0)
    for k in fixed:
        rank[k] = (-1, 0)
    starts = set(fixed)
    for k in opens:
        near = [j for j in range(k - min_words + 1, k + min_words) if j != k]
        if all(0 <= j < n and rank[k] < rank.get(j, none) for j in near):
            starts.add(k)
    for a, b in list(zip(sorted(starts), sorted(starts)[1:])):
        while b - a >= 2 * min_words:
            a = min(range(a + min_words, a + 2 * min_words), key=lambda j: rank.get(j, none))
            if a > b - min_words:
                break
            starts.add(a)
    out, ordered = [], sorted(starts)
    for a, b in zip(ordered, ordered[1:]):
        if b - a < min_words:
            continue
        begin, last = words[a][0] if a else 0, words[b - 1][1]
        end = words[b][0] if b < n else len(raw)
        out.append((begin, last if (b == n or line[b]) and not line[a] else end, last))
    return out
