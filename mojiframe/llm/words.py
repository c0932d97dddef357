"""Vectorised word splitting over a UTF-8 buffer.

A word class is a set of ASCII separator bytes; every other byte (all of
non-ASCII UTF-8 too) belongs to a word.  A-Z are lower-cased, nothing else.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

_U = np.uint64


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for lo, hi in ranges:
        table[lo:hi + 1] = True
    return table


#: ``[^\x20\x09-\x0D]+``
SPACE_WORDS = separators((0x09, 0x0D), (0x20, 0x20))
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (after lower-casing)
ALNUM_WORDS = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

#: Spans beyond this many bytes are hashed one by one.
LONG_SPAN = 256
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], _U)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span: blocks of eight bytes, each mixed into the state by a step that
    is not linear, one block of all spans at a time."""
    size = (ends - starts).astype(np.int64)
    h = mix(size.astype(_U) * _U(0xD6E8FEB86659FD93) + _U(0x9E3779B97F4A7C15))
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))  # the eight bytes at every place
    live, at, left = np.arange(len(size)), starts.astype(np.int64), size
    some = (left > 0) & (left <= LONG_SPAN)
    while True:
        live, at, left = live[some], at[some], left[some]
        if not len(live):
            break
        block = eight[at] & _KEEP[np.minimum(left, 8)]
        h[live] = mix((h[live] ^ block) * _U(0x9FB21C651E98DF25) + (block >> _U(29)))
        at, left = at + 8, left - 8
        some = left > 0
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        digest = hashlib.blake2b(padded[starts[i]:ends[i]], digest_size=8).digest()
        h[i] = _U(int.from_bytes(digest, "little"))
    return h


@dataclass
class Words:
    data: np.ndarray      # lower-cased bytes
    starts: np.ndarray    # byte offsets of words
    ends: np.ndarray
    doc: np.ndarray       # row of each word
    first: np.ndarray     # n_docs + 1 word offsets by row

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i]:self.ends[i]].tobytes()


def split(raw: np.ndarray, offsets: np.ndarray, seps: np.ndarray) -> Words:
    data = LOWER[raw]
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~seps[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True  # a word never spans two rows
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut))
    ends = np.flatnonzero(before & (~inside | cut))
    doc = np.searchsorted(offsets, starts, "right") - 1
    first = np.searchsorted(starts, offsets, "left")
    return Words(data, starts, ends, doc, first)


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive word hashes (len(h) - n + 1 of them)."""
    out = np.zeros(max(0, len(h) - n + 1), _U)
    for i in range(n):
        out = mix(out * _U(0x9FB21C651E98DF25) + h[i:i + len(out)] + _U(i + 1))
    return out
