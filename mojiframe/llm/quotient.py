"""Counting quotient filters over permuted integers, without loss.

A key of ``bits`` bits goes through an invertible permutation of that domain.
The high bits of the result are its quotient, the number of its bucket; the
rest, kept in full, is its remainder.  Remainders stand in the order of their
quotients, each in the first free slot at or after its bucket; one bit a bucket
says whether it is occupied and one bit a slot whether a bucket's run ends there.
A count above one follows its remainder in slots marked by a third bit, as
digits in the base that a slot holds.  Quotient, remainder and count come back
exactly, in ascending order, so filters are merged by merging sorted lists.
"""

from __future__ import annotations

import struct

import numpy as np

_U = np.uint64
_HEAD = struct.Struct("<4q")
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


class Permutation:
    """A bijection of the integers below ``2**bits``: multiplications by odd numbers and shifts by half."""

    def __init__(self, bits: int):
        if not 1 <= bits <= 64:
            raise ValueError(f"keys of {bits} bits")
        self.bits, self.mask, self.shift = bits, _U((1 << bits) - 1), _U((bits + 1) // 2)
        self.back = [_U(pow(m, -1, 1 << 64)) for m in reversed(_MULTIPLIERS)]

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        x = keys.astype(_U)
        for m in _MULTIPLIERS:
            x = (x * _U(m)) & self.mask
            x ^= x >> self.shift
        return x

    def inverse(self, values: np.ndarray) -> np.ndarray:
        x = values.astype(_U)
        for m in self.back:
            x ^= x >> self.shift
            x = (x * m) & self.mask
        return x


def build(values: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
    """The filter of ascending distinct ``values`` below ``2**bits`` with counts of at least one."""
    n = len(values)
    q = min(bits, max(1, n).bit_length() - 1)
    r = bits - q
    width = max(1, -(-r // 8))
    rest = counts.astype(_U) - _U(1)
    digits = np.zeros(n, np.int64)
    left = rest.copy()
    while left.any():
        digits += left > 0
        left = left >> _U(8 * width) if width < 8 else np.zeros_like(left)
    quotient = (values >> _U(r)).astype(np.int64) if r < 64 else np.zeros(n, np.int64)
    remainder = values & _U((1 << r) - 1)
    size = digits + 1
    before = np.cumsum(size) - size
    at = before + np.maximum.accumulate(quotient - before) if n else before
    slots = int(at[-1] + size[-1]) if n else 0
    occupied, ends, marked = np.zeros(1 << q, bool), np.zeros(slots, bool), np.zeros(slots, bool)
    held = np.zeros(slots, _U)
    if n:
        occupied[quotient] = True
        last = np.append(quotient[1:] != quotient[:-1], True)
        ends[(at + digits)[last]] = True
        held[at] = remainder
        for k in range(int(digits.max())):
            own = digits > k
            held[at[own] + 1 + k] = (rest[own] >> _U(8 * width * k)) & _U((1 << (8 * width)) - 1)
            marked[at[own] + 1 + k] = True
    low = np.ascontiguousarray(held.view(np.uint8).reshape(-1, 8)[:, :width])
    return b"".join([_HEAD.pack(bits, q, n, slots), *[np.packbits(x).tobytes() for x in (occupied, ends, marked)], low.tobytes()])


def read(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ascending values and their counts."""
    bits, q, n, slots = _HEAD.unpack_from(data)
    r, pos, parts = bits - q, _HEAD.size, []
    for length in (1 << q, slots, slots):
        size = -(-length // 8)
        parts.append(np.unpackbits(np.frombuffer(data, np.uint8, size, pos), count=length).view(bool))
        pos += size
    if not n:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    occupied, ends, marked = parts
    width = max(1, -(-r // 8))
    held = np.zeros((slots, 8), np.uint8)
    held[:, :width] = np.frombuffer(data, np.uint8, slots * width, pos).reshape(slots, width)
    held = held.view(_U).ravel()
    bucket, end = np.flatnonzero(occupied), np.flatnonzero(ends)
    start = np.maximum(bucket, np.append(0, end[:-1] + 1))
    length = end - start + 1
    slot = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())
    item = ~marked[slot]
    high = np.repeat(bucket, length)[item].astype(_U)
    values = held[slot[item]] | (high << _U(r) if r < 64 else _U(0))
    counts = np.ones(n, _U)
    digit = np.flatnonzero(~item)
    if len(digit):
        own = np.cumsum(item)[digit] - 1
        k = digit - np.flatnonzero(item)[own] - 1
        np.add.at(counts, own, held[slot[digit]] << (k * 8 * width).astype(_U))
    return values, counts.astype(np.int64)


def merge(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One ascending list of the values of all, counts of equal ones added."""
    values = np.concatenate([v for v, _ in lists])
    counts = np.concatenate([c for _, c in lists])
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    return values[first], np.add.reduceat(counts, first) if len(first) else counts
