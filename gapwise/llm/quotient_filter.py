"""Counting quotient filters: exact counters of large sets of numbers in little space.

A key is permuted by a bijection, so that keys spread evenly whatever they are. The leading
bits of the result (the quotient) name one of about as many slots as there are keys; the rest
(the remainder) is stored in full, so that nothing is lost. Entries lie in the order of their
permuted keys: one bit per slot tells whether it has any, one bit per entry whether it ends its
slot, and merging filters is merging sorted lists.

A key may have a second part of 32 bits beyond its 64; it enters the permutation of the
first and is stored beside the remainder.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

from gapwise.llm.words import mix

_ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_HEAD = struct.Struct("<QBBBB")


class Permutation:
    """A bijection of the numbers below ``2 ** bits``."""

    def __init__(self, bits: int):
        self.bits = bits
        self.shift = np.uint64((bits + 1) // 2)
        self.mask = np.uint64((1 << bits) - 1)
        self.factors = [np.uint64(f & ((1 << bits) - 1) | 1) for f in _ODD]
        self.inverses = [np.uint64(pow(int(f), -1, 1 << bits)) for f in self.factors]

    def apply(self, keys: np.ndarray, high: np.ndarray | None = None) -> np.ndarray:
        x = keys if high is None else keys ^ mix(high.astype(np.uint64)) & self.mask
        for f in self.factors:
            x = (x ^ (x >> self.shift)) * f & self.mask
        return x ^ (x >> self.shift)

    def undo(self, x: np.ndarray, high: np.ndarray | None = None) -> np.ndarray:
        x = x ^ (x >> self.shift)
        for f in reversed(self.inverses):
            x = x * f & self.mask
            x ^= x >> self.shift
        return x if high is None else x ^ mix(high.astype(np.uint64)) & self.mask


def counted(keys: np.ndarray, high: np.ndarray | None, counts: np.ndarray | None = None):
    """Sorted distinct keys with the sums of their counts (1 each by default)."""
    if high is None and counts is None:
        keys = np.sort(keys)
    else:
        order = (np.argsort(keys, kind="stable") if high is None else np.lexsort((high, keys)))
        keys = keys[order]
        high = None if high is None else high[order]
        counts = None if counts is None else counts[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    if high is not None:
        new[1:] |= high[1:] != high[:-1]
    first = np.flatnonzero(new)
    if counts is None:
        sums = np.diff(first, append=len(keys))
    else:
        sums = np.add.reduceat(counts, first) if len(first) else counts[:0]
    return keys[first], None if high is None else high[first], sums.astype(np.int64)


def encode(keys: np.ndarray, high: np.ndarray | None, counts: np.ndarray, bits: int) -> bytes:
    """A filter of sorted distinct permuted keys of ``bits`` bits and their counts."""
    n = len(keys)
    q = min(max(int(n).bit_length(), 1), bits)
    r = bits - q
    quotient = (keys >> np.uint64(r)).astype(np.int64) if r < 64 else np.zeros(n, np.int64)
    used = np.zeros(1 << q, bool)
    used[quotient] = True
    ends = np.ones(n, bool)
    ends[:-1] = quotient[1:] != quotient[:-1]
    width = (r + 7) // 8
    rest = (keys & np.uint64((1 << r) - 1)).astype("<u8").view(np.uint8).reshape(n, 8)[:, :width]
    small = np.minimum(counts, 255).astype(np.uint8)
    parts = [_HEAD.pack(n, bits, q, width, high is not None), np.packbits(used).tobytes(),
             np.packbits(ends).tobytes(), np.ascontiguousarray(rest.T).tobytes(), small.tobytes(),
             counts[small == 255].astype("<i8").tobytes()]
    if high is not None:
        parts.append(high.astype("<u4").tobytes())
    return b"".join(parts)


def decode(blob: bytes) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """(permuted keys in order, second parts or None, counts)."""
    n, bits, q, width, has_high = _HEAD.unpack_from(blob)
    at = _HEAD.size

    def take(size, dtype=np.uint8):
        nonlocal at
        found = np.frombuffer(blob, dtype, size, at)
        at += found.nbytes
        return found

    used = np.flatnonzero(np.unpackbits(take((1 << q) + 7 >> 3), count=1 << q))
    ends = np.unpackbits(take(n + 7 >> 3), count=n)
    run = np.cumsum(ends) - ends
    rest = np.zeros((n, 8), np.uint8)
    rest[:, :width] = take(n * width).reshape(width, n).T
    keys = rest.view("<u8").ravel().astype(np.uint64)
    if bits - q < 64 and n:
        keys |= used[run].astype(np.uint64) << np.uint64(bits - q)
    counts = take(n).astype(np.int64)
    large = np.flatnonzero(counts == 255)
    counts[large] = take(len(large), np.dtype("<i8"))
    high = take(n, np.dtype("<u4")).astype(np.uint32) if has_high else None
    return keys, high, counts


def merged(parts: list[tuple[np.ndarray, np.ndarray | None, np.ndarray]]):
    """Decoded filters of the same kind as one."""
    keys, high, counts = zip(*parts)
    return counted(np.concatenate(keys), None if high[0] is None else np.concatenate(high),
                   np.concatenate(counts))


def merged_slices(parts: list[tuple[np.ndarray, np.ndarray | None, np.ndarray]], entries: int
                  ) -> Iterator[tuple[np.ndarray, np.ndarray | None, np.ndarray]]:
    """``merged`` in slices of ascending keys made of about ``entries`` entries each, so that
    only one slice is sorted at a time."""
    sizes = np.array([len(p[0]) for p in parts])
    n_slices = -(-int(sizes.sum()) // entries)
    if n_slices < 2:
        yield merged(parts)
        return
    # Bounds from evenly spaced entries of every filter; equal keys lie on one side of a bound.
    spaced = np.sort(np.concatenate([p[0][::max(1, entries // 64)] for p in parts]))
    bounds = np.unique(spaced[len(spaced) * np.arange(1, n_slices) // n_slices])
    edges = [np.concatenate([[0], np.searchsorted(p[0], bounds), [len(p[0])]]) for p in parts]
    for i in range(len(bounds) + 1):
        own = [(keys[e[i]:e[i + 1]], None if high is None else high[e[i]:e[i + 1]],
                counts[e[i]:e[i + 1]]) for (keys, high, counts), e in zip(parts, edges)]
        if any(len(k) for k, _, _ in own):
            yield merged(own)
