"""Simple-8b: token ids in 64-bit words of 4 selector bits and 60 bits of payload.

Words are made in blocks of a fixed number of ids, all blocks side by side: one step packs
the next word of every block. A value beyond 60 bits is an escape, whose payload numbers a
list of full values.
"""

from __future__ import annotations

import numpy as np

BLOCK = 4096
# Fixed values of the coding: ids per word and bits per id, by selector.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([60, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = 0

_NEAR = 12


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, words per block, escaped values) of unsigned 64-bit ``values``."""
    values = values.astype(np.uint64)
    n = len(values)
    blocks = -(-n // BLOCK)
    far = int(COUNTS.max())
    padded = np.zeros(blocks * BLOCK + far, np.uint64)
    padded[:n] = values
    ends = np.minimum((np.arange(blocks) + 1) * BLOCK, n)
    at = np.arange(blocks) * BLOCK
    live = np.arange(blocks)
    made, of = [], []
    escaped: list[np.ndarray] = []
    n_escaped = 0
    while len(live):
        here, end = at[live], ends[live]
        selector = np.zeros(len(live), np.int64)
        packed = np.zeros(len(live), np.uint64)
        near = _windows(padded, here, end, _NEAR)
        highest = np.maximum.accumulate(near, axis=1)
        wide = highest[:, -1] < (1 << int(BITS[COUNTS == 15][0]))
        done = np.zeros(len(live), bool)
        for rows, reach in ((np.flatnonzero(wide), far), (np.arange(len(live)), _NEAR)):
            rows = rows[~done[rows]]
            if not len(rows):
                continue
            window = near[rows] if reach == _NEAR else _windows(padded, here[rows], end[rows], far)
            top = highest[rows] if reach == _NEAR else np.maximum.accumulate(window, axis=1)
            open_ = np.ones(len(rows), bool)
            for s in range(1, 16):
                count, bits = int(COUNTS[s]), int(BITS[s])
                if count > reach:
                    continue
                fits = open_ & (top[:, count - 1] < np.uint64(1 << bits))
                pick = np.flatnonzero(fits)
                if not len(pick):
                    continue
                open_[pick] = False
                selector[rows[pick]] = s
                done[rows[pick]] = True
                if bits:
                    shifts = (np.arange(count) * bits).astype(np.uint64)
                    packed[rows[pick]] = np.bitwise_or.reduce(
                        window[pick, :count] << shifts, axis=1)
        out = np.flatnonzero(~done)
        if len(out):
            packed[out] = n_escaped + np.arange(len(out), dtype=np.uint64)
            escaped.append(padded[here[out]])
            n_escaped += len(out)
        made.append(packed | selector.astype(np.uint64) << np.uint64(60))
        of.append(live)
        at[live] = here + COUNTS[selector]
        live = live[at[live] < ends[live]]
    if not made:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint64)
    words, of = np.concatenate(made), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return (words[order], np.bincount(of, minlength=blocks),
            np.concatenate(escaped) if escaped else np.empty(0, np.uint64))


def _windows(padded, here, end, reach):
    """The next ``reach`` values of each block; 0 beyond its end."""
    index = here[:, None] + np.arange(reach)
    window = padded[index]
    window[index >= end[:, None]] = 0
    return window


def decode(words: np.ndarray, per_block: np.ndarray, sizes: np.ndarray, escaped: np.ndarray
           ) -> np.ndarray:
    """All values of whole blocks; ``sizes`` is the number of values in each block."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selector].copy()
    # the last word of a block may have room left
    last = np.cumsum(per_block) - 1
    total = np.add.reduceat(counts, last - per_block + 1) if len(last) else counts
    counts[last] -= total - sizes
    start = np.cumsum(counts) - counts
    place = np.arange(int(counts.sum())) - np.repeat(start, counts)
    bits = BITS[selector]
    payload = words & np.uint64((1 << 60) - 1)
    shift = (np.repeat(bits, counts) * place).astype(np.uint64)
    mask = np.where(bits == 60, np.uint64((1 << 60) - 1),
                    (np.uint64(1) << bits.astype(np.uint64)) - np.uint64(1))
    values = np.repeat(payload, counts) >> shift & np.repeat(mask, counts)
    out = np.flatnonzero(selector == ESCAPE)
    if len(out):
        values[start[out]] = escaped[payload[out].astype(np.int64)]
    return values
