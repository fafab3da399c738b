"""Words of many texts at once: positions and 64-bit hashes as numpy arrays.

Texts arrive as the bytes of an Arrow column. A word is a run of bytes that a 256-entry
table marks as word bytes; bytes of A-Z count as a-z.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Texts are taken together up to this many bytes (one longer text stands alone).
CHUNK_BYTES = 2 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLDED_VALUES = _VALUES[_FOLD]

# Bytes of words between white space: everything but space and \t \n \v \f \r.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
# Bytes of words of digits, letters and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 bits; a bijection."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[
        column.offset:column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.empty(0, np.uint8)
    first = int(offsets[0]) if len(offsets) else 0
    return data[first:int(offsets[-1])], offsets - first


def chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES
           ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, bytes, offsets) of columns (doc_id, text), cut between documents."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        data, offsets = buffers(batch.column("text"))
        at = 0
        while at < len(ids):
            end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            end = min(max(end, at + 1), len(ids))
            own = offsets[at:end + 1]
            yield ids[at:end], data[own[0]:own[-1]], own - own[0]
            at = end


def prefix_hashes(data: np.ndarray, values: np.ndarray = _VALUES) -> np.ndarray:
    """Sums from which ``span_hash`` takes the hash of any span."""
    sums = np.zeros(len(data) + 1, np.uint64)
    own = values[data]
    own *= powers(_BASE, len(data))
    np.cumsum(own, out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal for equal bytes, wherever they lie."""
    inverse = powers(_INVERSE, len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts]
               + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
    """(document number, start, end, hash) of every word, in order."""
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    inside = is_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    hashes = span_hash(prefix_hashes(data, _FOLDED_VALUES), starts, ends)
    doc = np.searchsorted(offsets, starts, "right") - 1
    return doc, starts, ends, hashes


_ODD = (np.random.default_rng(7).integers(1, 1 << 63, 64, dtype=np.uint64) << np.uint64(1)
        | np.uint64(1))


def shingles(doc: np.ndarray, hashes: np.ndarray, k: int, n_docs: int
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document number, first word, hash) of every run of ``k`` words; a document of fewer
    words, but not none, has its whole sequence as its one run."""
    n = len(hashes)
    counts = np.bincount(doc, minlength=n_docs)
    first = np.cumsum(counts) - counts
    if n >= k:
        at = np.flatnonzero(doc[:n - k + 1] == doc[k - 1:])
        value = np.full(len(at), k, np.uint64)
        for j in range(k):
            value += hashes[at + j] * _ODD[j]
    else:
        at, value = np.empty(0, np.int64), np.empty(0, np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        own = counts[short].astype(np.uint64)
        for j in range(k - 1):
            has = counts[short] > j
            own[has] += hashes[first[short[has]] + j] * _ODD[j]
        at, value = np.concatenate([at, first[short]]), np.concatenate([value, own])
    return doc[at], at, mix(value)
