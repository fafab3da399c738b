"""Cut texts where a byte-level BPE's pre-tokenizer cuts for certain, and encode only
distinct pieces.

The public byte-level pattern never joins white space to the character before it, nor a
letter to a mark other than the apostrophe behind it. A text may be cut there, and each piece
has the same tokens alone as in its text. A collection has far fewer distinct pieces than
pieces; a task keeps the ids of those it has met, up to a bound.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Distinct pieces whose ids a worker keeps.
KEPT_PIECES = 600_000

_MARKS = np.zeros(256, bool)
_MARKS[list(b".,;:!?")] = True
# Bytes that may begin a white space beyond ASCII.
_LEADS = np.zeros(256, bool)
_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True
LEAD_BYTES = frozenset(np.flatnonzero(_LEADS).tolist())


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Offsets of the pieces of all texts; every text's own offsets are among them."""
    n = len(data)
    at = np.zeros(n + 1, bool)
    if n > 1:
        before = data[:-1]
        low = before | 32
        letter = (low >= 97) & (low <= 122)
        white = (data[1:] == 32) | (data[1:] >= 9) & (data[1:] <= 13)
        at[1:n] = white & (before > 32) | letter & _MARKS[data[1:]]
        wide = np.flatnonzero(at[1:n] & (before >= 128)) + 1
        bad = _LEADS[data[np.maximum(wide - 2, 0)]] | _LEADS[data[np.maximum(wide - 3, 0)]]
        at[wide[bad]] = False
    at[offsets] = True
    return np.flatnonzero(at)


def distinct_pieces(data: np.ndarray, offsets: np.ndarray
                    ) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct pieces, number of the distinct piece for every piece, first piece of every
    text and the end)."""
    at = cuts(data, offsets)
    column = pa.Array.from_buffers(
        pa.large_binary(), len(at) - 1,
        [None, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(data)])
    coded = pc.dictionary_encode(column)
    return coded.dictionary, coded.indices.to_numpy(), np.searchsorted(at, offsets)


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, take: np.ndarray
           ) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate ``flat[starts[i]:starts[i] + sizes[i]]`` for i in ``take``; also the
    offsets of the parts."""
    n = sizes[take]
    ends = np.zeros(len(take) + 1, np.int64)
    np.cumsum(n, out=ends[1:])
    index = np.repeat(starts[take] - ends[:-1], n)
    index += np.arange(ends[-1])
    return flat[index], ends


class PieceIds:
    """Ids of whole texts from ``encode``, which gets distinct pieces it has not met and
    returns their ids one after another and the number of each."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.pieces = pa.array([], pa.large_binary())
        self.flat, self.sizes = np.empty(0, np.int32), np.empty(0, np.int64)
        self.uses = np.empty(0, np.int64)

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of the texts in them)."""
        pieces, code, first = distinct_pieces(data, offsets)
        place = self._places(pieces)
        self.uses[place] += 1
        ids, ends = gather(self.flat, np.cumsum(self.sizes) - self.sizes, self.sizes, place[code])
        if len(self.pieces) > KEPT_PIECES:
            self._forget()
        return ids, ends[first]

    def _forget(self) -> None:
        """Keep the pieces of several calls, at most half of the bound, the most used ones."""
        kept = np.flatnonzero(self.uses > 1)
        if len(kept) > KEPT_PIECES // 2:
            kept = np.sort(kept[np.argsort(-self.uses[kept], kind="stable")[:KEPT_PIECES // 2]])
        self.flat, _ = gather(self.flat, np.cumsum(self.sizes) - self.sizes, self.sizes, kept)
        self.pieces, self.sizes = self.pieces.take(pa.array(kept)), self.sizes[kept]
        # Uses of long ago count less.
        self.uses = self.uses[kept] // 2 + 1

    def _places(self, pieces: pa.Array) -> np.ndarray:
        # The table of hashes is that of the chunk's pieces, as those kept are many more.
        found = pc.fill_null(pc.index_in(self.pieces, value_set=pieces), -1).to_numpy(
            zero_copy_only=False)
        known = np.flatnonzero(found >= 0)
        place = np.full(len(pieces), -1)
        place[found[known]] = known
        fresh = pieces.filter(pa.array(place < 0))
        if len(fresh):
            flat, sizes = self.encode(fresh.to_pylist())
            place[place < 0] = len(self.pieces) + np.arange(len(fresh))
            self.pieces = pa.concat_arrays([self.pieces, fresh])
            self.flat = np.concatenate([self.flat, flat.astype(np.int32)])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.uses = np.concatenate([self.uses, np.zeros(len(fresh), np.int64)])
        return place
