"""Byte-level BPE over the distinct words of a partition, by an index of pair occurrences.

All distinct pre-tokens of a chunk lie in one array of symbols with links to the next and
the previous one. A pair of symbols maps to all its positions. The lowest rank with
positions left is applied to all of them at once, and the pairs this makes are added to
the lists of their ranks. A merge only makes pairs of higher rank, since the rank that
makes a symbol precedes all ranks that use it.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from gapwise.llm.shared import frugal, give_back, texts
from gapwise.llm.units import PieceIds, gather
from gapwise.llm.words import chunks

# Fixed value: the public byte-level pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

CHUNK_BYTES = 1 << 20
_SHIFT = 20


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself
    where it is printable, else the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, extra = [], 256
    for b in range(256):
        letters.append(chr(b if b in plain else extra))
        extra += b not in plain
    return letters


class Vocabulary:
    """Symbols, merges and special tokens of a tokenizer file (its JSON text)."""

    def __init__(self, text: str):
        spec = json.loads(text)
        ids, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.of_byte = np.array([ids[c] for c in letters], np.int32)
        left = np.array([ids[a] for a, _ in merges], np.int64)
        right = np.array([ids[b] for _, b in merges], np.int64)
        self.left, self.right = left.tolist(), right.tolist()
        self.made = [ids[a + b] for a, b in merges]
        born = {i: -1 for i in self.of_byte.tolist()}
        for rank, (a, b, new) in enumerate(zip(self.left, self.right, self.made)):
            if max(born.get(a, rank), born.get(b, rank)) >= rank:
                raise ValueError(f"merge {rank} uses a symbol that no earlier merge makes")
            born.setdefault(new, rank)
        keys = left << _SHIFT | right
        self.order = np.argsort(keys).astype(np.int64)
        self.keys = keys[self.order]
        byte = {c: bytes([b]) for b, c in enumerate(letters)}
        size = max([*ids.values(), *self.special.values()]) + 1
        plain = [b""] * size
        for token, i in ids.items():
            plain[i] = b"".join(byte[c] for c in token)
        for token, i in self.special.items():
            plain[i] = token.encode()
        self.bytes = np.frombuffer(b"".join(plain), np.uint8)
        self.sizes = np.array([len(p) for p in plain], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.pattern = regex.compile(PATTERN)
        self.split = regex.compile(
            "(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")"
        ) if self.special else None

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 for pairs that never merge."""
        key = a.astype(np.int64) << _SHIFT | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], -1)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and the number of ids of each."""
        sizes = np.array([len(w) for w in words], np.int64)
        sym = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        n = len(sym)
        if n == 0:
            return sym, sizes
        place = np.arange(n, dtype=np.int32)
        joined = np.append(word[1:] == word[:-1], False)
        nxt = np.where(joined, place + 1, np.int32(-1))
        prv = np.where(np.insert(joined[:-1], 0, False), place - 1, np.int32(-1))
        at = place[joined]
        del place

        lists: dict[int, list[np.ndarray]] = {}

        def enlist(at: np.ndarray, ranks: np.ndarray) -> None:
            good = ranks >= 0
            at, ranks = at[good], ranks[good]
            if not len(at):
                return
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            edge = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(at)]
            for i, j in zip(edge[:-1], edge[1:]):
                rank = int(ranks[i])
                if rank in lists:
                    lists[rank].append(at[i:j])
                else:
                    lists[rank] = [at[i:j]]
                    heapq.heappush(heap, rank)

        heap: list[int] = []
        enlist(at, self.ranks(sym[at], sym[at + 1]))
        while heap:
            rank = heapq.heappop(heap)
            found = lists.pop(rank)
            a, b, new = self.left[rank], self.right[rank], self.made[rank]
            p = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
            q = nxt[p]
            good = (sym[p] == a) & (q >= 0) & (sym[q] == b)
            p, q = p[good], q[good]
            if a == b and len(p) > 1:
                # of overlapping occurrences every second one, from the left
                step = np.arange(len(p))
                begins = np.insert(p[1:] != q[:-1], 0, True)
                pick = (step - np.maximum.accumulate(np.where(begins, step, 0))) % 2 == 0
                p, q = p[pick], q[pick]
            if not len(p):
                continue
            after, before = nxt[q], prv[p]
            sym[p], sym[q] = new, -1
            nxt[p] = after
            has = after >= 0
            prv[after[has]] = p[has]
            left = before[before >= 0]
            right = p[has]
            at = np.concatenate([left, right])
            if len(at):
                enlist(at, self.ranks(sym[at], sym[nxt[at]]))
        alive = sym >= 0
        return sym[alive], np.bincount(word[alive], minlength=len(words))

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces of text one after another, and the number of ids of each."""
        whole = b"\xff".join(pieces)
        if any(s.encode() in whole for s in self.special):
            return self._with_special(pieces)
        words: list[str] = []
        counts = np.empty(len(pieces), np.int64)
        find = self.pattern.findall
        for i, piece in enumerate(pieces):
            own = find(piece.decode())
            counts[i] = len(own)
            words += own
        ids, sizes = self.encode_words([w.encode() for w in words])
        edge = np.zeros(len(pieces) + 1, np.int64)
        np.cumsum(counts, out=edge[1:])
        ends = np.append(0, np.cumsum(sizes))
        return ids, np.diff(ends[edge])

    def _with_special(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Cut special tokens out first; what stands between them is ordinary text."""
        parts: list[bytes] = []
        tokens, counts = [], []
        for piece in pieces:
            own = self.split.split(piece.decode())
            counts.append(len(own))
            tokens += [self.special.get(x, -1) for x in own]
            parts += [b"" if x in self.special else x.encode() for x in own]
        token = np.array(tokens)
        plain = token < 0
        ids, sizes = self.encode_pieces([p for p, ok in zip(parts, plain) if ok])
        every = np.ones(len(parts), np.int64)
        every[plain] = sizes
        flat = np.empty(int(every.sum()), ids.dtype)
        low = np.repeat(plain, every)
        flat[low], flat[~low] = ids, token[~plain]
        edge = np.cumsum([0, *counts])
        return flat, np.diff(np.append(0, np.cumsum(every))[edge])

    def decode(self, ids: np.ndarray) -> str:
        return gather(self.bytes, self.starts, self.sizes, ids)[0].tobytes().decode(
            "utf-8", "replace")


@lru_cache(maxsize=2)
def coder(text: str) -> tuple[Vocabulary, PieceIds]:
    """The vocabulary of a tokenizer file and its encoder, kept by a worker from task to
    task of a stage."""
    vocabulary = Vocabulary(text)
    return vocabulary, PieceIds(vocabulary.encode_pieces)


def encoded(text: str, batches: Iterator[pa.RecordBatch]
            ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document ids, token ids, offsets of the documents in them), chunk by chunk."""
    _, pieces = coder(text)
    for doc_ids, data, offsets in chunks(batches, CHUNK_BYTES):
        yield doc_ids, *pieces.ids(data, offsets)
        give_back()


def bpe_round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Token ids of every text and the text decoded from them.

    A null or empty text has no ids. Repeated rows are encoded each. Rows without an id are
    left out, other columns are not read; an empty table gives an empty result. The file is
    read once on the driver (a vocabulary has a fixed size) and sent to the tasks.
    Columns: doc_id, ids array<int>, decoded.
    """
    shared = _shared_vocabulary(docs, tokenizer_path)

    def run(batches):
        vocabulary, _ = coder(shared.value)
        for doc_ids, ids, ends in encoded(shared.value, batches):
            decoded = [vocabulary.decode(ids[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids), column, pa.array(decoded, pa.string())],
                ["doc_id", "ids", "decoded"])

    return texts(docs, id_col, text_col).mapInArrow(
        frugal(run, keeps=coder), "doc_id long, ids array<int>, decoded string")


def _shared_vocabulary(docs: DataFrame, path: str):
    with open(path, encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def bpe_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """As ``bpe_round_trip``, with digests instead of ids and texts, taken in the same pass:
    doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256."""
    shared = _shared_vocabulary(docs, tokenizer_path)

    def run(batches):
        vocabulary, _ = coder(shared.value)
        numeral = [b"%d" % i for i in range(len(vocabulary.sizes))]
        for doc_ids, ids, ends in encoded(shared.value, batches):
            sha, decoded = [], []
            for a, b in zip(ends[:-1], ends[1:]):
                own = ids[a:b]
                sha.append(hashlib.sha256(
                    b",".join(map(numeral.__getitem__, own.tolist()))).hexdigest())
                decoded.append(hashlib.sha256(vocabulary.decode(own).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids), pa.array(np.diff(ends)), pa.array(sha, pa.string()),
                 pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs, id_col, text_col).mapInArrow(
        frugal(run, keeps=coder),
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
