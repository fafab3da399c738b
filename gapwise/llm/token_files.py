"""Token ids of a collection in binary files, ascending by document, and the way back.

One file per range of document ids. A file holds Simple-8b words in blocks, then an index
of documents and blocks, then the index's place:

    bytes 0-7 magic | words | index | place of index, sizes of its parts (7 x 8 bytes)

The files that count are those a written manifest names: a task that is lost or run twice
leaves files nobody reads.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from gapwise.llm import simple8b
from gapwise.llm.bpe import Vocabulary
from gapwise.llm.shared import filesystem, keep, scratch, texts
from gapwise.llm.units import LEAD_BYTES, PieceIds
from gapwise.llm.words import chunks

MAGIC = b"GWTOK8B1"
CHUNK_BYTES = 4 << 20
# Pieces that the library encodes as one text.
JOINED_PIECES = 2_000
# Blocks that are decoded at a time.
READ_BLOCKS = 256
_TAIL = 7

_MANIFEST = "path string, range int, n_docs long, n_ids long, n_bytes long"


@lru_cache(maxsize=2)
def library_coder(text: str) -> PieceIds:
    """An encoder by the tokenizers library, kept by a worker from task to task.

    Pieces that begin with white space are encoded many at a time as one text, which the
    pre-tokenizer cuts between them again; the bytes of the tokens tell the pieces apart.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(text)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    n_bytes = Vocabulary(text).sizes

    def joins(piece: bytes) -> bool:
        first, last = piece[0], piece[-1]
        return (first == 32 or 9 <= first <= 13) and (32 < last < 127 or (
            last > 127 and piece[-2] not in LEAD_BYTES and piece[-3] not in LEAD_BYTES))

    def encode(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.zeros(len(pieces), np.int64)
        joined = [i for i, p in enumerate(pieces) if len(p) > 3 and joins(p)]
        parts = []
        chosen = set(joined)
        for at in range(0, len(joined), JOINED_PIECES):
            own = joined[at:at + JOINED_PIECES]
            body = b"".join(pieces[i] for i in own).decode()
            ids = np.array(tokenizer.encode_batch_fast([body], add_special_tokens=False)[0].ids)
            edge = np.cumsum([len(pieces[i]) for i in own])
            split = np.searchsorted(np.cumsum(n_bytes[ids]), edge, "left") + 1
            sizes[own] = np.diff(split, prepend=0)
            parts.append((own, ids, split))
        alone = [i for i in range(len(pieces)) if i not in chosen]
        found = [tokenizer.encode(pieces[i].decode(), add_special_tokens=False).ids for i in alone]
        sizes[alone] = [len(f) for f in found]
        starts = np.cumsum(sizes) - sizes
        flat = np.empty(int(sizes.sum()), np.int64)
        for i, ids in zip(alone, found):
            flat[starts[i]:starts[i] + len(ids)] = ids
        for own, ids, split in parts:
            n = sizes[own]
            flat[np.repeat(starts[own] - (split - n), n) + np.arange(len(ids))] = ids
        return flat, sizes

    return PieceIds(encode)


class _Writer:
    """Packs ids as they come; only the index is held until the end."""

    def __init__(self, out):
        self.out, self.rest = out, np.empty(0, np.uint64)
        self.docs, self.sizes, self.per_block, self.escaped = [], [], [], []
        self.shift = 0
        out.write(MAGIC)

    def add(self, doc_ids, sizes, ids) -> None:
        self.docs.append(doc_ids)
        self.sizes.append(sizes)
        ids = np.concatenate([self.rest, ids.astype(np.uint64)])
        whole = len(ids) - len(ids) % simple8b.BLOCK
        self.pack(ids[:whole])
        self.rest = ids[whole:]

    def pack(self, ids) -> None:
        words, per_block, escaped = simple8b.encode(ids)
        escape = words >> np.uint64(60) == simple8b.ESCAPE
        words[escape] += np.uint64(self.shift)
        self.shift += len(escaped)
        self.per_block.append(per_block)
        self.escaped.append(escaped)
        self.out.write(words.astype("<u8").tobytes())

    def close(self) -> tuple[int, int]:
        self.pack(self.rest)
        empty = [np.empty(0, np.int64)]
        docs, sizes, per_block = (
            np.concatenate(empty + part) for part in (self.docs, self.sizes, self.per_block))
        escaped = np.concatenate([np.empty(0, np.uint64), *self.escaped])
        place = len(MAGIC) + 8 * int(per_block.sum())
        for part in (docs, sizes, per_block):
            self.out.write(part.astype("<i8").tobytes())
        self.out.write(escaped.astype("<u8").tobytes())
        tail = [place, len(docs), len(per_block), len(escaped), int(sizes.sum()),
                simple8b.BLOCK, 1]
        self.out.write(np.array(tail, "<i8").tobytes())
        return len(docs), int(sizes.sum())


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str | None = None,
                 end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, append ``end_id`` to each document and write the files below
    ``folder`` (default: a new one in the shared folder). Returns the manifest: path, range,
    n_docs, n_ids, n_bytes.

    A null text is empty and has the end id only. Documents ascend by id within a file and
    from file to file; rows that share an id stand next to each other. Rows without an id are
    left out, other columns are not read. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "tokens")
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        path = f"{folder}/ids-{uuid.uuid4().hex}.tok"
        for doc_ids, data, offsets in chunks(batches, CHUNK_BYTES):
            if writer is None:
                pieces = library_coder(shared.value)
                system, local = filesystem(path)
                system.create_dir(local.rpartition("/")[0], recursive=True)
                out = system.open_output_stream(local, compression=None)
                writer = _Writer(out)
            ids, ends = pieces.ids(data, offsets)
            ids = np.insert(ids, ends[1:], end_id)
            writer.add(doc_ids, np.diff(ends) + 1, ids)
        if writer is not None:
            n_docs, n_ids = writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({
                "path": [path], "range": pa.array([TaskContext.get().partitionId()], pa.int32()),
                "n_docs": [n_docs], "n_ids": [n_ids],
                "n_bytes": [system.get_file_info(local).size]})

    rows = texts(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return keep(rows.mapInArrow(run, _MANIFEST), "token-manifest")


def read_tokens(manifest: DataFrame, as_ids: bool = True) -> DataFrame:
    """Documents of the files of a manifest: doc_id, start (ids of all documents before it),
    n_tokens, ids_crc32 and, on request, ids array<long>.

    A file is one task, read and decoded some blocks at a time. The manifest has one row
    per file, so numbering the files through takes one small window.
    """
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    n = max(1, manifest.count())
    fields = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, path = filesystem(row["path"])
                with system.open_input_file(path) as f:
                    yield from _documents(f, row["base"], as_ids)

    return files.select("path", "base").repartition(n, "path").mapInArrow(
        run, fields + (", ids array<long>" if as_ids else ""))


def _documents(f, base: int, as_ids: bool) -> Iterator[pa.RecordBatch]:
    size = f.size()
    tail = np.frombuffer(f.read_at(8 * _TAIL, size - 8 * _TAIL), "<i8").tolist()
    place, n_docs, n_blocks, n_escaped, n_ids, block, version = tail
    if f.read_at(len(MAGIC), 0) != MAGIC or version != 1:
        raise ValueError("not a token file of this version")
    index = np.frombuffer(f.read_at(size - 8 * _TAIL - place, place), "<i8")
    docs, sizes, per_block = np.split(index[:2 * n_docs + n_blocks], [n_docs, 2 * n_docs])
    escaped = index[2 * n_docs + n_blocks:].view("<u8")
    starts = np.cumsum(sizes) - sizes
    word_at = np.cumsum(per_block) - per_block
    rest, rest_at, done = np.empty(0, np.uint32 if not as_ids else np.uint64), 0, 0
    for b in range(0, max(n_blocks, 1), READ_BLOCKS):
        own = per_block[b:b + READ_BLOCKS]
        if len(own):
            words = np.frombuffer(f.read_at(8 * int(own.sum()), len(MAGIC) + 8 * int(word_at[b])),
                                  "<u8")
            counts = np.full(len(own), block)
            counts[-1] = min(block, n_ids - (b + len(own) - 1) * block)
            more = simple8b.decode(words, own, counts, escaped)
            rest = np.concatenate([rest, more.astype(rest.dtype)])
        end = int(np.searchsorted(starts + sizes, rest_at + len(rest), "right"))
        if end == done:
            continue
        edge = np.append(starts[done:end], starts[end - 1] + sizes[end - 1]) - rest_at
        raw = rest[:edge[-1]]
        view = memoryview(raw.astype("<u4").tobytes())
        crc = [zlib.crc32(view[4 * a:4 * z]) for a, z in zip(edge[:-1].tolist(), edge[1:].tolist())]
        columns = {"doc_id": docs[done:end], "start": starts[done:end] + base,
                   "n_tokens": sizes[done:end], "ids_crc32": np.array(crc, np.int64)}
        if as_ids:
            columns["ids"] = pa.ListArray.from_arrays(
                pa.array(edge, pa.int32()), pa.array(raw.astype(np.int64)))
        yield pa.RecordBatch.from_pydict(columns)
        rest, rest_at, done = rest[edge[-1]:], rest_at + int(edge[-1]), end
