"""Byte strings of a fixed length that occur more than once in a collection.

Every window of that length has an anchor: its k-byte piece of smallest hash. Equal windows
have equal anchors at equal places, so only slices of text around equal anchors need to be
compared, lined up at the anchor. The slices of a task form a collection that is built up
column by column, from the right: each round puts one more symbol before every slice. A
stable sort by that symbol turns the order of the suffixes of the last column into that of
the new one (the step by which a Burrows-Wheeler transform of a collection grows), and the
column where neighbours part is carried along as the least over those between them. A
window that starts in a column is repeated if it agrees with a neighbour to its end.

Slices that are equal as a whole are counted before anything is compared and stand in the
collection once. An anchor with very many different slices is not gathered: its windows are
grouped one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gapwise.llm.fm_index import merge_spans
from gapwise.llm.shared import keep, texts
from gapwise.llm.words import chunks, powers, prefix_hashes, span_hash, _INVERSE, mix
from gapwise.plans.sizing import broadcast_if_small

LENGTH = 400
# Bytes of an anchor.
SEED = 32
# Bytes of text whose anchors are sought together.
CHUNK_BYTES = 1 << 20
# Slices that are built up together, and different slices of one anchor up to which they are.
ROUND_SLICES = 4_000
HOT_SLICES = 4_000
# Texts a task holds as strings.
TEXTS_AT_ONCE = 200

_ANCHORS = "doc_id long, at long, n_starts int, lead int, seed long, slice long"
_FOUND = "doc_id long, at long, starts array<struct<a:int,b:int>>"
_KEY = ["seed", "slice", "n_starts", "lead"]


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, seed: int = SEED):
    """(document number, first window start, number of starts, bytes before the anchor, hash
    of the anchor, hash of the slice): every window start of every document once."""
    n = len(data)
    none = np.empty(0, np.int64)
    if n < length:
        return none, none, none, none, none, none
    sums = prefix_hashes(data)
    inverse = powers(_INVERSE, n + 1)
    pieces = n - seed + 1
    h = mix((sums[seed:] - sums[:-seed]) * inverse[:pieces])
    key = h >> np.uint64(32) << np.uint64(32) | np.arange(pieces, dtype=np.uint64)
    width = length - seed + 1
    # least of every `width` in a row: from the left and from the right within blocks
    blocks = -(-pieces // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:pieces] = key
    grid = padded.reshape(blocks, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - length + 1
    least = np.minimum(right[:count], left[width - 1:width - 1 + count])
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    sizes = np.diff(offsets)
    per_doc = np.maximum(sizes - length + 1, 0)
    valid = np.zeros(n + 1, np.int64)
    np.add.at(valid, offsets[:-1], (per_doc > 0).astype(np.int64))
    np.add.at(valid, offsets[:-1] + per_doc, -(per_doc > 0).astype(np.int64))
    start = np.flatnonzero(np.cumsum(valid)[:count] > 0)
    if not len(start):
        return none, none, none, none, none, none
    doc = np.searchsorted(offsets, start, "right") - 1
    own = anchor[start]
    new = np.ones(len(start), bool)
    new[1:] = (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    n_starts = np.diff(np.append(first, len(start)))
    p, a = start[first], own[first]
    return (doc[first], p, n_starts, a - p, h[a].view(np.int64),
            span_hash(sums, p, p + n_starts - 1 + length).view(np.int64))


def _anchor_rows(batches: Iterator[pa.RecordBatch], length: int, seed: int
                 ) -> Iterator[pa.RecordBatch]:
    for ids, data, offsets in chunks(batches, CHUNK_BYTES):
        doc, p, n_starts, lead, h, s = anchors(data, offsets, length, seed)
        if len(doc):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[doc]), pa.array(p - offsets[doc]), pa.array(n_starts, pa.int32()),
                 pa.array(lead, pa.int32()), pa.array(h), pa.array(s)],
                ["doc_id", "at", "n_starts", "lead", "seed", "slice"])


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Texts with the slices asked of them in, slices out."""
    for batch in batches:
        for i in range(batch.num_rows):
            body = batch.column("text")[i].as_py().encode()
            wanted = batch.column("wanted")[i].as_py()
            if not wanted:
                continue
            yield pa.RecordBatch.from_pydict({
                "seed": [w["seed"] for w in wanted],
                "doc_id": pa.array([batch.column("doc_id")[i].as_py()] * len(wanted), pa.int64()),
                "at": [w["at"] for w in wanted],
                "n_starts": pa.array([w["n_starts"] for w in wanted], pa.int32()),
                "lead": pa.array([w["lead"] for w in wanted], pa.int32()),
                "hot": [w["hot"] for w in wanted],
                "body": [body[w["at"]:w["at"] + w["n_starts"] - 1 + length] for w in wanted]})


def repeated_starts(bodies: list[bytes], group: np.ndarray, lead: np.ndarray,
                    n_starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(slice, window start in it) of all windows that another slice of the same group has at
    the same distance from the anchor. ``group`` ascends."""
    m = len(bodies)
    sizes = np.array([len(b) for b in bodies])
    first, last = -lead, -lead + sizes
    low, high = int(first.min()), int(last.max())
    # one row per column: the symbol of every slice there, from 256 on where it has none
    columns = np.full((high - low, m), 256, np.int16)
    for i, (at, body) in enumerate(zip((first - low).tolist(), bodies)):
        columns[at:at + len(body), i] = np.frombuffer(body, np.uint8)
    order = np.arange(m)
    parts = np.full(m, high)  # column where a slice and the one before it part
    parts_at = np.zeros(m + 1, np.int64)
    out_slice, out_start = [], []
    for c in range(high - 1, low - 1, -1):
        symbol = columns[c - low][order].astype(np.int64)
        key = group[order] * 512 + symbol
        move = np.argsort(key, kind="stable")
        key = key[move]
        alike = np.zeros(m, bool)
        alike[1:] = (key[1:] == key[:-1]) & (symbol[move[1:]] < 256)
        new = np.full(m, c)
        at = np.flatnonzero(alike)
        if len(at):
            parts_at[:m] = parts
            pairs = np.empty(2 * len(at), np.int64)
            pairs[::2], pairs[1::2] = move[at - 1] + 1, move[at] + 1
            new[at] = np.minimum.reduceat(parts_at, pairs)[::2]
        order, parts = order[move], new
        if len(at):
            far = parts - c >= length
            if far.any():
                hit = far.copy()
                hit[:-1] |= far[1:]
                own = order[hit]
                begin = c - first[own]
                good = (begin >= 0) & (begin < n_starts[own])
                out_slice.append(own[good])
                out_start.append(begin[good])
    if not out_slice:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(out_slice), np.concatenate(out_start)


def _ranges(which: np.ndarray, start: np.ndarray) -> Iterator[tuple[int, list[dict]]]:
    """Runs of successive starts, by slice; nothing if there are no starts."""
    if not len(which):
        return
    order = np.lexsort((start, which))
    which, start = which[order], start[order]
    new = np.ones(len(which), bool)
    new[1:] = (which[1:] != which[:-1]) | (start[1:] != start[:-1] + 1)
    end = np.append(np.flatnonzero(new)[1:], len(which)) - 1
    own, a, b = which[new], start[new], start[end]
    edge = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    for i, j in zip(edge, np.append(edge, len(own))[1:]):
        yield int(own[i]), [{"a": int(x), "b": int(y)} for x, y in zip(a[i:j], b[i:j])]


def _build_up(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Slices sorted by anchor in, repeated window starts out."""
    held: list[pa.RecordBatch] = []

    def compare(table: pa.Table) -> pa.RecordBatch | None:
        seed = table["seed"].to_numpy()
        group = np.concatenate([[0], np.cumsum(seed[1:] != seed[:-1])])
        which, start = repeated_starts(
            table["body"].to_pylist(), group, table["lead"].to_numpy().astype(np.int64),
            table["n_starts"].to_numpy().astype(np.int64), length)
        found = list(_ranges(which, start))
        if not found:
            return None
        rows = pa.array([i for i, _ in found])
        return pa.RecordBatch.from_arrays(
            [table["doc_id"].combine_chunks().take(rows), table["at"].combine_chunks().take(rows),
             pa.array([r for _, r in found],
                      pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))],
            ["doc_id", "at", "starts"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < ROUND_SLICES:
            continue
        table = pa.Table.from_batches(held)
        seed = table["seed"].to_numpy()
        cut = int(np.searchsorted(seed != seed[-1], False)) if seed[0] == seed[-1] else int(
            np.flatnonzero(seed != seed[-1])[-1]) + 1
        if cut:
            out = compare(table.slice(0, cut))
            if out is not None:
                yield out
        held = table.slice(cut).to_batches()
    if sum(b.num_rows for b in held):
        out = compare(pa.Table.from_batches(held))
        if out is not None:
            yield out


def _window_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Every window of slices on its own: (seed, distance from the anchor, hash)."""
    for batch in batches:
        for row in batch.to_pylist():
            data = np.frombuffer(row["body"], np.uint8)
            start = np.arange(row["n_starts"])
            h = span_hash(prefix_hashes(data), start, start + length)
            n = len(start)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, row["seed"])), pa.array(start - row["lead"]),
                 pa.array(h.view(np.int64)), pa.array(np.full(n, row["doc_id"])),
                 pa.array(np.full(n, row["at"])), pa.array(start, pa.int32())],
                ["seed", "shift", "h", "doc_id", "at", "start"])


def repeated_spans(docs: DataFrame, length: int = LENGTH, seed: int = SEED,
                   hot_slices: int = HOT_SLICES, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Documents with bytes in a string of ``length`` bytes that also starts elsewhere, in
    another document or the same: doc_id, spans (bytes from, to; apart and in order).

    Texts are their UTF-8 bytes; shorter ones, empty and null texts have no such string. Rows
    that repeat an id are taken as copies of one text. Rows without an id are left out, other
    columns are not read; an empty table gives an empty result.
    """
    rows = texts(docs, id_col, text_col)
    found = keep(rows.filter(F.octet_length("text") >= length).mapInArrow(
        partial(_anchor_rows, length=length, seed=seed), _ANCHORS), "anchors")
    classes = keep(found.groupBy(*_KEY).agg(
        F.count("*").alias("copies"), F.min(F.struct("doc_id", "at")).alias("first")), "slices")
    # Equal slices: all their windows are repeated.
    copied = classes.filter("copies > 1").select(*_KEY)
    whole = F.array(F.struct(F.lit(0).alias("a"), (F.col("n_starts") - 1).alias("b")))
    in_copies = found.join(copied, _KEY).select("doc_id", "at", whole.alias("starts"))
    # Different slices at equal anchors: built up side by side.
    several = keep(classes.groupBy("seed").agg(F.count("*").alias("n")).filter("n > 1"), "seeds")
    wanted = classes.join(several, "seed").select(
        F.col("first.doc_id").alias("doc_id"), F.struct(
            "seed", F.col("first.at").alias("at"), "n_starts", "lead",
            (F.col("n") > hot_slices).alias("hot")).alias("want"))
    wanted = keep(wanted.groupBy("doc_id").agg(F.collect_list("want").alias("wanted")), "wanted")
    slices = rows.join(broadcast_if_small(wanted), "doc_id").select(
        "doc_id", "text", "wanted").mapInArrow(
        partial(_cut, length=length),
        "seed long, doc_id long, at long, n_starts int, lead int, hot boolean, body binary")
    hot = several.filter(F.col("n") > hot_slices)
    if hot.isEmpty():
        gathered, alone = slices, None
    else:
        slices = keep(slices, "bodies")
        gathered, alone = slices.filter("not hot"), slices.filter("hot")
    partly = keep(gathered.repartition("seed").sortWithinPartitions("seed").mapInArrow(
        partial(_build_up, length=length), _FOUND), "built")
    if alone is not None:
        windows = keep(alone.mapInArrow(
            partial(_window_rows, length=length),
            "seed long, shift long, h long, doc_id long, at long, start int"), "windows")
        key = ["seed", "shift", "h"]
        again = keep(windows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").drop("n"),
                     "again")
        one = F.struct(F.col("start").alias("a"), F.col("start").alias("b"))
        partly = partly.unionByName(windows.join(again, key).groupBy("doc_id", "at").agg(
            F.collect_list(one).alias("starts")))
    spans = in_copies.unionByName(partly).select("doc_id", F.transform(
        "starts", lambda s: F.struct((F.col("at") + s["a"]).alias("start"), (
            F.col("at") + s["b"] + length).alias("end"))).alias("spans"))
    return spans.groupBy("doc_id").agg(F.flatten(F.collect_list("spans")).alias("spans")
                                       ).mapInArrow(_merged, _SPANS)


_SPANS = "doc_id long, spans array<struct<start:long,end:long>>"


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        out = []
        for spans in batch.column("spans").to_pylist():
            start, end = merge_spans(np.array([s["start"] for s in spans], np.int64),
                                     np.array([s["end"] for s in spans], np.int64))
            out.append([{"start": s, "end": e} for s, e in zip(start.tolist(), end.tolist())])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(out, kind)], ["doc_id", "spans"])


def _kept(batches: Iterator[pa.RecordBatch], digests: bool) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(i, TEXTS_AT_ONCE) for b in batches
                  for i in range(0, b.num_rows, TEXTS_AT_ONCE)):
        rows = []
        for doc_id, text, spans in zip(*(batch.column(c).to_pylist()
                                         for c in ("doc_id", "text", "spans"))):
            body = text.encode()
            spans = spans or []
            at, parts = 0, []
            for s in spans:
                parts.append(body[at:s["start"]])
                at = s["end"]
            rest = b"".join([*parts, body[at:]])
            rows.append((doc_id, len(body), len(body) - len(rest), len(spans),
                         hashlib.sha256(rest).hexdigest() if digests
                         else rest.decode("utf-8", "replace")))
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in zip(*rows)],
                ["doc_id", "n_bytes", "n_removed", "n_spans",
                 "kept_sha256" if digests else "text"])


def without_repeats(docs: DataFrame, digests: bool = False, id_col: str = "doc_id",
                    text_col: str = "text", **settings) -> DataFrame:
    """Every text less its ``repeated_spans``: doc_id, n_bytes, n_removed, n_spans and the
    text that is left (characters cut in two come out as the replacement character), or
    with ``digests`` kept_sha256, the digest of the bytes that are left."""
    spans = keep(repeated_spans(docs, id_col=id_col, text_col=text_col, **settings), "spans")
    rows = texts(docs, id_col, text_col).join(broadcast_if_small(spans), "doc_id", "left")
    last = "kept_sha256" if digests else "text"
    return rows.select("doc_id", "text", "spans").mapInArrow(
        partial(_kept, digests=digests),
        f"doc_id long, n_bytes long, n_removed long, n_spans long, {last} string")
