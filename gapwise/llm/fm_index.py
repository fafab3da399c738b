"""Benchmark passages in documents, found in an FM-index of every shard.

A shard is a chunk of documents as one sequence of word numbers: words of the benchmark
have a number, all others break the sequence. Runs too short for any window are left out,
which changes no result. The shard's suffixes are sorted, its Burrows-Wheeler transform
goes into a wavelet tree, and all windows of the benchmark are searched backwards side by
side, a step narrowing the suffix range of each by two ranks. Occurrences are located by
walking to the next sampled suffix position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gapwise.llm.shared import frugal, keep, texts
from gapwise.llm.words import ALNUM, chunks, words

WINDOW = 13
# Every so many positions of a shard are kept to locate matches.
SAMPLE = 8
# Bytes of text in a shard; what a task holds is some dozen times that.
SHARD_BYTES = 1 << 19
# Benchmark windows that travel to the tasks at a time; more go in further rounds.
WINDOWS_PER_ROUND = 500_000
_U = np.uint64

_HITS = "doc_id long, n_words long, n_hit long, spans array<struct<start:long,end:long>>, items array<long>"


class WaveletTree:
    """Ranks over a sequence of small numbers: one bit vector per binary digit, each level
    holding the zeros of the level above before its ones (a wavelet matrix)."""

    def __init__(self, values: np.ndarray, n_symbols: int):
        self.levels = max(1, int(n_symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            bit = values >> level & 1
            ones = np.zeros(len(values) + 1, np.int64)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(values) - int(ones[-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        start, at = np.zeros_like(at), at.copy()
        for i, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = symbol >> (self.levels - 1 - i) & 1
            up_s, up_e = ones[start], ones[at]
            start = np.where(bit, zeros + up_s, start - up_s)
            at = np.where(bit, zeros + up_e, at - up_e)
        return at - start

    def access(self, at: np.ndarray) -> np.ndarray:
        """The number at each position."""
        value, at = np.zeros_like(at), at.copy()
        for ones, zeros in zip(self.ones, self.zeros):
            up = ones[at]
            bit = ones[at + 1] - up
            value = value << 1 | bit
            at = np.where(bit, zeros + up, at - up)
        return value


def suffix_order(values: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in order, by doubling the sorted length; only suffixes
    that are still tied are sorted again."""
    n = len(values)
    order = np.argsort(values, kind="stable")
    s = values[order]
    new = np.ones(n, bool)
    new[1:] = s[1:] != s[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    step = 1
    while True:
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            return order
        own = order[at]
        follow = np.where(own + step < n, rank[np.minimum(own + step, n - 1)], -1)
        head = rank[own]
        inner = np.lexsort((follow, head))
        own, head, follow = own[inner], head[inner], follow[inner]
        order[at] = own
        fresh = np.ones(len(at), bool)
        fresh[1:] = (head[1:] != head[:-1]) | (follow[1:] != follow[:-1])
        new[at] = fresh
        place = np.where(fresh, at, 0)
        rank[own] = np.maximum.accumulate(place)
        step *= 2


class FMIndex:
    """Counts and places of short sequences in one sequence of numbers from 1 up; the
    sequence is closed by a 0."""

    def __init__(self, values: np.ndarray):
        values = np.append(values, 0)
        self.n = len(values)
        order = suffix_order(values)
        self.symbols = int(values.max()) + 1
        last = values[order - 1]
        self.tree = WaveletTree(last, self.symbols)
        self.below = np.zeros(self.symbols + 1, np.int64)
        np.cumsum(np.bincount(values, minlength=self.symbols), out=self.below[1:])
        self.sampled = order % SAMPLE == 0
        self.sample_no = np.cumsum(self.sampled) - 1
        self.samples = order[self.sampled]

    def search(self, patterns: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of patterns, one per row, aligned to the right."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.n)
        live = np.arange(len(patterns))
        width = patterns.shape[1]
        for j in range(width):
            live = live[(sizes[live] > j) & (low[live] < high[live])]
            if not len(live):
                break
            symbol = patterns[live, width - 1 - j]
            base = self.below[np.minimum(symbol, self.symbols)]
            known = symbol < self.symbols
            clipped = np.where(known, symbol, 0)
            low[live] = np.where(known, base + self.tree.rank(clipped, low[live]), 0)
            high[live] = np.where(known, base + self.tree.rank(clipped, high[live]), 0)
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes, walking back to the next sampled one."""
        out = np.empty(len(rows), np.int64)
        rows, live, steps = rows.copy(), np.arange(len(rows)), 0
        while len(live):
            hit = self.sampled[rows]
            out[live[hit]] = self.samples[self.sample_no[rows[hit]]] + steps
            live, rows = live[~hit], rows[~hit]
            if len(live):
                symbol = self.tree.access(rows)
                rows = self.below[symbol] + self.tree.rank(symbol, rows)
                steps += 1
        return out


def merge_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unions of overlapping or touching spans."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    last = np.append(new[1:], True)
    return start[new], end[last]


class Phrases:
    """Distinct windows of the benchmark in numbers of its words."""

    def __init__(self, rows):
        self.vocabulary = np.unique(np.concatenate([r[1] for r in rows]).astype(np.int64).view(_U))
        sizes = np.array([len(r[1]) for r in rows], np.int64)
        width = int(sizes.max())
        self.sizes = sizes
        self.patterns = np.zeros((len(rows), width), np.int64)
        for i, (_, value) in enumerate(rows):
            own = np.searchsorted(self.vocabulary, np.array(value, np.int64).view(_U)) + 1
            self.patterns[i, width - len(own):] = own
        self.items = [r[0] for r in rows]
        self.shortest = int(sizes.min())


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for ids, data, offsets in chunks(batches):
        doc, _, _, hashes = words(data, offsets, ALNUM)
        edge = np.searchsorted(doc, np.arange(len(ids) + 1))
        item, found = [], []
        for i, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist())):
            own = hashes[a:b].view(np.int64)
            if 0 < b - a <= window:
                found.append(own)
                item.append(ids[i])
            else:
                found += [own[j:j + window] for j in range(b - a - window + 1)]
                item += [ids[i]] * max(0, b - a - window + 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(item, pa.int64()), pa.array(found, pa.list_(pa.int64()))],
            ["item_id", "words"])


def _search(batches: Iterator[pa.RecordBatch], phrases: Phrases | None
            ) -> Iterator[pa.RecordBatch]:
    for ids, data, offsets in chunks(batches, SHARD_BYTES):
        doc, _, _, hashes = words(data, offsets, ALNUM)
        n_words = np.bincount(doc, minlength=len(ids))
        spans = [[] for _ in range(len(ids))]
        items: list[set] = [set() for _ in range(len(ids))]
        hit = np.zeros(len(ids), np.int64)
        if phrases is not None and len(hashes):
            at = np.minimum(np.searchsorted(phrases.vocabulary, hashes), len(phrases.vocabulary) - 1)
            known = phrases.vocabulary[at] == hashes
            # runs of benchmark words within a document, long enough for a window
            place = np.flatnonzero(known)
            if len(place):
                new = np.ones(len(place), bool)
                new[1:] = (place[1:] != place[:-1] + 1) | (doc[place[1:]] != doc[place[:-1]])
                run = np.cumsum(new) - 1
                long = (np.bincount(run) >= phrases.shortest)[run]
                place, new = place[long], new[long]
            if len(place):
                _mark(phrases, at, place, new, doc, hit, spans, items,
                      np.cumsum(n_words) - n_words)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array(n_words), pa.array(hit),
             pa.array([[{"start": s, "end": e} for s, e in own] for own in spans],
                      pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
             pa.array([sorted(own) for own in items], pa.list_(pa.int64()))],
            ["doc_id", "n_words", "n_hit", "spans", "items"])


def _mark(phrases, number, place, new, doc, hit, spans, items, first_word) -> None:
    """Search one shard; add what it finds to the documents of the chunk."""
    # a break before every run: the number behind the benchmark's last
    gap = len(phrases.vocabulary) + 1
    run = np.cumsum(new)
    sequence = np.full(len(place) + int(run[-1]), gap)
    slot = np.arange(len(place)) + run
    sequence[slot] = number[place] + 1
    back = np.full(len(sequence), -1)
    back[slot] = place
    index = FMIndex(sequence)
    low, high = index.search(phrases.patterns, phrases.sizes)
    found = np.flatnonzero(high > low)
    count = (high - low)[found]
    which = np.repeat(found, count)
    rows = np.repeat(low[found], count) + np.arange(len(which)) - np.repeat(
        np.cumsum(count) - count, count)
    start = back[index.locate(rows)]
    end = start + phrases.sizes[which]
    owner = doc[start] if len(start) else start
    for i, w in set(zip(owner.tolist(), which.tolist())):
        items[i].update(phrases.items[w])
    start, end = merge_spans(start, end) if len(start) else (start, end)
    # spans of neighbouring documents may touch, never overlap
    for s, e in zip(start.tolist(), end.tolist()):
        while s < e:
            i = int(doc[s])
            stop = min(e, int(np.searchsorted(doc, i, "right")))
            spans[i].append((s - int(first_word[i]), stop - int(first_word[i])))
            hit[i] += stop - s
            s = stop


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                  share: int = 20, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Words of every document that lie in a passage of the benchmark.

    Words are runs of ASCII letters (lower-cased), digits and characters beyond ASCII.
    A passage is ``window`` words in a row of an item, or all words of a shorter item. A
    null or empty text has no words and is clean; an item without words has no passage.
    Contaminated: some word is hit and ``share * n_hit >= n_words``. Repeated documents are
    judged each, equal items both count. Rows without an id are left out, other columns are
    not read; an empty table gives an empty result, an empty benchmark clean documents.
    Columns: doc_id, n_words, n_hit, spans (words from, to), items (sorted), contaminated.

    The distinct windows travel to the tasks ``WINDOWS_PER_ROUND`` at a time; a larger
    benchmark takes several rounds over the documents, joined by a hash of id and text.
    """
    rows = texts(docs, id_col, text_col)
    items = texts(benchmark, item_col, item_text_col)
    windows = items.mapInArrow(lambda b: _windows(b, window), "item_id long, words array<long>")
    # one row per distinct window; its items are as few as the benchmark's copies of it
    distinct = windows.groupBy("words").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    distinct = keep(distinct.withColumn(
        "round", F.pmod(F.xxhash64("words"), F.lit(1 << 20)).cast("int")), "windows")
    rounds = max(1, -(-distinct.count() // WINDOWS_PER_ROUND))
    parts, listed = [], rows
    if rounds > 1:
        # Rounds meet by a key of the whole row, as an id may have several texts.
        key = F.xxhash64("doc_id", "text")
        rows, listed = rows.select(key.alias("doc_id"), "text"), rows.select("doc_id", key.alias("key"))
    for r in range(rounds):
        own = distinct.filter(F.col("round") % rounds == r).select("items", "words").collect()
        phrases = Phrases([(x["items"], x["words"]) for x in own]) if own else None
        shared = docs.sparkSession.sparkContext.broadcast(phrases)
        parts.append(rows.mapInArrow(
            frugal(lambda b, p=shared: _search(b, p.value)), _HITS))
    if rounds == 1:
        found = parts[0]
    else:
        found = listed.join(_joined(parts).withColumnRenamed("doc_id", "key"), "key").drop("key")
    return found.withColumn(
        "contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def _joined(parts: list[DataFrame]) -> DataFrame:
    """One row per key from the rows of several rounds; equal rows have equal keys."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("doc_id").agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    ).mapInArrow(_merge_rounds, _HITS)


def _merge_rounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, hit = [], []
        for own in batch.column("spans").to_pylist():
            s, e = merge_spans(np.array([x["start"] for x in own], np.int64),
                               np.array([x["end"] for x in own], np.int64))
            spans.append([{"start": a, "end": b} for a, b in zip(s.tolist(), e.tolist())])
            hit.append(int((e - s).sum()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_words"), pa.array(hit, pa.int64()),
             pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
             batch.column("items")], ["doc_id", "n_words", "n_hit", "spans", "items"])


def contamination_digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``contamination`` with the items as a count and a digest."""
    found = contamination(docs, benchmark)
    joined = F.array_join(F.sort_array(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(joined, 256).alias("items_sha256"), "contaminated")
