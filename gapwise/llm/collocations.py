"""Phrases whose words stand together more often than apart, by exact counts.

Texts become streams of word numbers once: every chunk of texts has its own list of words,
which a join with the vocabulary turns into numbers. N-grams are packed numbers, counted in
counting quotient filters: one per chunk and range of permuted keys, merged range by range.
Ranges hold some millions of occurrences whatever the collection's size, and a phrase that is
everywhere is one entry per chunk.

Only words that are frequent enough have numbers, and three words are counted only where both
pairs in them may be frequent: a bit table of fixed largest size answers that, and a wrong
yes only costs a counter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from gapwise.llm import quotient_filter as filters
from gapwise.llm.shared import TEXT_ROWS, frugal, keep
from gapwise.llm.words import buffers, mix

# Bytes of text in a chunk (one longer text stands alone).
CHUNK_BYTES = 4 << 20
# Bytes of text that a task gathers from batches to fill the chunks of its languages.
HELD_BYTES = 8 << 20
# Bytes of text that are taken apart at a time.
PIECE_BYTES = 1 << 20
# Occurrences counted together in a task, and expected in one range of keys.
TOGETHER = 2 << 20
# Rows of streams or filters that go to a worker at a time.
BLOB_ROWS = 8
# Entries of a range of keys that are sorted at a time.
SLICE = 1 << 18
# Bits of the table of frequent pairs: so many per pair, up to the largest size.
BITS_PER_PAIR, MOST_BITS = 16, 1 << 26

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\f\r")] = True
_WORD = ~_BREAK
_WORD[[9, 32]] = False

_STREAMS = "lang string, chunk long, words array<string>, counts array<long>, codes binary"
_FILTERS = "lang string, part long, filter binary"


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(words of the texts in order, whether a break or the start lies before each)."""
    data = _LOWER[data]
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge))
    ends = np.flatnonzero(before & (~inside | edge))
    marks = np.searchsorted(np.flatnonzero(_BREAK[data] | edge[:-1]), starts, "right")
    at = np.concatenate([[0], np.cumsum(ends - starts)])
    column = pa.Array.from_buffers(
        pa.large_binary(), len(starts),
        [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data[inside[:-1]]))])
    return pc.dictionary_encode(column), np.diff(marks, prepend=-1) > 0


def _stream(texts: pa.Array, rows: np.ndarray, sizes: np.ndarray):
    """(distinct words, their counts, codes of the chosen texts: 0 for a break, else word + 1).
    Texts are taken apart some at a time."""
    found = [_words(*buffers(texts.take(pa.array(rows[a:b]))))
             for a, b in _cuts(sizes[rows], PIECE_BYTES)]
    parts = pa.chunked_array([words for words, _ in found]).unify_dictionaries().chunks
    code = np.concatenate([p.indices.to_numpy() for p in parts])
    words = parts[0].dictionary.cast(pa.large_string()).cast(pa.string())
    counts = np.bincount(code, minlength=len(words))
    gap = np.concatenate([gap for _, gap in found])
    gap[:1] = False
    out = np.zeros(len(code) + int(gap.sum()), np.uint32)
    out[np.arange(len(code)) + np.cumsum(gap)] = code + 1
    return words, counts, out


def _cuts(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of up to ``limit`` bytes; one longer text stands alone."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    while at < len(sizes):
        end = max(int(np.searchsorted(total, total[at] + limit, "right")) - 1, at + 1)
        yield at, end
        at = end


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    held: dict[str, list[pa.Array]] = {}
    held_bytes: dict[str, int] = {}

    def flush(lang):
        nonlocal number
        texts = pa.concat_arrays(held.pop(lang))
        held_bytes.pop(lang)
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        rows = np.arange(len(texts))
        for a, b in _cuts(sizes, CHUNK_BYTES):
            words, counts, codes = _stream(texts, rows[a:b], sizes)
            if not len(words):
                continue
            yield pa.RecordBatch.from_pydict({
                "lang": [lang], "chunk": np.array([number], np.int64),
                "words": pa.ListArray.from_arrays(np.array([0, len(words)], np.int32), words),
                "counts": pa.ListArray.from_arrays(
                    np.array([0, len(words)], np.int32), pa.array(counts, pa.int64())),
                "codes": [codes.astype("<u4").tobytes()]})
            number += 1

    # A language's texts are gathered over batches until they fill a chunk.
    for batch in batches:
        coded = pc.dictionary_encode(batch.column("lang"))
        code = coded.indices.to_numpy()
        texts = batch.column("text").cast(pa.large_string())
        for which, lang in enumerate(coded.dictionary.to_pylist()):
            own = texts.filter(pa.array(code == which))
            size = int(pc.sum(pc.binary_length(own)).as_py() or 0)
            if held_bytes.get(lang, 0) + size > CHUNK_BYTES and lang in held:
                yield from flush(lang)
            held.setdefault(lang, []).append(own)
            held_bytes[lang] = held_bytes.get(lang, 0) + size
        while sum(held_bytes.values()) > HELD_BYTES:
            yield from flush(max(held_bytes, key=held_bytes.get))
    for lang in list(held):
        yield from flush(lang)


def _numbered(vocabulary: DataFrame) -> DataFrame:
    """Words with numbers from 1 in each language, without gaps."""
    placed = keep(vocabulary.repartitionByRange("lang", F.desc("f"), "word").sortWithinPartitions(
        "lang", F.desc("f"), "word").select(
        "*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "words")
    spans = placed.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per language and task of the sort.
    spans = spans.select("lang", "part", "first",
                         F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    return placed.join(spans, ["lang", "part"]).select(
        "lang", "word", "f", (F.col("at") - F.col("first") + F.col("skip") + 1).alias("id"))


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Codes of a chunk and the numbers of its words in, numbers out."""
    for batch in batches:
        out = []
        for codes, known in zip(batch.column("codes"), batch.column("known")):
            codes = np.frombuffer(codes.as_buffer(), "<u4")
            local = known.values.field("local").to_numpy()
            number = np.zeros(int(max(codes.max(), local.max())) + 1, np.uint32)
            number[local] = known.values.field("id").to_numpy()
            out.append(number[codes].astype("<u4").tobytes())
        yield pa.RecordBatch.from_pydict({
            "lang": batch.column("lang"), "ids": pa.array(out, pa.binary())})


def _lang_key(lang: str) -> np.uint64:
    return np.frombuffer(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "<u8")[0]


def _slots(lang: str, first: np.ndarray, second: np.ndarray, n_bits: int) -> np.ndarray:
    key = (first.astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)
    return mix(key ^ _lang_key(lang)) & np.uint64(n_bits - 1)


def _packed(ids: np.ndarray, n: int, width: int, lang: str, table):
    """Permutable keys of all n-grams of frequent words: (64 bits, 32 more or None)."""
    if len(ids) < n:
        return np.empty(0, np.uint64), (np.empty(0, np.uint32) if n * width > 64 else None)
    columns = [ids[i:len(ids) - n + 1 + i] for i in range(n)]
    whole = np.logical_and.reduce([c > 0 for c in columns])
    if table is not None:
        bits, n_bits = table.value
        at = np.flatnonzero(ids[:-1].astype(bool) & ids[1:].astype(bool))
        slot = _slots(lang, ids[at], ids[at + 1], n_bits)
        pair = np.zeros(len(ids) - 1, bool)
        pair[at] = bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1
        for i in range(n - 1):
            whole &= pair[i:len(pair) - n + 2 + i]
    columns = [c[whole].astype(np.uint64) for c in columns]
    if n * width > 64:
        # Three numbers of 32 bits.
        return columns[1] << np.uint64(32) | columns[2], columns[0].astype(np.uint32)
    key = columns[0]
    for c in columns[1:]:
        key = key << np.uint64(width) | c
    return key, None


def _unpacked(keys: np.ndarray, high: np.ndarray | None, n: int, width: int) -> list[np.ndarray]:
    if high is not None:
        low = keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)
        return [c.astype(np.int64) for c in (high, *low)]
    mask = np.uint64((1 << width) - 1)
    return [(keys >> np.uint64(width * (n - 1 - i)) & mask).astype(np.int64) for i in range(n)]


def _bits(n: int, width: int) -> int:
    return min(n * width, 64)


def _count(batches: Iterator[pa.RecordBatch], n: int, width: int, parts: dict[str, int], table
           ) -> Iterator[pa.RecordBatch]:
    """Streams of numbers in, filters of their n-grams out, one per range of permuted keys."""
    permutation = filters.Permutation(_bits(n, width))
    held: dict[str, list] = {}
    sizes: dict[str, int] = {}

    def flush(lang):
        low, high = zip(*held.pop(lang))
        sizes.pop(lang)
        low, high = np.concatenate(low), None if high[0] is None else np.concatenate(high)
        keys = permutation.apply(low, high)
        del low
        keys, high, counts = filters.counted(keys, high)
        lead = parts[lang]
        bits = permutation.bits - lead
        part = (keys >> np.uint64(bits)).astype(np.int64) if lead else np.zeros(len(keys), np.int64)
        keys &= np.uint64((1 << bits) - 1)
        at = np.flatnonzero(np.diff(part, prepend=-1, append=1 << 62))
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            blob = filters.encode(keys[a:b], None if high is None else high[a:b], counts[a:b], bits)
            yield pa.RecordBatch.from_pydict({
                "lang": [lang], "part": np.array([part[a]], np.int64), "filter": [blob]})

    for batch in batches:
        for lang, blob in zip(batch.column("lang").to_pylist(), batch.column("ids")):
            ids = np.frombuffer(blob.as_buffer(), "<u4")
            low, high = _packed(ids, n, width, lang, table)
            if not len(low):
                continue
            held.setdefault(lang, []).append((low, high))
            sizes[lang] = sizes.get(lang, 0) + len(low)
            if sum(sizes.values()) >= TOGETHER:
                yield from flush(max(sizes, key=sizes.get))
    for lang in list(held):
        yield from flush(lang)


def _merge(batches: Iterator[pa.RecordBatch], least: int, n: int, width: int,
           parts: dict[str, int], entries: int) -> Iterator[pa.RecordBatch]:
    """Filters of a range in a row in, its n-grams that occur at least ``least`` times out."""
    name, held, waiting = None, [], 0

    def close():
        for keys, high, counts in filters.merged_slices(held, entries):
            often = counts >= least
            if often.any():
                yield _entries(*name, keys[often], None if high is None else high[often],
                               counts[often], n, width, parts)

    for batch in batches:
        for lang, part, blob in zip(batch.column("lang").to_pylist(),
                                    batch.column("part").to_pylist(), batch.column("filter")):
            if (lang, part) != name:
                if held:
                    yield from close()
                name, held, waiting = (lang, part), [], 0
            held.append(filters.decode(blob.as_buffer()))
            waiting += len(held[-1][0])
            if len(held) > 1 and waiting > 2 * TOGETHER:
                held = [_joined(filters.merged_slices(held, entries))]
                waiting = 0
    if held:
        yield from close()


def _joined(slices):
    keys, high, counts = zip(*slices)
    return (np.concatenate(keys), None if high[0] is None else np.concatenate(high),
            np.concatenate(counts))


def _entries(lang: str, part: int, keys: np.ndarray, high: np.ndarray | None, counts: np.ndarray,
             n: int, width: int, parts: dict[str, int]) -> pa.RecordBatch:
    permutation = filters.Permutation(_bits(n, width))
    if parts[lang]:
        keys = keys | np.uint64(part) << np.uint64(permutation.bits - parts[lang])
    ids = _unpacked(permutation.undo(keys, high), high, n, width)
    return pa.RecordBatch.from_pydict({
        "lang": pa.array([lang] * len(counts), pa.string()),
        **{f"id{i + 1}": c for i, c in enumerate(ids)}, "f": counts})


def _pair_bits(batches: Iterator[pa.RecordBatch], n_bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        coded = pc.dictionary_encode(batch.column("lang"))
        code = coded.indices.to_numpy()
        first, second = (batch.column(c).to_numpy() for c in ("id1", "id2"))
        for which, lang in enumerate(coded.dictionary.to_pylist()):
            own = code == which
            slot = _slots(lang, first[own], second[own], n_bits)
            yield pa.RecordBatch.from_pydict({
                "word": (slot >> np.uint64(6)).astype(np.int64),
                "bits": (np.uint64(1) << (slot & np.uint64(63))).astype(np.int64)})


class Counts:
    """Words, pairs and triples of a collection with their counts."""

    def __init__(self, docs: DataFrame, least: int, lang_col: str = "lang", text_col: str = "text"):
        self.least = least
        rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"),
                           F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
        streams = keep(rows.mapInArrow(frugal(_streams), _STREAMS), "streams", batch_rows=TEXT_ROWS)
        listed = streams.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w"))
        every = keep(listed.groupBy("lang", F.col("w.words").alias("word")).agg(
            F.sum("w.counts").alias("f")), "vocabulary")
        self.totals = keep(every.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
        self.words = keep(_numbered(every.filter(F.col("f") >= least)), "numbers")
        top = self.words.agg(F.max("id")).first()[0] or 1
        self.width = int(top).bit_length() if 3 * int(top).bit_length() <= 64 else 32
        # One row per language.
        self.parts = {lang: min(max((n // TOGETHER).bit_length(), 0), 2 * int(top).bit_length() - 1)
                      for lang, n in self.totals.collect()}
        local = streams.select("lang", "chunk", F.posexplode("words").alias("pos", "word"))
        known = local.join(self.words, ["lang", "word"]).groupBy("chunk").agg(F.collect_list(
            F.struct((F.col("pos") + 1).alias("local"), F.col("id"))).alias("known"))
        self.ids = keep(streams.select("lang", "chunk", "codes").join(known, "chunk").select(
            "lang", "codes", "known").mapInArrow(frugal(_ids), "lang string, ids binary"), "ids",
            batch_rows=BLOB_ROWS)

    def ngrams(self, n: int, table=None) -> DataFrame:
        """N-grams that occur often enough: lang, id1.., f. Filters meet by range of keys."""
        args = {"n": n, "width": self.width, "parts": self.parts}
        single = self.ids.mapInArrow(frugal(partial(_count, table=table, **args)), _FILTERS)
        names = ", ".join(f"id{i + 1} long" for i in range(n))
        return keep(single.repartition("lang", "part").sortWithinPartitions("lang", "part").mapInArrow(
            frugal(partial(_merge, least=self.least, entries=SLICE, **args)), f"lang string, {names}, f long"),
            f"ngrams{n}", batch_rows=BLOB_ROWS)

    def pair_table(self, pairs: DataFrame):
        """A broadcast bit table of the pairs; at most MOST_BITS bits."""
        n_bits = 64
        wanted = pairs.count() * BITS_PER_PAIR
        while n_bits < min(wanted, MOST_BITS):
            n_bits *= 2
        set_bits = pairs.mapInArrow(frugal(partial(_pair_bits, n_bits=n_bits)), "word long, bits long")
        # At most MOST_BITS / 64 rows.
        found = set_bits.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        table = np.zeros(n_bits // 64, "<i8")
        table[found.column("word").to_numpy()] = found.column("bits").to_numpy()
        return pairs.sparkSession.sparkContext.broadcast((table.view(np.uint8), n_bits))


def _score(a: str, left: str, right: str):
    """floor(1000000 * a * a / (left * right)), at most 1000000."""
    return F.expr(f"(cast(1000000 as decimal(10, 0)) * cast({a} as decimal(14, 0)) * cast({a} as decimal(14, 0)))"
                  f" div (cast({left} as decimal(19, 0)) * cast({right} as decimal(19, 0)))")


def collocations(docs: DataFrame, least: int = 10, share: int = 50, top: int = 2000,
                 lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The best phrases of two and three words of every language.

    A-Z count as a-z; texts are cut at ``.,;:!?`` and line ends, pieces at spaces and tabs. A
    null text is empty, a null language ``und``. Candidates occur at least ``least`` times. A
    candidate's score is the lowest, over its cuts in two, of occurrences squared by the product of
    the occurrences of both parts, in millionths rounded down; of equal cuts the first. A pair inside
    a candidate of three words with at least ``share`` per cent of its occurrences is left out. Of
    each language the first ``top`` by score, occurrences (both descending) and phrase (bytes)
    stay. Repeated rows count every time; other columns are not read; an empty table gives an
    empty result. Counts are exact up to 10^14 occurrences of a phrase.

    Columns: lang, rank (from 1), phrase, a, l, r (occurrences of the phrase and of both parts),
    n (words of the language), score.
    """
    counts = Counts(docs, least, lang_col, text_col)
    pairs = counts.ngrams(2)
    table = counts.pair_table(pairs)
    triples = counts.ngrams(3, table)
    table.destroy()

    def word(i):
        return counts.words.select("lang", F.col("id").alias(f"id{i}"), F.col("word").alias(f"w{i}"),
                                   F.col("f").alias(f"f{i}"))

    def pair(i, j):
        return pairs.select("lang", F.col("id1").alias(f"id{i}"), F.col("id2").alias(f"id{j}"),
                            F.col("f").alias(f"f{i}{j}"))

    inside = triples.select("lang", "id1", "id2", "f").unionByName(
        triples.select("lang", F.col("id2").alias("id1"), F.col("id3").alias("id2"), "f"))
    longer = inside.groupBy("lang", "id1", "id2").agg(F.max("f").alias("most"))
    two = pairs.join(longer, ["lang", "id1", "id2"], "left").filter(
        F.col("most").isNull() | (F.col("most") * 100 < F.col("f") * share))
    two = two.join(word(1), ["lang", "id1"]).join(word(2), ["lang", "id2"]).select(
        "lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("f").alias("a"),
        F.col("f1").alias("l"), F.col("f2").alias("r"), _score("f", "f1", "f2").alias("score"))
    three = triples.join(pair(1, 2), ["lang", "id1", "id2"]).join(pair(2, 3), ["lang", "id2", "id3"])
    for i in (1, 2, 3):
        three = three.join(word(i), ["lang", f"id{i}"])
    three = three.withColumns({"s1": _score("f", "f1", "f23"), "s2": _score("f", "f12", "f3")})
    later = F.col("s2") < F.col("s1")
    three = three.select(
        "lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.col("f").alias("a"),
        F.when(later, F.col("f12")).otherwise(F.col("f1")).alias("l"),
        F.when(later, F.col("f3")).otherwise(F.col("f23")).alias("r"),
        F.least("s1", "s2").alias("score"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = two.unionByName(three).withColumn("rank", F.row_number().over(best)).filter(
        F.col("rank") <= top)
    return ranked.join(counts.totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
