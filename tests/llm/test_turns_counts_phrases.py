"""Conversation repair, prefix counts and collocations against brute-force versions."""

import collections
import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st

from gapwise.llm import (
    collocations as phrases, prefix_counts, quotient_filter as filters, turn_repair)
from gapwise.llm.collocations import collocations
from gapwise.llm.prefix_counts import (
    PieceModel, longest_prefixes, prefix_table, token_counts, tokens_of_prefixes)
from gapwise.llm.queries import PIECE_MODEL, QUERIES
from gapwise.llm.turn_repair import conversation_repairs, damaged, turn_edits

MODEL = public_tokenizers.path(PIECE_MODEL)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
with open(MODEL, "rb") as file:
    PIECES = PieceModel(file.read())

WHITE = " \t\n\x0b\f\r"


# Conversations

TURNS = "conv_id long, turn long, role string, text string, chunk long, pos int, conv string"


def cheapest(rows):
    """(cost, letters) of the cheapest, then least, repair of (initial or None, cut) rows."""
    want = {"": "su", "s": "u", "u": "a", "a": "u"}
    done, heap = set(), [(0, "", 0, "")]
    while heap:
        cost, letters, i, last = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return cost, letters
        for role in want[last]:
            if role != "s":
                heapq.heappush(heap, (cost + 2, letters + "I", i, role))
        if i == len(rows):
            continue
        heapq.heappush(heap, (cost + 3, letters + "D", i + 1, last))
        initial, cut = rows[i]
        if initial is None:
            continue
        for role in want[last]:
            if role == initial:
                heapq.heappush(heap, (cost + cut, letters + "K", i + 1, role))
            if role != "s":
                heapq.heappush(heap, (cost + 2 + cut, letters + "R", i + 1, role))


def one_conversation(rows):
    """What conversation_repairs reports, from (turn, role, text) in order."""
    counts, seen, symbols = collections.Counter(), set(), []
    for turn, role, text in rows:
        body = text.rstrip(WHITE)
        kind = ("blank" if not body else "duplicate" if (role, text) in seen
                else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
        counts[kind] += 1
        symbols.append((None if kind in ("blank", "duplicate") else role[:1], kind == "truncated"))
    cost, audit = cheapest(symbols)
    lines, last, at = [], "", 0
    for letter in audit:
        role, text = ("", "") if letter == "I" else rows[at][1:]
        at += letter != "I"
        if letter == "D":
            continue
        if letter != "K":
            role = "assistant" if last == "u" else "user"
        lines.append(f"{role}:{text}")
        last = role[:1]
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            counts["blank"], counts["duplicate"], counts["truncated"],
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def ordered(rows):
    digest = lambda text: hashlib.sha256(text.encode()).digest()
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r[2])))


def brute_damage(rows):
    for conv, turn, role, text, *_ in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        what = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if what == 1:
            text = ""
        if what == 2:
            text = re.sub("[.!?]", "", text)
        if what == 4:
            role = "user"
        yield from [(conv, turn, role, text)] * (0 if what == 0 else 2 if what == 3 else 1)


def make_turns():
    rng = random.Random(5)
    said = ["Yes.", "No!", "Why?", "so", "", " \n", "a.\t", "é", "x" * 9000 + ".", None]
    roles = ["user"] * 4 + ["assistant"] * 4 + ["system", "User", "", None, "uhu"]
    rows = []
    for conv in [*range(60), None, -3]:
        for turn in range(rng.randint(0, 12)):
            turn = rng.choice([turn, turn, turn, turn + 3, None])
            row = (conv, turn, rng.choice(roles), rng.choice(said), 7, 7, "conv")
            rows += [row] * rng.choice([1, 1, 1, 1, 2, 5])
    rows += [(1000, t, "user" if t % 2 == 0 else "assistant", f"{t // 9}.", 0, 0, "") for t in range(700)]
    return rows


def digests(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def test_tables_find_the_least_cheapest_edits():
    rng, table = random.Random(1), turn_repair.tables()
    for _ in range(1500):
        symbols = np.array([rng.randrange(9) for _ in range(rng.randint(0, 11))], np.uint8)
        letters, _, place = table.trace(symbols, table.number[turn_repair.END], 0)
        vector, add = table.run(symbols, table.number[turn_repair.END])
        rows = [(None, 0) if x == 0 else (("s", "u", "a", "other")[(x - 1) // 2], (x - 1) % 2)
                for x in symbols.tolist()]
        tail = {0: 0, 1: 2, 2: 1, 3: 0}[place]
        assert (table.vectors[vector][0] + add, "".join(letters) + "I" * tail) == cheapest(rows)


@pytest.mark.parametrize("batch", [10_000, 3])
def test_conversations(spark, batch):
    """Also with every conversation in many chunks."""
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = make_turns()
    turns = spark.createDataFrame(rows, TURNS)
    want = collections.defaultdict(list)
    for conv, *row in brute_damage(rows):
        want[conv].append(tuple(row))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = conversation_repairs(damaged(turns), turns)
        assert digests(got) == {r[0]: one_conversation(ordered(want[r[0]])) for r in rows}
        assert got.count() == len({r[0] for r in rows})
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_conversations_without_rows(spark):
    none = spark.createDataFrame([], TURNS)
    assert conversation_repairs(none).count() == 0
    one = spark.createDataFrame([(4, 1, "user", "x.", 0, 0, "")], TURNS)
    assert digests(conversation_repairs(none, one)) == {
        4: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}


def test_edits_of_turns(spark):
    turns = spark.createDataFrame(
        [(1, 1, "assistant", "Hm.", 0, 0, ""), (1, 2, "assistant", "Hm.", 0, 0, "")], TURNS)
    got = sorted((r.turn, r.fault, r.edits, r.copies) for r in turn_edits(turns).collect())
    assert got == [(1, 0, "IK", 1), (2, 2, "D", 1)]


def test_conversations_of_the_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    want = collections.defaultdict(list)
    for conv, *row in brute_damage(rows):
        want[conv].append(tuple(row))
    assert digests(QUERIES["op11_turn_repair"](spark, sf_dir)) == {
        r[0]: one_conversation(ordered(want[r[0]])) for r in rows}


# Token counts

BITS = ["the", " ", "  ", "ing", "er", "a", "b", "日本", "é", "é", "\n", "\t", "▁", "<s>",
        "</s>", "<0x41>", "==", "----", "////", "ß", "ﬁ", "\x00", "1", "23", ".", "'", "tt",
        "😀", " " * 14, " " * 15, " " * 33, "representation"]


def library_counts(text):
    return [len(LIBRARY.encode(text[:i])) for i in range(1, len(text) + 1)]


def segment_counts(text):
    counts, base = [], 0
    for segment in re.findall(" *[^ ]+| +$", " " + text.replace("▁", " ")):
        counts += [base + c for c in PIECES.counts(segment)]
        base = counts[-1]
    return counts[1:]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(BITS), min_size=1, max_size=12).map("".join))
def test_counts_of_all_prefixes(text):
    assert segment_counts(text) == library_counts(text)


@settings(max_examples=150, deadline=None)
@given(st.text(min_size=1, max_size=30))
def test_counts_of_any_characters(text):
    assert segment_counts(text) == library_counts(text)


@pytest.mark.parametrize("short, at_once", [(48, 20_000), (5, 7), (1, 1)])
def test_segments_side_by_side(monkeypatch, short, at_once):
    monkeypatch.setattr(prefix_counts, "SHORT", short)
    monkeypatch.setattr(prefix_counts, "SIDE_BY_SIDE", at_once)
    rng = random.Random(6)
    solid = [b for b in BITS if not set(b) & {" ", "▁"}]
    segments = [" " * rng.choice([0, 1, 1, 2, 15, 40]) + "".join(
        rng.choice(solid) for _ in range(rng.randint(0, 9))) for _ in range(300)]
    segments = [s for s in dict.fromkeys(segments) if s]
    got = PIECES.all_counts(segments)
    assert [np.frombuffer(g, np.int32).tolist() for g in got] == [PIECES.counts(s) for s in segments]


def test_prefix_table(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts += [None, "", " ", "a", "x" * 5000, "ab " * 3000, texts[0], " " * 500]
    rows = [(i if i < 60 else 7, t, 1) for i, t in enumerate(texts)] + [(None, "no id", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    table = prefix_table(docs, MODEL).cache()
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit)
                              for r in token_counts(table, 100).collect())
    want = [(i, len((t or "").encode()), len(LIBRARY.encode(t or ""))) for i, t, _ in rows if i is not None]
    assert got == collections.Counter((*w, w[2] > 100) for w in want)
    by_id = {i: t for i, t, _ in rows[:60]}
    at = table.filter("doc_id < 60 AND doc_id <> 7").selectExpr("*", "n_chars div 2 AS half")
    for r in tokens_of_prefixes(at, "half").collect():
        assert r.prefix_tokens == len(LIBRARY.encode(by_id[r.doc_id][:r.prefix_chars]))
    for r in longest_prefixes(at, 9).collect():
        fits = [n for n, c in enumerate([0, *library_counts(by_id[r.doc_id])]) if c <= 9]
        assert (r.fitting_chars, r.fitting_tokens <= 9) == (fits[-1], True)
    asked = table.filter("doc_id < 60 AND doc_id <> 7").limit(1)
    total = asked.first().n_tokens
    for value, want in (("-1", 0), ("99999", total), ("CAST(NULL AS INT)", None)):
        assert tokens_of_prefixes(asked.selectExpr("*", f"{value} AS n"), "n").first().prefix_tokens == want
    table.unpersist()


def test_prefix_table_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert prefix_table(none, MODEL).count() == 0


def test_other_models_are_refused():
    with pytest.raises(Exception):
        PieceModel(b"no model")


def test_token_counts_of_the_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    counts = LIBRARY.encode([r.text or "" for r in rows])
    want = {(r.doc_id, len((r.text or "").encode()), len(c), len(c) > 4096) for r, c in zip(rows, counts)}
    assert {tuple(r) for r in QUERIES["op12_prefix_counts"](spark, sf_dir).collect()} == want


# Phrases

@settings(max_examples=100, deadline=None)
@given(st.integers(1, 64), st.lists(st.integers(0, 2**64 - 1), max_size=60), st.booleans(), st.randoms())
def test_filters_lose_nothing(bits, keys, wide, rng):
    keys = np.array([k % (1 << bits) for k in keys], np.uint64)
    high = np.array([rng.randrange(3) for _ in keys], np.uint32) if wide else None
    permutation = filters.Permutation(bits)
    moved = permutation.apply(keys, high)
    assert (permutation.undo(moved, high) == keys).all()
    halves = []
    for half in (slice(0, len(keys) // 2), slice(len(keys) // 2, None)):
        some, more, counts = filters.counted(moved[half], None if high is None else high[half])
        counts *= rng.choice([1, 300])
        halves.append((some, more, counts))
    decoded = [filters.decode(filters.encode(*h, bits)) for h in halves]
    some, more, counts = filters.merged(decoded)
    want = collections.Counter()
    for half in halves:
        for i, k in enumerate(permutation.undo(half[0], half[1]).tolist()):
            want[k, 0 if high is None else int(half[1][i])] += int(half[2][i])
    back = permutation.undo(some, more).tolist()
    assert {(k, 0 if high is None else int(more[i])): int(counts[i]) for i, k in enumerate(back)} == want
    assert (np.diff(some.astype(object)) >= 0).all()


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), min_size=1, max_size=60), min_size=1, max_size=5),
       st.booleans(), st.integers(1, 50))
def test_filters_merge_in_slices(parts, wide, entries):
    """No slice has more than its share of entries but for those of one key."""
    decoded = []
    for part in parts:
        keys = np.array(part, np.uint64)
        decoded.append(filters.counted(keys, keys.astype(np.uint32) % 3 if wide else None))
    some, more, counts = filters.merged(decoded)
    slices = list(filters.merged_slices(decoded, entries))
    assert np.concatenate([s[0] for s in slices]).tolist() == some.tolist()
    assert np.concatenate([s[2] for s in slices]).tolist() == counts.tolist()
    if wide:
        assert np.concatenate([s[1] for s in slices]).tolist() == more.tolist()
    most = collections.Counter(np.concatenate([d[0] for d in decoded]).tolist()).most_common(1)[0][1]
    for keys, _, _ in slices:
        assert sum(np.isin(d[0], keys).sum() for d in decoded) <= 2 * entries + 2 * most + len(parts)


def brute_phrases(rows, least=10, share=50, top=2000):
    found = []
    langs = collections.defaultdict(list)
    for lang, text in rows:
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", folded):
            langs[lang or "und" if lang is None else lang].append(re.findall("[^ \t]+", piece))
    for lang, pieces in langs.items():
        f = collections.Counter(tuple(p[i:i + n]) for p in pieces for n in (1, 2, 3)
                                for i in range(len(p) - n + 1))
        total = sum(map(len, pieces))
        candidates = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        longer = collections.defaultdict(int)
        for g, a in candidates.items():
            if len(g) == 3:
                for part in (g[:2], g[1:]):
                    longer[part] = max(longer[part], a)
        scored = []
        for g, a in candidates.items():
            if len(g) == 2 and 100 * longer[g] >= share * a:
                continue
            s, k = min((1000000 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            scored.append((-s, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (s, a, phrase, l, r) in enumerate(sorted(scored)[:top], 1):
            found.append((lang, rank, phrase.decode(), -a, l, r, total, -s))
    return sorted(found)


def make_sentences():
    rng = random.Random(9)
    names = ["a", "B", "the", "É", "日", "x-y", "new", "York", "city", "(of"]
    rows = []
    for i in range(120):
        words = [rng.choice(names) for _ in range(rng.randint(0, 60))]
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ? "]) for w in words)
        rows.append((rng.choice(["en", "de", None, "und"]), text + "New york City"))
    rows += [("en", None), (None, ""), ("xx", "one"), ("fr", "oui " * 4000), ("en", rows[0][1])] + [
        ("de", "ja ja nein.")] * 30
    return rows


@pytest.mark.parametrize("settings_", [{}, {"TOGETHER": 50, "CHUNK_BYTES": 200, "MOST_BITS": 128}])
def test_collocations(spark, monkeypatch, settings_):
    """Also with many chunks, ranges and a bit table that is nearly full."""
    for name, value in settings_.items():
        monkeypatch.setattr(phrases, name, value)
    rows = make_sentences()
    docs = spark.createDataFrame([(l, t, 0, "x") for l, t in rows],
                                 "lang string, text string, n long, word string")
    got = sorted(tuple(r) for r in collocations(docs, top=40).collect())
    assert got == brute_phrases(rows, top=40)


def test_streams_gather_small_batches(monkeypatch):
    """Chunks of a language are filled over batches, and no more than that is held."""
    class Task:
        get = classmethod(lambda cls: cls)
        partitionId = classmethod(lambda cls: 3)

    monkeypatch.setattr(phrases, "TaskContext", Task)
    rows = [("en" if i % 3 else "de", f"one{i} two. Three") for i in range(60)]
    batches = [pa.RecordBatch.from_pydict({"lang": [l], "text": [t]}) for l, t in rows]
    whole = list(phrases._streams(iter(batches)))
    assert sorted(b["lang"][0].as_py() for b in whole) == ["de", "en"]
    monkeypatch.setattr(phrases, "HELD_BYTES", 100)
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 70)
    parts = list(phrases._streams(iter(batches)))
    assert len({b["chunk"][0].as_py() for b in parts}) == len(parts) > 10
    for lang in ("de", "en"):
        counts = [collections.Counter() for _ in range(2)]
        for count, found in zip(counts, (whole, parts)):
            for b in found:
                if b["lang"][0].as_py() == lang:
                    count.update(dict(zip(b["words"][0].as_py(), b["counts"][0].as_py())))
        assert counts[0] == counts[1] == collections.Counter(
            w for l, t in rows if l == lang for w in t.lower().replace(".", "").split())


def test_collocations_by_slices(spark, monkeypatch):
    """Ranges of which only a few entries are sorted at a time, also with wide numbers."""
    monkeypatch.setattr(phrases, "SLICE", 5)
    rows = make_sentences()
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    assert sorted(map(tuple, collocations(docs).collect())) == brute_phrases(rows)
    wide, narrow = phrases.Counts(docs, 10), phrases.Counts(docs, 10)
    wide.width = 32
    assert {tuple(r) for r in wide.ngrams(3).collect()} == {tuple(r) for r in narrow.ngrams(3).collect()}


def test_collocations_with_wide_numbers(spark, monkeypatch):
    rows = make_sentences()
    docs = spark.createDataFrame(rows, "lang string, text string")
    counts = phrases.Counts(docs, 10)
    counts.width = 32
    table = counts.pair_table(counts.ngrams(2))
    narrow = phrases.Counts(docs, 10)
    assert {tuple(r) for r in counts.ngrams(3, table).collect()} == {
        tuple(r) for r in narrow.ngrams(3).collect()}


def test_scores_beyond_64_bits(spark):
    huge = 10**12 + 7
    row = spark.createDataFrame([(huge, huge + 3, 3 * huge)], "a long, l long, r long")
    got = row.select(phrases._score("a", "l", "r")).first()[0]
    assert got == 1000000 * huge * huge // ((huge + 3) * 3 * huge)


def test_collocations_of_nothing(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert collocations(none).count() == 0
    blank = spark.createDataFrame([("en", " . "), ("en", None)], "lang string, text string")
    assert collocations(blank).count() == 0
