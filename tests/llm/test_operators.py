"""Every text operator against a brute-force version on small tables with nulls, empty and
long texts, ties, repeated rows and columns of clashing names."""

import collections
import hashlib
import os
import random
import re
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gapwise.llm import warc
from gapwise.llm.bpe import bpe_digests, bpe_round_trip
from gapwise.llm.chains import shared_passages
from gapwise.llm.content_sort import exact_duplicates
from gapwise.llm.fm_index import contamination
from gapwise.llm import chains, fm_index, jaccard_join, page_text
from gapwise.llm.jaccard_join import jaccard_groups
from gapwise.llm.page_text import page_texts
from gapwise.llm.repeats import repeated_spans, without_repeats
from gapwise.llm.shared import components, drop_rows, keep, one_text_per_id
from gapwise.llm.token_files import read_tokens, write_tokens
from gapwise.llm.toxicity import toxicity_scores
from gapwise.llm.words import NOT_SPACE, words

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, seed long, "
          "sig long, norm string, rep long, kept boolean, start int, h1 string")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def make_texts():
    rng = random.Random(11)
    vocabulary = ["w%d" % i for i in range(60)] + ["Élan", "über", "X", "the", "日本", "a,b"]
    word = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared = [word(60), word(25)]
    texts = {}
    for i in range(70):
        kind = i % 7
        if kind == 0 and i:
            old = texts[rng.randrange(i)] or "x"
            texts[i] = old
        elif kind == 1 and i:
            own = (texts[rng.randrange(i)] or "y").split(" ")
            own[rng.randrange(len(own))] = "changed"
            texts[i] = " ".join(own)
        elif kind == 2:
            texts[i] = " ".join(word(20) + rng.choice(shared) + word(rng.randint(0, 30)))
        else:
            texts[i] = rng.choice([" ", "\n", "  "]).join(word(rng.randint(0, 120)))
    texts.update({100: None, 101: "", 102: " \n\t", 103: "one", 104: "One", 105: "one two three",
                  106: " ".join(word(6000)), 107: "a" * 9000, 108: texts[3] + " \x0b",
                  109: "ab" * 700, 110: " ".join(shared[0] + shared[1]), 111: "o ne"})
    return texts


TEXTS = make_texts()


def rows_of(texts):
    return [(i, t, None, "s", None, 1, 2, "n", 3, True, 4, "h") for i, t in texts.items()]


@pytest.fixture(scope="module")
def docs(spark):
    """With one row repeated and one without an id."""
    rows = rows_of(TEXTS)
    rows += [rows[5], (None, "no id", None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, key="doc_id"):
    out = collections.defaultdict(list)
    for row in df.collect():
        out[row[key]].append(row.asDict())
    return out


def once(df):
    """Rows by id; the repeated row has two equal ones."""
    rows = by_id(df)
    assert set(rows) == set(TEXTS)
    assert all(len(v) == (2 if i == 5 else 1) for i, v in rows.items())
    return {i: v[0] for i, v in rows.items()}


@pytest.mark.parametrize("partitions", [1, 40])
def test_exact_duplicates(spark, docs, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = by_id(exact_duplicates(docs))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    norm = {i: re.sub("[\x20\x09-\x0d]+", "", t or "") for i, t in TEXTS.items()}
    groups = collections.defaultdict(list)
    for i, n in norm.items():
        groups[n] += [i] * (2 if i == 5 else 1)
    assert set(rows) == set(TEXTS)
    for i, n in norm.items():
        best = min(groups[n], key=lambda j: (-len(TEXTS[j] or ""), j))
        for row in rows[i]:
            assert (row["keep_id"], row["group_size"]) == (best, len(groups[n]))
            assert row["text_sha256"] == hashlib.sha256(n.encode()).hexdigest()
        assert sum(r["kept"] for r in rows[i]) == (i == best)


def test_exact_duplicates_of_one_text(spark):
    df = spark.range(0, 3000).toDF("doc_id").withColumn("text", F.lit("same")).repartition(9)
    rows = exact_duplicates(df).groupBy("keep_id", "group_size", "kept").count().collect()
    assert sorted(map(tuple, rows)) == [(0, 3000, False, 2999), (0, 3000, True, 1)]


def shingle_set(text, k):
    w = re.findall("[^\x20\x09-\x0d]+", fold(text))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


@pytest.mark.parametrize("k,num,combine", [(4, 85, 3_000_000), (5, 80, 50), (2, 60, 200)])
def test_jaccard_groups(docs, monkeypatch, k, num, combine):
    monkeypatch.setattr(jaccard_join, "COMBINE_ROWS", combine)
    monkeypatch.setattr(jaccard_join, "BLOCK_MEMBERS", 4 if combine == 200 else 2_000)
    rows = once(jaccard_groups(docs, k, num, 100))
    sets = {i: shingle_set(t, k) for i, t in TEXTS.items()}
    root = {i: i for i in TEXTS}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in TEXTS:
        for j in TEXTS:
            both = len(sets[i] & sets[j])
            if i < j and sets[i] and 100 * both >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in rows.items()} == {
        i: (len(sets[i]), find(i)) for i in TEXTS}


def test_near_copies_that_do_not_link(spark):
    """Many versions of a text, some pairs similar and most not, without any star centre."""
    rng = random.Random(8)
    base = ["b%d" % i for i in range(120)]
    texts = {}
    for i in range(80):
        own = list(texts[rng.randrange(i)].split(" ")) if i % 4 == 3 else list(base)
        for _ in range(1 if i % 4 == 3 else 4):
            own[rng.randrange(120)] = "x%d" % rng.randrange(10 ** 6)
        texts[i] = " ".join(own)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_groups(df, 4, 85, 100).collect()}
    sets = {i: shingle_set(t, 4) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in texts:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 85 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i in texts}
    assert 10 < len(set(got.values())) < 70


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    random.Random(0).shuffle(edges)
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in got} == {
        **{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}}


def windows(text, n=13):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", fold(text))
    return w, [tuple(w[i:i + n]) for i in range(len(w) - n + 1)] or ([tuple(w)] if w else [])


@pytest.mark.parametrize("per_round", [500_000, 40])
def test_contamination(spark, docs, monkeypatch, per_round):
    monkeypatch.setattr(fm_index, "WINDOWS_PER_ROUND", per_round)
    items = {1: " ".join((TEXTS[3] or "").split()[5:40]), 2: "W1, w2", 3: None, 4: "", 5: "?!",
             6: " ".join((TEXTS[9] or "x").split()[:14]), 7: "über  Élan", 8: "w1 W2.", 10: "日本",
             11: "zz yy"}
    bench = spark.createDataFrame([(i, t, "x") for i, t in items.items()],
                                  "item_id long, text string, doc_id string")
    rows = by_id(contamination(docs, bench))
    assert set(rows) == set(TEXTS)
    assert contamination(docs, bench).count() == docs.filter("doc_id IS NOT NULL").count()
    twice = spark.createDataFrame([(1, TEXTS[3]), (1, "zz yy"), (1, "clean")], "doc_id long, text string")
    assert sorted(r["n_hit"] for r in contamination(twice, bench).collect()) == [
        0, 2, rows[3][0]["n_hit"]]
    of = collections.defaultdict(set)
    for i, t in items.items():
        for w in windows(t)[1]:
            of[w].add(i)
    for i, t in TEXTS.items():
        w = windows(t)[0]
        hit, found = set(), set()
        for n in {len(x) for x in of}:
            for j in range(len(w) - n + 1):
                if (own := tuple(w[j:j + n])) in of:
                    hit.update(range(j, j + n))
                    found |= of[own]
        row = rows[i][0]
        assert (row["n_words"], row["n_hit"], row["items"]) == (len(w), len(hit), sorted(found))
        assert {x for s in row["spans"] for x in range(s["start"], s["end"])} == hit
        assert row["contaminated"] == (len(hit) > 0 and 20 * len(hit) >= len(w))


def test_no_benchmark(spark, docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert contamination(docs, bench).filter("contaminated or n_hit > 0").count() == 0


def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def test_bpe(docs):
    tokenizer = library()
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids for i, t in TEXTS.items()}
    rows = once(bpe_round_trip(docs, PATH))
    assert {i: (r["ids"], r["decoded"]) for i, r in rows.items()} == {
        i: (ids[i], t or "") for i, t in TEXTS.items()}
    rows = once(bpe_digests(docs, PATH))
    for i, t in TEXTS.items():
        assert rows[i]["n_tokens"] == len(ids[i])
        assert rows[i]["ids_sha256"] == hashlib.sha256(
            ",".join(map(str, ids[i])).encode()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_token_files(docs):
    tokenizer = library()
    manifest = write_tokens(docs, PATH, end_id=0)
    rows = once(read_tokens(manifest))
    at = 0
    for i in sorted(TEXTS):
        ids = tokenizer.encode(TEXTS[i] or "", add_special_tokens=False).ids + [0]
        row = rows[i]
        assert row["ids"] == ids and row["n_tokens"] == len(ids)
        assert row["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        if i != 5:
            assert row["start"] == at
        at += len(ids) * (2 if i == 5 else 1)
    total = manifest.agg(F.sum("n_docs"), F.sum("n_ids")).first()
    assert tuple(total) == (len(TEXTS) + 1, at)


def repeated(texts, length):
    """Marks per document by counting every window."""
    seen = collections.Counter()
    body = {i: (t or "").encode() for i, t in texts.items()}
    for i, b in body.items():
        for p in range(len(b) - length + 1):
            seen[b[p:p + length]] += 2 if i == 5 else 1
    out = {}
    for i, b in body.items():
        mark = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen[b[p:p + length]] > 1:
                mark[p:p + length] = True
        out[i] = mark
    return body, out


@pytest.mark.parametrize("length,seed,hot", [(60, 16, 20_000), (60, 16, 2), (400, 32, 20_000)])
def test_without_repeats(docs, length, seed, hot):
    body, marks = repeated(TEXTS, length)
    rows = once(without_repeats(docs, digests=True, length=length, seed=seed, hot_slices=hot))
    for i, mark in marks.items():
        runs = int((mark & ~np.insert(mark[:-1], 0, False)).sum()) if len(mark) else 0
        rest = bytes(np.frombuffer(body[i], np.uint8)[~mark])
        assert (rows[i]["n_bytes"], rows[i]["n_removed"], rows[i]["n_spans"],
                rows[i]["kept_sha256"]) == (len(body[i]), int(mark.sum()), runs,
                                            hashlib.sha256(rest).hexdigest())


def test_shared_passages(docs):
    got = by_id(shared_passages(docs, min_words=30))
    w = {i: re.findall("[^\x20\x09-\x0d]+", fold(t)) for i, t in TEXTS.items()}
    where = collections.defaultdict(set)
    for i, own in w.items():
        for j in range(len(own) - 29):
            where[tuple(own[j:j + 30])].add(i)
    exact = collections.defaultdict(set)
    for own, ids in where.items():
        for i in ids if len(ids) > 1 else ():
            exact[i].add(own)
    for i, runs in exact.items():
        spans = [(r["start_word"], r["end_word"]) for r in got[i]]
        for j in range(len(w[i]) - 29):
            if tuple(w[i][j:j + 30]) in runs:
                # a partner that was not compared may share a word or two more
                assert any(a - 3 <= j and j + 30 <= b + 3 for a, b in spans), (i, j, spans)
    for i, found in got.items():
        assert i is not None
        for r in found:
            assert r["n_words"] == r["end_word"] - r["start_word"] >= 30
            assert r["other_id"] != i and r["end_word"] <= len(w[i])
            # most of a passage stands elsewhere, word for word in runs of five
            fives = [tuple(w[i][j:j + 5]) for j in range(r["start_word"], r["end_word"] - 4)]
            elsewhere = {tuple(o[j:j + 5]) for k, o in w.items() if k != i
                         for j in range(len(o) - 4)}
            assert sum(f in elsewhere for f in fives) >= 0.4 * len(fives)


def test_fuzzy_passage(spark):
    rng = random.Random(4)
    word = lambda n: ["q%d" % rng.randrange(10 ** 6) for _ in range(n)]
    passage = word(80)
    edited = passage[:30] + ["new"] + passage[30:50] + passage[52:70] + ["other"] + passage[71:]
    texts = {1: word(100) + passage + word(50), 2: word(20) + edited + word(90), 3: word(300)}
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()],
                               "doc_id long, text string")
    got = by_id(shared_passages(df))
    assert set(got) == {1, 2}
    assert (got[1][0]["start_word"], got[1][0]["end_word"], got[1][0]["other_id"]) == (100, 180, 2)
    assert (got[2][0]["start_word"], got[2][0]["end_word"], got[2][0]["other_id"]) == (20, 99, 1)


def pair_passages(x, y):
    """Passages of two documents by all their common seeds, without any other document."""
    data = [" ".join(t).encode() for t in (x, y)]
    doc, _, _, hashes = words(np.frombuffer(b"".join(data), np.uint8),
                              np.array([0, len(data[0]), len(data[0]) + len(data[1])]), NOT_SPACE)
    of, at, value = chains.seeds(doc, hashes, 2, 5, 8, 50)
    matches = sorted((int(q - p), int(p), int(q)) for p, u in zip(at[of == 0], value[of == 0])
                     for q in at[of == 1][value[of == 1] == u])
    if not matches:
        return {1: [], 2: []}
    n, (_, p, q) = len(matches), zip(*matches)
    batch = chains.pa.RecordBatch.from_pydict({"a": [1] * n, "pa": p, "b": [2] * n, "pb": q})
    found = {1: [], 2: []}
    codes = [(hashes[doc == d] >> np.uint64(48)).astype("<u2") for d in (0, 1)]
    for out in chains._chains(iter([batch]), 5, chains.MIN_PART):
        whole = chains.pa.RecordBatch.from_pydict(
            {**out.to_pydict(), "low": [0], "near": [codes[1].tobytes()],
             "codes": [codes[0].tobytes()]})
        for parts in chains._aligned(iter([whole]), 0.8, chains.MIN_PART):
            for r in parts.to_pylist():
                found[r["doc_id"]].append((r["start"], r["end"], r["other"]))
    return {d: [s for s in chains.unite(f) if s[1] - s[0] >= 50] for d, f in found.items()}


def test_passages_of_documents_that_are_not_first(spark, monkeypatch):
    monkeypatch.setattr(chains, "BLOCK_SEEDS", 4, raising=False)
    rng = random.Random(8)
    word = lambda n: ["z%d" % rng.randrange(10 ** 6) for _ in range(n)]
    lines = [word(15) for _ in range(12)]
    texts = {1: sum((s + word(30) for s in lines[5::-1]), []), 10: word(30) + sum(lines, [])}
    for i, glue in ((2, 1), (3, 2)):
        texts[i] = word(20) + sum((s + word(glue) for s in lines[:6]), []) + word(25)
    # the passage around the second place of a line of the first document
    texts[4] = word(40) + lines[8] + word(60) + lines[7] + lines[8] + lines[9] + lines[10] + word(9)
    texts[5] = word(33) + lines[7] + lines[8] + lines[9] + lines[10] + word(12)
    for i in range(11, 40):
        own = rng.sample(lines, rng.randint(1, 4))
        texts[i] = sum((s + word(rng.choice([0, 0, 1, 2, 30])) for s in own), []) + word(50)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()],
                               "doc_id long, text string").repartition(7)
    got = by_id(shared_passages(df))
    assert all(any(r["n_words"] >= 90 for r in got[i]) for i in (2, 3))
    for i, x in texts.items():
        for j, y in texts.items():
            for own, spans in zip((i, j), pair_passages(x, y).values()) if i < j else ():
                for a, b, _ in spans:
                    # a word that grows by chance, and ends where no seed lies, may differ
                    assert any(r["start_word"] - 3 <= a and b <= r["end_word"] + 3
                               for r in got.get(own, [])), (i, j, own, a, b, got.get(own))


def test_runs_of_a_word_do_not_meet_place_by_place(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda n: ["r%d" % rng.randrange(10 ** 6) for _ in range(n)]
    texts = {i: word(30) + ["the"] * (25 + i % 7) + word(30) for i in range(40)}
    for i, n in ((50, 70), (51, 90)):
        texts[i] = word(20) + ["at"] * n + word(25)
    # runs too short for a passage, with what makes one of them
    tail = word(40)
    for i in (60, 61, 62):
        texts[i] = word(20) + ["the"] * 22 + (tail if i > 60 else word(40)) + word(15)
    counted, real = [], chains._parts

    def parts(met, *others):
        counted.append(met.count())
        return real(met, *others)

    monkeypatch.setattr(chains, "_parts", parts)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()],
                               "doc_id long, text string").repartition(3)
    got = by_id(shared_passages(df))
    for i, n, j in ((50, 70, 51), (51, 90, 50)):
        assert [(r["start_word"], r["end_word"], r["other_id"]) for r in got[i]] == [(20, 20 + n, j)]
    for i in (61, 62):
        assert any(r["start_word"] <= 20 and r["end_word"] >= 82 for r in got[i])
    assert counted[1] < 1000


PAGES = {
    1: ("http://h.example/a", "<html><body><nav>menu one</nav><article><h1>T&amp;t</h1><p>x  y"
        "</article></body></html>"), 2: (None, None), 3: ("bad\r\nurl", ""),
    4: ("http://h.example/b", "é" * 600), 5: ("http://h.example/c", "é" * 600),
    6: ("http://g.example/c", "é" * 600), 7: (None, "short"), 8: ("u", "short"),
    9: ("http://h.example/long", "<p>" + "word " * 60_000)}


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, u, h, "payload", 5) for i, (u, h) in PAGES.items()]
    rows += [rows[3], (None, "u", "x", None, None)]
    return spark.createDataFrame(
        rows, "page_id long, url string, html string, payload string, refers_to int").repartition(3)


def test_warc(pages):
    manifest = warc.write_warc(pages)
    for split in (200, 1 << 20):
        rows = by_id(warc.read_warc(manifest, split, payloads=True), "page_id")
        assert set(rows) == set(PAGES) and len(rows[4]) == 2
        for i, (url, page) in PAGES.items():
            body = (page or "").encode()
            row = rows[i][0]
            to = 6 if i in (4, 5) else None
            assert (row["payload_bytes"], row["payload_digest"]) == (
                len(body), hashlib.sha1(body).hexdigest())
            assert (row["record_type"], row["refers_to"]) == ("revisit" if to else "response", to)
            assert row["url"] == (url.replace("\r\n", "%0D%0A") if url else None)
            assert row["payload"] == (None if to else bytearray(body))


def test_pages_that_share_an_id(spark):
    payloads = ["a" * 1500, "b" * 1500, "a" * 1500, "c" * 1500, "b" * 1500, "small"]
    ids = [1, 1, 2, 2, 3, 3]
    pages = spark.createDataFrame([(i, "u", p) for i, p in zip(ids, payloads)],
                                  "page_id long, url string, html string")
    rows = warc.read_warc(warc.write_warc(pages)).collect()
    want = [(1, "revisit", 2), (1, "revisit", 3), (2, "response", None), (2, "response", None),
            (3, "response", None), (3, "response", None)]
    assert sorted((r["page_id"], r["record_type"], r["refers_to"] or 0) for r in rows) == [
        (i, k, t or 0) for i, k, t in want]
    of = {("revisit", 2): "a", ("revisit", 3): "b"}
    for r in rows:
        if r["refers_to"]:
            letter = of[r["record_type"], r["refers_to"]]
            assert r["payload_digest"] == hashlib.sha1(letter.encode() * 1500).hexdigest()


@pytest.mark.parametrize("split", [300, 1 << 20])
def test_flipped_bytes_and_long_headers(spark, split):
    from pyspark.errors import PythonException

    long_url = "http://x/" + "é%" * 35_000
    pages = spark.createDataFrame(
        [(i, long_url if i == 4 else "u", "x" * 40 * i + str(i)) for i in range(10)],
        "page_id long, url string, html string").coalesce(1)
    manifest = warc.write_warc(pages)
    rows = by_id(warc.read_warc(manifest, split), "page_id")
    assert len(rows) == 10 and rows[4][0]["url"] == long_url
    system, local = warc.filesystem(manifest.first()["path"])
    with system.open_input_stream(local, compression=None) as f:
        whole = bytearray(f.read())
    starts = [i for i in range(len(whole)) if whole[i:i + 3] == warc.MAGIC]
    for at in (starts[3] + 20, starts[-1] + 15, 12):
        hurt = bytearray(whole)
        hurt[at] ^= 0x55
        hurt[at + 1] ^= 0x55
        with system.open_output_stream(local, compression=None) as f:
            f.write(bytes(hurt))
        with pytest.raises(PythonException, match="record"):
            warc.read_warc(manifest, split).collect()


def test_damaged_warc_raises(spark, pages):
    from pyspark.errors import PythonException

    manifest = warc.write_warc(pages.filter("page_id = 1"))
    path = manifest.first()["path"]
    system, local = warc.filesystem(path)
    member = warc.page_record(1, "u", b"one", "d", None)
    with system.open_output_stream(local, compression=None) as f:
        import gzip

        f.write(gzip.compress(gzip.decompress(member).replace(b"\r\n\r\none", b"\r\n\r\ntwo")))
    with pytest.raises(PythonException, match="damaged record"):
        warc.read_warc(manifest).collect()


def test_page_texts_of_a_large_host(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda n: " ".join("v%d" % rng.randrange(10 ** 6) for _ in range(n))
    notice, rare, twin = word(12), word(9), word(10)
    rows = []
    for i in range(60):
        body = [word(15)] + [t for t, on in ((notice, i % 7 == 0), (rare, i in (5, 33, 58)),
                                             (twin, i in (8, 41))) if on]
        rows.append((i, f"http://big.example/{i}", "".join(f"<p>{b}</p>" for b in body)))
    # copies of a page are one page, and pages with an article count as well
    rows += [(100 + i, "http://big.example/c", f"<p>{word(0)}{twin} copied page</p>") for i in range(5)]
    rows += [(200 + i, f"http://big.example/a{i}", f"<article>x{i}</article><p>{twin}</p>{i}")
             for i in range(2) if i]
    rows += [(300 + i, "http://small.example/", f"<p>{notice}</p>") for i in range(2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    whole = {r["page_id"]: r["text"] for r in page_texts(df).collect()}
    monkeypatch.setattr(page_text, "GROUP_PAGES", 4)
    dealt = {r["page_id"]: r["text"] for r in page_texts(df).collect()}
    assert dealt == whole and len(whole) == len(rows)
    assert sum(notice in t for t in dealt.values()) == 2
    assert not any(rare in t or twin in t for t in dealt.values())


def test_page_texts(spark, pages):
    rows = by_id(page_texts(pages), "page_id")
    assert set(rows) == set(PAGES) and len(rows[4]) == 2
    want = {1: "T&t\n\nx y", 2: "", 3: "", 7: "short", 8: "short", 4: "é" * 600, 5: "é" * 600,
            6: "é" * 600, 9: " ".join(["word"] * 60_000)}
    assert {i: r[0]["text"] for i, r in rows.items()} == want
    assert all(r[0]["n_chars"] == len(want[i]) and r[0]["url"] == PAGES[i][0]
               for i, r in rows.items())


def test_host_boilerplate_goes(spark):
    notice = "please read our terms of service and the privacy policy before use"
    body = [" ".join(f"u{i}x{j}" for j in range(30)) for i in range(9)]
    rows = [(i, "https://Same.example/p", f"<div>{notice}</div><p>{b}</p>") for i, b in enumerate(body)]
    rows += [(50 + i, "https://other.example/p", r[2]) for i, r in enumerate(rows[:2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in page_texts(df).collect()}
    assert {i: got[i] for i in range(9)} == dict(enumerate(body))
    assert got[50] == f"{notice}\n\n{body[0]}"


def test_menus_of_all_pages_count_as_host_boilerplate(spark):
    notice = "all prices include tax unless the seller says otherwise on the label"
    body = [" ".join(f"m{i}x{j}" for j in range(30)) for i in range(5)]
    rows = [(i, "https://menu.example/p", f"<nav>{notice}</nav><p>{b}</p>") for i, b in enumerate(body)]
    rows[4] = (4, "https://menu.example/q", f"<div>{notice}</div><p>{body[4]}</p>")
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in page_texts(df).collect()}
    assert got == dict(enumerate(body))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(900):
        toxic = int(rng.random() < 0.3)
        w = ["n%d" % rng.randrange(300) for _ in range(rng.randint(3, 60))]
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(["Idiot", "scum", "moronic"]))
        rows.append((i, " ".join(w), 5))
        if i % 2 == 0:
            labels.append((i, toxic))
    rows += [(2000, None, 1), (2001, "", 1), (2002, "n1 " * 50_000, 1), (None, "scum", 1), rows[0]]
    labels += [(2000, None), (5000, 1), (0, labels[0][1]), (None, 1)]
    return (spark.createDataFrame(rows, "doc_id long, text string, score int"),
            spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels))


def test_story_beside_an_article(spark):
    """Outside of articles, what a host does not repeat stays; checked against all substrings
    of eight words on three different pages."""
    rng = random.Random(4)
    word = lambda n: " ".join(rng.choice("abcdefghij") + rng.choice("klmnop") for _ in range(n))
    frame = ["Our house has printed papers since the year of the flood", word(12)]
    pages = []
    for i in range(8):
        story = word(40)
        pages.append((i, f"http://one.example/{i}", f"<div>{frame[0]}</div><article>Teaser {i}</article>"
                      f"<div>{story}</div><div>{frame[1]}</div><div>short one</div>", f"Teaser {i}\n\n{story}"))
    pages += [(20, "http://two.example/", "<article>Teaser</article><div>a story of more words than "
               "the teaser has in all</div>", "Teaser\n\na story of more words than the teaser has in all"),
              (21, "http://three.example/", f"<article>{word(60)}</article><div>{word(10)}</div>", None)]
    df = spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in page_texts(df).collect()}
    for i, _, page, text in pages:
        assert got[i] == (text if text is not None else re.search("<article>(.*)</article>", page)[1])
    streams = [re.sub("<article>.*</article>", "", p[2]) for p in pages[:8]]
    tokens = [re.sub("<[^>]*>", " ", x).split() for x in streams]
    where = collections.defaultdict(set)
    for i, own in enumerate(tokens):
        for j in range(len(own) - 7):
            where[tuple(own[j:j + 8])].add(i)
    for i, own in enumerate(tokens):
        gone = {k for j in range(len(own) - 7) if len(where[tuple(own[j:j + 8])]) >= 3 for k in range(j, j + 8)}
        left = [w for k, w in enumerate(own) if k not in gone]
        assert " ".join(left).removesuffix(" short one") == got[i].split("\n\n")[1]


def test_toxicity(labelled):
    docs, labels, truth = labelled
    rows = toxicity_scores(docs, labels).collect()
    assert len(rows) == 904
    by = {r["doc_id"]: r for r in rows}
    for i, r in by.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [(r["predicted"], truth[i]) for i, r in by.items()
            if r["held_out"] and truth.get(i) is not None]
    assert np.mean([a == b for a, b in held]) > 0.95
    assert by[2000]["score"] == by[2001]["score"]


def test_held_out_labels_are_not_used(labelled):
    docs, labels, _ = labelled
    turned = labels.withColumn("toxic", F.when(
        F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(
        F.col("toxic")))
    a, b = (dict(toxicity_scores(docs, x).select("doc_id", "score").collect())
            for x in (labels, turned))
    assert a == pytest.approx(b, abs=1e-9)


def test_labels_of_one_kind(labelled, spark):
    docs, _, _ = labelled
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity_scores(docs, none).collect()} == {0.5}
    clean = spark.createDataFrame([(i, 0) for i in range(40)], "doc_id long, toxic int")
    assert {r["predicted"] for r in toxicity_scores(docs, clean).collect()} == {0}


def test_empty_tables(spark, nothing):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for df in (exact_duplicates(nothing), jaccard_groups(nothing), contamination(nothing, bench),
               bpe_digests(nothing, PATH), bpe_round_trip(nothing, PATH),
               read_tokens(write_tokens(nothing, PATH)), repeated_spans(nothing),
               without_repeats(nothing), shared_passages(nothing), page_texts(none),
               warc.read_warc(warc.write_warc(none)), toxicity_scores(nothing, labels)):
        assert df.collect() == []


def test_batches_of_written_tables(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    rows = spark.range(0, 2500, 1, 1).mapInArrow(sizes, "n long")
    usual = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r["n"] for r in keep(rows, "few", batch_rows=1000).collect()) == [500, 1000, 1000]
    assert [r["n"] for r in keep(rows, "all").collect()] == [2500]
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == usual


def test_signatures_get_few_texts_at_a_time(spark, monkeypatch):
    """Executor and worker both hold a batch, so it is bounded by the bytes of its texts."""
    folder = tempfile.mkdtemp()
    real = jaccard_join._signature_rows

    def noted(batches, **settings):
        def seen():
            for b in batches:
                with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                    f.write(str(b.nbytes))
                yield b

        yield from real(seen(), **settings)

    monkeypatch.setattr(jaccard_join, "_signature_rows", noted)
    df = spark.range(0, 2000, 1, 1).selectExpr("id AS doc_id", "repeat(concat(id, ' w '), 500) AS text")
    usual = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    assert jaccard_groups(df, k=5, num=80, den=100).count() == 2000
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == usual
    sizes = [int(open(f"{folder}/{n}").read()) for n in os.listdir(folder)]
    assert sum(sizes) > 5_000_000 and max(sizes) < 2 << 20, sizes


def test_drop_rows(spark, docs):
    gone = spark.createDataFrame([(3,), (3,), (7,)], "doc_id long")
    keyed = one_text_per_id(docs)
    left = drop_rows(keyed, gone)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted([*(set(TEXTS) - {3, 7}), 5])
    assert sorted(r["doc_id"] for r in drop_rows(keyed, gone, once=True).collect()) == sorted(
        set(TEXTS) - {3, 7})


