"""The parts of the text operators that need no session, against plain versions."""

import collections
import random
import tracemalloc
import types

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from gapwise.llm import chains, fm_index, jaccard_join, page_text, repeats, simple8b, toxicity, units, warc
from gapwise.llm.bpe import Vocabulary, coder, encoded
from gapwise.llm.shared import frugal
from gapwise.llm.token_files import library_coder
from gapwise.llm.words import NOT_SPACE, chunks, words

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "b", " ", "  ", "\n", "\t", "é", " ", "　", " ", "'s", "'t", "'", "1",
          "!", ",", ".", "<|endoftext|>", "<|", "the", "ing", "\x1c", "\u0085", "aaaa", "日本",
          "😀", "\r\n", "\x00", "İ", "…"]


def batch(texts):
    return pa.RecordBatch.from_arrays(
        [pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@pytest.mark.parametrize("limit", [64, 1 << 20])
def test_both_encoders_equal_the_library(library, limit):
    rng = random.Random(1)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40))) for _ in range(800)]
    texts += ["", "a" * 2000, " " * 300, None]
    with open(PATH, encoding="utf-8") as f:
        text = f.read()
    vocabulary, own = coder(text)
    for pieces in (own, library_coder(text)):
        for ids, data, offsets in chunks([batch(texts)], limit):
            flat, ends = pieces.ids(data, offsets)
            for i, a, b in zip(ids, ends[:-1], ends[1:]):
                want = library.encode(texts[i] or "", add_special_tokens=False).ids
                assert flat[a:b].tolist() == want, texts[i]
                assert vocabulary.decode(flat[a:b]) == library.decode(
                    want, skip_special_tokens=False)


def test_used_pieces_are_encoded_once(monkeypatch):
    """A full store forgets pieces, but not those of several calls."""
    monkeypatch.setattr(units, "KEPT_PIECES", 30)
    asked = collections.Counter()

    def encode(pieces):
        asked.update(pieces)
        return (np.concatenate([np.frombuffer(p, np.uint8) for p in pieces]).astype(np.int64),
                np.array([len(p) for p in pieces]))

    store = units.PieceIds(encode)
    for i in range(40):
        text = "often again " + " ".join(f"new{i}x{j}" for j in range(9))
        for _, data, offsets in chunks([batch([text, "", text])]):
            flat, ends = store.ids(data, offsets)
            assert flat.astype(np.uint8).tobytes().decode() == 2 * text
            assert ends.tolist() == [0, len(text), len(text), 2 * len(text)]
        assert len(store.pieces) == len(store.sizes) == len(store.uses) <= 30
    assert asked[b" again"] == asked[b"often"] == 1


def test_encoding_holds_one_chunk():
    """Memory follows the chunk, not the batch."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("etaoinshr") + rng.choice(["", "", " "]) for _ in range(12_000))
             for _ in range(400)]
    with open(PATH, encoding="utf-8") as f:
        text = f.read()
    coder.cache_clear()
    coder(text)
    rows = batch(texts)
    tracemalloc.start()
    try:
        ids = [len(ids) for ids, _, _ in encoded(text, iter([rows]))]
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        coder.cache_clear()
    assert sum(ids) == 400 and rows.nbytes > 6 << 20
    assert most < 160 << 20, most


def test_scoring_holds_one_chunk():
    """Memory follows the chunk, not the batch."""
    text = "some words of a text that is neither long nor short " * 40
    rows = batch([f"{text}{i}" for i in range(1000)])
    model = types.SimpleNamespace(
        value=toxicity.Model(np.arange(5, dtype=np.int64), np.ones(5), 0.0))
    tracemalloc.start()
    try:
        scored = sum(b.num_rows for b in toxicity._score(iter([rows]), model))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert scored == 1000 and rows.nbytes > 2_000_000
    assert most < 30 << 20, most


def test_caches_go_when_a_worker_gets_other_work():
    with open(PATH, encoding="utf-8") as f:
        text = f.read()

    def encode(batches):
        for ids, _, _ in encoded(text, batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids)], ["doc_id"])

    def other(batches):
        yield pa.RecordBatch.from_arrays([pa.array([coder.cache_info().currsize])], ["n"])

    coder.cache_clear()
    task, rows = frugal(encode, keeps=coder), batch(["one text"])
    for _ in range(2):
        assert sum(b.num_rows for b in task(iter([rows]))) == 1
    # the next task of the same function finds what the first one has read
    assert coder.cache_info().misses == 1
    assert [b["n"][0].as_py() for b in frugal(other)(iter([rows]))] == [0]


def test_vocabulary_refuses_merges_out_of_order():
    import json

    letters = {c: i for i, c in enumerate(__import__(
        "gapwise.llm.bpe", fromlist=["x"]).byte_letters())}
    vocab = {**letters, "ab": 256, "abc": 257}
    spec = {"model": {"vocab": vocab, "merges": ["ab c", "a b"]}, "added_tokens": []}
    with pytest.raises(ValueError):
        Vocabulary(json.dumps(spec))


def test_search_holds_one_shard():
    """Memory follows the shard, not the batch."""
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["ab", "cde", "f", "ghij"]) for _ in range(3000)) for _ in range(400)]
    item = " ".join(texts[7].split()[100:113])
    number = {w: int(h) for w, h in zip(item.split(), words(
        np.frombuffer(item.encode(), np.uint8), np.array([0, len(item)]), fm_index.ALNUM)[3].view(np.int64))}
    phrases = fm_index.Phrases([([1], [number[w] for w in item.split()])])
    rows = batch(texts)
    tracemalloc.start()
    try:
        found = pa.Table.from_batches(fm_index._search(iter([rows]), phrases))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found["doc_id"].to_pylist() == list(range(400))
    assert found["n_words"].to_pylist() == [3000] * 400
    assert found["n_hit"][7].as_py() >= 13 and rows.nbytes > 3 << 20
    assert most < 80 << 20, most


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2 ** 64 - 1)),
                max_size=300), st.integers(0, 6000))
def test_simple8b_round_trip(values, zeros):
    values = np.array(values + [0] * zeros + values, np.uint64)
    packed, per_block, escaped = simple8b.encode(values)
    sizes = np.array([min(simple8b.BLOCK, len(values) - i)
                      for i in range(0, len(values), simple8b.BLOCK)], np.int64)
    assert simple8b.decode(packed, per_block, sizes, escaped).tolist() == values.tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=60),
       st.lists(st.lists(st.integers(1, 5), min_size=1, max_size=4), min_size=1, max_size=6))
def test_fm_index_finds_every_place(values, patterns):
    values = np.array(values)
    index = fm_index.FMIndex(values)
    width = max(map(len, patterns))
    table = np.array([[0] * (width - len(p)) + p for p in patterns])
    low, high = index.search(table, np.array([len(p) for p in patterns]))
    for p, a, b in zip(patterns, low, high):
        want = [i for i in range(len(values)) if values[i:i + len(p)].tolist() == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=80))
def test_suffix_order(values):
    order = fm_index.suffix_order(np.array(values)).tolist()
    assert order == sorted(range(len(values)), key=lambda i: values[i:])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 4), st.text("ab", min_size=6,
                                                                       max_size=14)),
                min_size=1, max_size=12))
def test_columns_find_repeated_windows(rows):
    """Windows of five bytes, at the same distance from the anchor of the same group."""
    rows.sort()
    group = np.array([r[0] for r in rows])
    lead, bodies = np.array([r[1] for r in rows]), [r[2].encode() for r in rows]
    starts = np.array([len(b) - 4 for b in bodies])
    which, start = repeats.repeated_starts(bodies, group, lead, starts, 5)
    seen = collections.Counter(
        (g, i - le, b[i:i + 5]) for g, le, b in zip(group, lead, bodies) for i in range(len(b) - 4))
    want = {(n, i) for n, (g, le, b) in enumerate(zip(group, lead, bodies))
            for i in range(len(b) - 4) if seen[g, i - le, b[i:i + 5]] > 1}
    assert set(zip(which.tolist(), start.tolist())) == want


def test_block_without_repeats():
    bodies = [b"abcdefgh", b"abzzefgh", b"qwertyui"]
    table = pa.table({"seed": [1, 1, 2], "doc_id": [1, 2, 3], "at": [0, 0, 0], "lead": [0, 0, 0],
                      "n_starts": [5, 5, 5], "body": bodies})
    assert list(repeats._build_up(iter(table.to_batches()), 4)) != []
    assert list(repeats._build_up(iter(table.to_batches()), 5)) == []
    none = np.empty(0, np.int64)
    assert list(repeats._ranges(none, none)) == []


def test_every_window_start_has_one_anchor():
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab ") for _ in range(rng.randint(0, 90))) for _ in range(40)]
    for _, data, offsets in chunks([batch(texts + ["a" * 60])]):
        doc, at, n, lead, _, _ = repeats.anchors(data, offsets, 20, 6)
        starts = [(d, a - offsets[d] + i) for d, a, m in zip(doc, at, n) for i in range(m)]
        assert sorted(starts) == [(d, i) for d, t in enumerate([*texts, "a" * 60])
                                  for i in range(len(t.encode()) - 19)]
        assert ((lead >= 0) & (lead <= 14 + n)).all()


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(3)
    bands = jaccard_join.Bands(80, 100)
    for size in [*range(1, 40), 100, 333, 1200]:
        for _ in range(6):
            a = np.unique(rng.integers(1, 1 << 62, size, dtype=np.uint64))
            b = list(a)
            while True:
                c = b[:-1] if rng.random() < 0.5 else b + [np.uint64(rng.integers(1, 1 << 62))]
                if 100 * len(set(a) & set(c)) < 80 * len(set(a) | set(c)) or len(c) > 2 * len(a):
                    break
                b = c
                rng.shuffle(b)
            b = np.unique(np.array(b, np.uint64))
            if np.array_equal(a, b):
                continue
            of = np.repeat([0, 1], [len(a), len(b)])
            doc, sig = jaccard_join.signatures(of, np.concatenate([a, b]), 2, bands)
            assert set(sig[doc == 0]) & set(sig[doc == 1]), (len(a), len(b))


def test_sketches_are_small_and_rule_out_nothing_similar():
    rng = np.random.default_rng(5)
    for size in (3, 64, 65, 500, 1000, 1100):
        a = rng.integers(1, 1 << 62, size, dtype=np.uint64)
        b = np.concatenate([a[:size - size // 10], rng.integers(1, 1 << 62, size // 7 + 1, dtype=np.uint64)])
        c = rng.integers(1, 1 << 62, size, dtype=np.uint64)
        sketches = jaccard_join._sketches(
            np.repeat([0, 1, 2], [len(a), len(b), len(c)]), np.concatenate([a, b, c]), 3).to_pylist()
        assert all(len(s) <= max(16, n / 4) for s, n in zip(sketches, map(len, (a, b, c))))
        sizes = [len(a), len(b), len(c)]
        i, j = [0, 0, 1], [1, 2, 2]
        rows = pa.RecordBatch.from_pydict({
            "a": i, "b": j, "sa": [sketches[x] for x in i], "sb": [sketches[x] for x in j],
            "na": [sizes[x] for x in i], "nb": [sizes[x] for x in j]})
        same = size - size // 10
        similar = 100 * same >= 70 * (len(a) + len(b) - same)
        left = [tuple(r.values()) for r in next(jaccard_join._may_be_similar(iter([rows]), 70, 100)).to_pylist()]
        assert not similar or (0, 1) in left
        assert size < 64 or left == [(0, 1)]


def test_members_meet_within_their_signature():
    rng = np.random.default_rng(6)
    base = rng.integers(1, 1 << 62, 300, dtype=np.uint64)
    sets = [np.append(base[i:], rng.integers(1, 1 << 62, 7 * i, dtype=np.uint64)) for i in range(8)]
    sketches = jaccard_join._sketches(
        np.repeat(range(8), [len(s) for s in sets]), np.concatenate(sets), 8).to_pylist()

    def rows(sig, p, q, members):
        return [dict(sig=sig, p=p, q=q, block=i % 2 if p != q else p, rep=i, label=i // 2,
                     n_shingles=len(sets[i]), sketch=sketches[i]) for i in members]

    def pairs(rows):
        table = pa.Table.from_pylist(rows)
        out = jaccard_join._compare_blocks(iter(table.to_batches(max_chunksize=3)), 80, 100)
        return {(r["a"], r["b"]) for b in out for r in b.to_pylist()}

    assert pairs(rows(1, 0, 0, [0, 1, 3]) + rows(2, 0, 0, [4, 2, 5])) == {(0, 3), (1, 3), (2, 4), (2, 5)}
    assert pairs(rows(1, 0, 1, range(5))) == {(0, 3), (1, 2), (1, 4), (3, 4)}


def test_thinned_matches_make_the_same_segments():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, x, b, y = np.unique(np.stack([rng.integers(i, j, 400) for i, j in (
            (1, 3), (0, 90), (3, 5), (0, 90))]), axis=1)
        order = np.lexsort((x, y - x, b, a))
        whole = chains.pa.RecordBatch.from_arrays(
            [chains.pa.array(c[order]) for c in (a, x, b, y)], ["a", "pa", "b", "pb"])
        got = [[t.to_pydict() for t in chains._chains(iter([m]), 5, 20)]
               for m in (whole, chains._thinned(a, x, b, y, 5))]
        assert got[0] == got[1]
    x = np.arange(400)
    assert chains._thinned(0 * x + 1, x, 0 * x + 2, x + 3, 5).num_rows < 70


def test_chains_are_collinear():
    assert chains.chain([(0, 0, 10)], 4) == [[0]]
    assert chains.chain([(0, 0, 10), (12, 12, 10), (12, 40, 9), (30, 33, 12)], 4) == [[0, 1, 3], [2]]
    rng = random.Random(2)
    for _ in range(100):
        segments = sorted((rng.randint(0, 60), rng.randint(0, 60), rng.randint(5, 9))
                          for _ in range(rng.randint(2, 12)))
        best = []
        for i, (x, y, size) in enumerate(segments):
            best.append(max([size, *(
                best[j] + size - chains.GAP_COST * (x + y - a - b - 2 * s)
                for j, (a, b, s) in enumerate(segments[:i])
                if a + s - 4 <= x and b + s - 4 <= y and (a, b, s) < (x, y, size))]))
        got = chains.chain(segments, 4)
        assert sorted(i for c in got for i in c) == list(range(len(segments)))
        total = sum(segments[i][2] for i in got[0]) - chains.GAP_COST * sum(
            segments[j][0] + segments[j][1] - sum(segments[i][:2]) - 2 * segments[i][2]
            for i, j in zip(got[0], got[0][1:]))
        assert total == pytest.approx(max(best))


def test_alignment_spans_edits():
    x = np.arange(100, 200)
    y = np.concatenate([np.arange(30), x[10:40], [1], x[41:60], [2, 3], x[60:90]])
    got = chains.align(x, y, [(15, 35, 20), (45, 65, 10), (65, 87, 20)])
    assert got[:4] == (10, 90, 30, 112)
    assert got[4] == 79


@pytest.mark.parametrize("split", [50, 333, 4096, 10 ** 9])
def test_ranges_own_every_record_once(split):
    rng = random.Random(1)
    body = [bytes(rng.choice(b"ab<>") for _ in range(rng.randint(0, 3000))) for _ in range(40)]
    body[3] = b"x" * 200_000
    body[5] = warc.page_record(9, None, b"inner", "d", None) * 3
    data = b"".join(warc.page_record(i, f"http://h/{i}", b, "d", None) for i, b in enumerate(body))

    class File:
        def size(self):
            return len(data)

        def read_at(self, n, at):
            return data[at:at + n]

    got = []
    for start in range(0, len(data), split):
        end = min(start + split, len(data))
        for head, block in warc.members(warc._Bytes(File(), start, end), start, end):
            got.append((head["warc-record-id"], warc.parse_headers(block)[1]))
    assert got == [(f"<urn:x-page:{i}>", b) for i, b in enumerate(body)]


def test_page_blocks():
    page = """<html><head><title>x</title></head><body class="no-ads"><nav><ul><li>a</ul></nav>
      <div class="ad">buy</div><article><header><h1>T &amp; x</h1></header><p><b>One<br>two<p>three
      <div class="share">Share</div><script>var x="<p>no"</script><!-- c -->
      <section id="comments"><p>hi</p></section><p>four&nbsp;
      five</article><footer>&copy; z</footer></body></html>"""
    assert page_text.page_blocks(page)[0] == ["T & x", "One two", "three", "four five"]
    assert page_text.page_blocks("<body><div>intro</div><p>para<ul><li>a</li></ul><nav>menu")[
        :2] == ([], ["intro", "para", "a"])
    assert page_text.page_blocks("<nav>x<article><p>y")[0] == ["y"]
    assert page_text.page_blocks("a < b &lt; c")[1] == ["a < b < c"]
    assert page_text.page_blocks("") == ([], [], [])
    assert page_text.page_blocks("<article><p>a <a hre")[0] == ["a"]


def test_formulas_and_elements_without_an_end():
    blocks = page_text.page_blocks
    formula = "<math><mi>E</mi> <mo>=</mo> <msup><mi>c</mi><mn>2</mn></msup></math>"
    assert blocks(f"<article><p>Here {formula} holds.</p><p>b</p></article>")[0] == [
        "Here E = c2 holds.", "b"]
    for lost in ("<svg><path d='x'>", "<select><option>x", "<template><b>x", "<noscript>x"):
        page = f"<article><p>one {lost}</p><p>two</p></article>"
        assert blocks(page)[0] == ["one", "two"], page
    for gone in ("<svg><text>x</text></svg>", "<select><option>x</select>", "<script>if (a<b) x</script>",
                 "<style>p > a {}</style>", "<noscript>x <img src=y></noscript>", "<textarea><p>x</textarea>"):
        page = f"<article><p>one {gone}</p><p>two</p></article>"
        assert blocks(page)[0] == ["one", "two"], page


def test_classes_of_states_and_sentences():
    blocks = page_text.page_blocks
    for page in ('<div class="layout has-sidebar"><article><p>story</p></article></div>',
                 '<div class="no-comments"><main><p>story</p></main></div>',
                 '<article><p class="notice-period">story</p></article>',
                 '<body class="with-cookie-banner"><article><p>story</p></article></body>'):
        assert blocks(page)[0] == ["story"], page
    for page in ('<article><div class="cookie-notice">x</div><p>story</p></article>',
                 '<article><p class="ad">x</p><p>story</p></article>',
                 '<article><p>story</p><ul id="comments-list"><li>x</ul></article>'):
        assert blocks(page)[0] == ["story"], page


def test_covered_tokens():
    tokens, page = [], []
    shared = list(range(100, 110))
    for i in range(4):
        own = [i * 10, i * 10 + 1, *shared, i * 10 + 2, -1 - i]
        tokens += own
        page += [i] * len(own)
    hit = page_text.covered(np.array(tokens), np.array(page), 8, 3)
    assert [t for t, h in zip(tokens, hit) if h] == shared * 4
    assert not page_text.covered(np.array(tokens), np.array(page), 8, 5).any()
    assert not page_text.covered(np.array(tokens), np.array(page), 12, 2).any()


def test_swapped_mentions():
    assert toxicity.swapped("no mention here", 0) is None
    out = toxicity.swapped("The Muslim woman", 0)
    assert out == "The christian person"
    assert toxicity.swapped("womanly", 3) is None


def test_mentions_carry_no_weight():
    """A term that stands in most toxic texts decides nothing once it may be swapped."""
    rng = random.Random(0)

    def table(with_swaps):
        rows = []
        for i in range(600):
            toxic = i % 2
            text = " ".join(rng.choice("xyzuvw") * 3 for _ in range(8))
            text += " idiot" if toxic and rng.random() < 0.8 else ""
            text += " muslim" if rng.random() < (0.8 if toxic else 0.1) else ""
            rows.append((float(toxic), text))
        copies = [toxicity.swapped(t, i) for i, (_, t) in enumerate(rows)]
        lists = []
        for column in ([t for _, t in rows], [c or "" for c in copies]):
            (_, data, offsets), = chunks([batch(column)])
            lists.append(toxicity._lists(*toxicity.features(data, offsets), len(column)))
        return pa.table({"toxic": [y for y, _ in rows], "own": lists[0], "other": lists[1],
                         "swapped": [c is not None and with_swaps for c in copies]})

    def score(model, text):
        (_, data, offsets), = chunks([batch([text])])
        return model.scores(*toxicity.features(data, offsets), 1)[0]

    plain, regular = toxicity.fit(table(False)), toxicity.fit(table(True))
    neutral = "xxx yyy a muslim neighbour zzz"
    assert score(plain, neutral) > 0.5 > score(regular, neutral)
    assert score(regular, "xxx yyy idiot zzz") > 0.5


def test_words_fold_only_ascii():
    (_, data, offsets), = chunks([batch(["Ab aB", "É é", "", None, "x\x0bY"])])
    doc, start, end, hashes = words(data, offsets, NOT_SPACE)
    assert doc.tolist() == [0, 0, 1, 1, 4, 4]
    assert hashes[0] == hashes[1] and hashes[2] != hashes[3]
