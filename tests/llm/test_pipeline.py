"""The pipeline's stages against plain versions, each on the stage's own input."""

import collections
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from gapwise.llm.toxicity import toxicity_scores

SF_DIR = "/root/testdata/sf0.001"


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def exact_kept(texts):
    groups = collections.defaultdict(list)
    for i, t in texts.items():
        groups[re.sub("[\x20\x09-\x0d]+", "", t or "")].append(i)
    return {min(g, key=lambda i: (-len(texts[i] or ""), i)) for g in groups.values()}


def near_kept(texts):
    sets = {}
    for i, t in texts.items():
        w = re.findall("[^\x20\x09-\x0d]+", fold(t))
        sets[i] = {tuple(w[j:j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    both = collections.Counter((a, b) for own in where.values() for a in own for b in own if a < b)
    for (i, j), n in both.items():
        if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {i for i in texts if find(i) == i}


def clean(texts, items):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = set()
    for t in items:
        w = word.findall(fold(t))
        windows |= {tuple(w[i:i + 13]) for i in range(len(w) - 12)} or ({tuple(w)} if w else set())
    out = set()
    for i, t in texts.items():
        w, hit = word.findall(fold(t)), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if tuple(w[j:j + n]) in windows:
                    hit.update(range(j, j + n))
        if not hit or 20 * len(hit) < len(w):
            out.add(i)
    return out


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    # a repeated row, a copy, null and empty texts, a row without an id
    some = docs.limit(1)
    docs = docs.unionByName(some).unionByName(
        some.withColumn("doc_id", F.lit(90_001))).unionByName(
        some.withColumns({"doc_id": F.lit(90_002), "text": F.lit(None).cast("string")})).unionByName(
        some.withColumns({"doc_id": F.lit(90_003), "text": F.lit("")})).unionByName(
        some.withColumn("doc_id", F.lit(None).cast("long"))).cache()
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]

    def texts(df):
        return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}

    def step(name, df):
        out = dict(corpus_pipeline.STAGES)[name](spark, df, SF_DIR).cache()
        assert out.columns == docs.columns or name == corpus_pipeline.STAGES[-1][0]
        return out

    calm = step("toxicity", docs)
    toxic = {r["doc_id"] for r in toxicity_scores(docs, labels).filter("predicted = 1").collect()}
    assert set(texts(calm)) == {i for i in texts(docs) if i is not None and i not in toxic}
    single = step("exact dedup", calm)
    assert set(texts(single)) == exact_kept(texts(calm))
    assert single.count() == len(texts(single))
    apart = step("n-gram Jaccard join", single)
    assert set(texts(apart)) == near_kept(texts(single))
    free = step("benchmark decontamination", apart)
    assert set(texts(free)) == clean(texts(apart), items)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    coded = {r["doc_id"]: r["n_tokens"] for r in step("BPE encoding and decoding", free).collect()}
    assert coded == {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids)
                     for i, t in texts(free).items()}


def test_texts_that_share_an_id_are_judged_apart(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    found = toxicity_scores(docs, labels)
    toxic, calm = (found.filter(f"predicted = {p}").first()["doc_id"] for p in (1, 0))
    item = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").first()["text"]
    text = {r["doc_id"]: r["text"] for r in docs.filter(docs.doc_id.isin(toxic, calm)).collect()}
    copied = text[calm] + " \n"
    a, b = 900_005, 900_006
    rows = [(a, text[toxic]), (a, text[calm]), (a, text[calm]), (b, copied), (b, item), (b, "short")]
    both = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], docs.schema)

    def left(name, more=None):
        out = dict(corpus_pipeline.STAGES)[name](spark, both if more is None else both.union(more), SF_DIR)
        return sorted((r["doc_id"], r["text"]) for r in out.filter("doc_id >= 900000").collect())

    # With the documents the labels belong to.
    assert left("toxicity", docs) == sorted(r for r in rows if r[1] != text[toxic])
    assert left("exact dedup") == sorted({r for r in rows if r[1] != text[calm]})
    # Which of two texts keeps their id is up to their hash.
    assert left("n-gram Jaccard join") in [
        sorted(r for r in rows if r[1] != gone) for gone in (copied, text[calm])]
    assert left("benchmark decontamination") == sorted(r for r in rows if r[1] != item)


def test_run_applies_all_stages(spark):
    rows = corpus_pipeline.run(spark, SF_DIR)
    assert 0 < rows.count() < 200
    assert rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_registered_once():
    names = [n for n in entry.queries() if n == "pipeline" or re.match(r"op\d+_", n)]
    assert sorted(re.match(r"op(\d+)_|pipeline", n)[1] or "p" for n in names) == sorted(
        [*map(str, range(1, 14)), "p"])


@pytest.mark.parametrize("name", ["op1_warc", "op2_page_text", "op3_toxicity", "op6_repeats",
                                  "op8_chains"])
def test_query_columns(spark, name):
    want = {
        "op1_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
        "op2_page_text": ["page_id", "url", "text", "n_chars"],
        "op3_toxicity": ["doc_id", "held_out", "score", "predicted"],
        "op6_repeats": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        "op8_chains": ["doc_id", "other_id"]}[name]
    assert set(want) <= set(entry.queries()[name](spark, SF_DIR).columns)
