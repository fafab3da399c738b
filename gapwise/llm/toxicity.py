"""A toxicity classifier whose scores do not hang on which group a sentence names.

Logistic regression over words and word beginnings. Labelled texts that mention a group are
also taken with the mention swapped for another group of the same kind (or for none), and
the squared change of the score is added to the loss: a mention then carries no weight of
its own, however often it stands in toxic texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gapwise.llm.shared import TEXT_ROWS, frugal, small_batches, texts
from gapwise.llm.words import ALNUM, _FOLDED_VALUES, chunks, prefix_hashes, span_hash, words

# Identity terms by kind; the last of each kind names no group. Fixed word lists.
IDENTITY = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "religious"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "people"),
    ("black", "white", "asian", "latino", "african", "hispanic", "local"),
    ("gay", "lesbian", "straight", "bisexual", "queer", "homosexual", "heterosexual", "single"),
    ("transgender", "trans", "nonbinary", "cisgender", "adult"),
    ("man", "woman", "person"), ("men", "women", "people"),
    ("boy", "girl", "child"), ("boys", "girls", "children"),
    ("male", "female", "human"),
    ("immigrant", "refugee", "foreigner", "migrant", "citizen"),
    ("immigrants", "refugees", "foreigners", "migrants", "citizens"),
    ("american", "mexican", "chinese", "indian", "russian", "arab", "turkish", "european"),
    ("blind", "deaf", "disabled", "paralyzed", "tall"),
    ("old", "young", "elderly", "new"),
)
# Labelled rows the classifier is fitted on at most: a sample by a hash of the id.
TRAIN_ROWS = 8_000
HELD_OUT = 5
PREFIXES = (4, 5, 6)
# A feature counts if it stands in so many labelled texts and its share differs between the
# classes by so many standard errors.
MIN_TEXTS = 3
MIN_Z = 4.0
RIDGE = 1e-4
COUNTERFACTUAL = 1.0
STEPS = 300
# Texts are taken together up to this many bytes: a worker needs some 30 times as much.
CHUNK_BYTES = 256 << 10

_SWAPS = {term: kind for kind in IDENTITY for term in kind[:-1]}
_MENTION = re.compile(r"(?<![A-Za-z])(?:" + "|".join(sorted(_SWAPS, key=len, reverse=True))
                      + r")(?![A-Za-z])", re.IGNORECASE)


def swapped(text: str, shift: int) -> str | None:
    """``text`` with every group mention replaced by the one ``shift`` places on in its
    kind; ``None`` without any mention."""
    def other(m):
        kind = _SWAPS[m[0].lower()]
        at = kind.index(m[0].lower())
        return kind[(at + 1 + shift % (len(kind) - 1)) % len(kind)]

    out, n = _MENTION.subn(other, text)
    return out if n else None


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document number, feature), distinct, in order: a 32-bit hash of every word and of
    the beginnings of longer words."""
    doc, start, end, whole = words(data, offsets, ALNUM)
    if not len(doc):
        return doc, np.empty(0, np.int64)
    sums = prefix_hashes(data, _FOLDED_VALUES)
    docs, values = [doc], [whole]
    for n in PREFIXES:
        long = np.flatnonzero(end - start > n)
        docs.append(doc[long])
        values.append(span_hash(sums, start[long], start[long] + n) + np.uint64(n))
    doc = np.concatenate(docs)
    code = np.unique(doc.astype(np.uint64) << np.uint64(32)
                     | np.concatenate(values) >> np.uint64(32))
    return (code >> np.uint64(32)).astype(np.int64), (code & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _lists(of: np.ndarray, value: np.ndarray, n: int) -> pa.Array:
    """Features by document, in the four bytes they have."""
    edge = np.searchsorted(of, np.arange(n + 1))
    return pa.ListArray.from_arrays(
        pa.array(edge, pa.int32()), pa.array(value.astype(np.uint32).view(np.int32)))


def _values(part: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(features, number of them by document) of a piece of a list column."""
    edge = part.offsets.to_numpy()
    value = part.values.to_numpy()[edge[0]:edge[-1]]
    return value.view(np.uint32).astype(np.int64), np.diff(edge)


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled texts as features, with those of a swapped copy where a group is named."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column("text").to_pylist()
        ids = batch.column("doc_id").to_pylist()
        copy = [swapped(t, i) for i, t in zip(ids, text)]
        out = []
        for column in (text, [c if c is not None else "" for c in copy]):
            parts = []
            one = pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(column, pa.large_string())], ["doc_id", "text"])
            for own, data, offsets in chunks([one], CHUNK_BYTES):
                parts.append(_lists(*features(data, offsets), len(own)))
            out.append(pa.concat_arrays(parts))
        out.append(pa.array([c is not None for c in copy]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("toxic"), *out], ["toxic", "own", "other", "swapped"])


class Model:
    """Weights of features in order of their hash, and the bias."""

    def __init__(self, codes, weights, bias):
        self.codes, self.weights, self.bias = codes, weights, float(bias)

    def scores(self, of: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
        total = np.full(n, self.bias)
        if len(self.codes) and len(code):
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            hit = self.codes[at] == code
            total += np.bincount(of[hit], weights=self.weights[at[hit]], minlength=n)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _sparse(lists: pa.ChunkedArray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the chosen features."""
    rows, columns, at = [], [], 0
    for part in lists.chunks:
        value, sizes = _values(part)
        row = at + np.repeat(np.arange(len(part)), sizes)
        at += len(part)
        place = np.minimum(np.searchsorted(codes, value), max(len(codes) - 1, 0))
        hit = codes[place] == value if len(codes) else np.zeros(len(value), bool)
        rows.append(row[hit])
        columns.append(place[hit])
    return np.concatenate(rows), np.concatenate(columns)


def fit(table: pa.Table) -> Model:
    """Fit on rows (toxic, own, other, swapped) by gradient steps with momentum."""
    y = table["toxic"].to_numpy().astype(np.float64)
    n, n_pos = len(y), y.sum()
    if n == 0 or n_pos in (0, n):
        # one class only: nothing to tell apart, the share of toxic rows is the score
        return Model(np.empty(0, np.int64), np.empty(0), np.log((n_pos + 1) / (n - n_pos + 1)))
    seen, marks = [], []
    at = 0
    for part in table["own"].chunks:
        value, sizes = _values(part)
        label = np.repeat(y[at:at + len(part)], sizes)
        at += len(part)
        seen.append(value)
        marks.append(label)
    value, label = np.concatenate(seen), np.concatenate(marks)
    codes, inverse = np.unique(value, return_inverse=True)
    total = np.bincount(inverse, minlength=len(codes)).astype(np.float64)
    pos = np.bincount(inverse, weights=label, minlength=len(codes))
    share = total / n
    z = (pos / n_pos - (total - pos) / (n - n_pos)) / np.sqrt(
        share * (1 - share) * (1 / n_pos + 1 / (n - n_pos)) + 1e-12)
    pick = (total >= MIN_TEXTS) & (np.abs(z) >= MIN_Z)
    codes, total, pos = codes[pick], total[pick], pos[pick]
    if not len(codes):
        return Model(codes, np.empty(0), np.log((n_pos + 1) / (n - n_pos + 1)))
    # features are scaled by how much rarer they are in the other class
    scale = np.abs(np.log((pos + 1) / (n_pos + 2)) - np.log((total - pos + 1) / (n - n_pos + 2)))
    row, col = _sparse(table["own"], codes)
    row2, col2 = _sparse(table["other"], codes)
    pairs = np.flatnonzero(table["swapped"].to_numpy())
    is_pair = np.zeros(n, bool)
    is_pair[pairs] = True
    mine = is_pair[row]
    w, bias = np.zeros(len(codes)), np.log(n_pos / (n - n_pos))
    speed, bias_speed = np.zeros(len(codes)), 0.0
    g2, b2 = np.full(len(codes), 1e-8), 1e-8
    for _ in range(STEPS):
        logit = bias + np.bincount(row, weights=(w * scale)[col], minlength=n)
        error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / n
        grad = np.bincount(col, weights=error[row], minlength=len(codes)) * scale
        if len(pairs):
            change = (np.bincount(row[mine], weights=(w * scale)[col[mine]], minlength=n)
                      - np.bincount(row2, weights=(w * scale)[col2], minlength=n)) * is_pair
            change *= 2 * COUNTERFACTUAL / len(pairs)
            grad += scale * (np.bincount(col[mine], weights=change[row[mine]], minlength=len(codes))
                             - np.bincount(col2, weights=change[row2], minlength=len(codes)))
        grad += RIDGE * w
        g2 += grad ** 2
        b2 += error.sum() ** 2
        speed = 0.9 * speed - 0.1 * grad / np.sqrt(g2)
        bias_speed = 0.9 * bias_speed - 0.1 * error.sum() / np.sqrt(b2)
        w, bias = w + speed, bias + bias_speed
    return Model(codes, w * scale, bias)


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for ids, data, offsets in chunks(batches, CHUNK_BYTES):
        score = model.value.scores(*features(data, offsets), len(ids))
        yield pa.RecordBatch.from_pydict({"doc_id": ids, "score": score})


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic",
          train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text",
          label_id_col: str | None = None) -> Model:
    """Fit on at most ``train_rows`` labelled documents outside the held-out fold, chosen by
    a hash of the id, which labels have in ``label_id_col`` (default: that of the documents).
    Labels other than 0 and 1 are not used."""
    known = labels.select(F.col(f"`{label_id_col or id_col}`").cast("long").alias("doc_id"),
                          F.col(f"`{label_col}`").alias("toxic")).filter(
        "doc_id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out("doc_id"))
    # Without the text, and never more rows than asked for.
    chosen = known.groupBy("doc_id").agg(F.max("toxic").cast("double").alias("toxic")).orderBy(
        F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    rows = texts(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")
    with small_batches(docs.sparkSession, TEXT_ROWS):
        table = rows.mapInArrow(
            frugal(_training_rows),
            "toxic double, own array<int>, other array<int>, swapped boolean").toArrow()
    return fit(table)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(f"`{id_col}`").cast("string")) % HELD_OUT == 0


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                    text_col: str = "text", **settings) -> DataFrame:
    """Score every text: doc_id, held_out, score (0 to 1), predicted (1 from a score of 0.5).

    Only text is an input of the score. A null text is empty; an empty text gets the score
    of a text without any known feature. Without labels of both kinds every score is the
    smoothed share of toxic labels. Repeated rows are scored each; rows without an id are
    left out, other columns are not read; an empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(
        train(docs, labels, id_col=id_col, text_col=text_col, **settings))
    found = texts(docs, id_col, text_col).mapInArrow(
        frugal(partial(_score, model=model)), "doc_id long, score double")
    return found.select("doc_id", held_out().alias("held_out"), "score",
                        (F.col("score") >= 0.5).cast("int").alias("predicted"))
