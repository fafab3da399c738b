"""Exact duplicates by sorting contents.

Rows are dealt out by sampled splitters over (first bytes of the normalised text, digest,
id), so equal texts lie next to each other in one range or in adjoining ranges: a text that
a third of all rows hold is spread over many. Every range is sorted outside memory where
needed and neighbours are compared in full. Runs inside a range are decided there; the two
runs at its borders are merged over all ranges by a second full comparison, at most two
rows per range.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from gapwise.llm.shared import frugal, keep, texts

SPACE = "[\\x20\\x09-\\x0D]+"
PREFIX = 24

_SCHEMA = ("doc_id long, n_chars long, text_sha256 string, run string, "
           "keep_id long, group_size long, first boolean, edge_text string")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows in, one row out per row. Rows of a range's first and last run get the
    name of the run instead of a decision; the first of them carries the text."""
    part = TaskContext.get().partitionId()
    held, number = None, 0

    def close(rows, run, edge):
        rows["ids"] += run["ids"]
        rows["chars"] += run["chars"]
        rows["sizes"].append(sum(map(len, run["ids"])))
        rows["keep"].append(run["ids"][0][0])
        rows["sha"].append(hashlib.sha256(run["norm"].encode()).hexdigest())
        rows["run"].append(f"{part}-{run['number']}" if edge else None)
        rows["norm"].append(run["norm"] if edge else None)

    def batch_of(rows):
        sizes = np.array(rows["sizes"])
        of = np.repeat(np.arange(len(sizes)), sizes)
        first = np.ones(len(of), bool)
        first[1:] = of[1:] != of[:-1]
        text = pa.array(rows["norm"], pa.string()).take(
            pa.array(of, mask=~first))
        return pa.RecordBatch.from_pydict({
            "doc_id": np.concatenate(rows["ids"]), "n_chars": np.concatenate(rows["chars"]),
            "text_sha256": pa.array(rows["sha"], pa.string()).take(pa.array(of)),
            "run": pa.array(rows["run"], pa.string()).take(pa.array(of)),
            "keep_id": np.array(rows["keep"], np.int64)[of],
            "group_size": sizes[of].astype(np.int64), "first": first, "edge_text": text})

    def empty():
        return {k: [] for k in ("ids", "chars", "sizes", "keep", "sha", "run", "norm")}

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        norm = batch.column("norm")
        ids, chars = (batch.column(c).to_numpy(zero_copy_only=False)
                      for c in ("doc_id", "n_chars"))
        new = np.ones(n, bool)
        if n > 1:
            new[1:] = pc.not_equal(norm[1:], norm[:-1]).to_numpy(zero_copy_only=False)
        starts = np.append(np.flatnonzero(new), n)
        rows = empty()
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            value = norm[a].as_py()
            if held is not None and held["norm"] == value:
                held["ids"].append(ids[a:b])
                held["chars"].append(chars[a:b])
                continue
            if held is not None:
                close(rows, held, held["number"] == 0)
            held = {"ids": [ids[a:b]], "chars": [chars[a:b]], "norm": value, "number": number}
            number += 1
        if rows["sizes"]:
            yield batch_of(rows)
    if held is not None:
        rows = empty()
        close(rows, held, True)
        yield batch_of(rows)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
                     ) -> DataFrame:
    """The group of equal texts that every row belongs to.

    Texts are equal when identical after deleting space, tab and line ends; a null text is
    empty, and empty texts are one group. Of a group the row with the most code points
    stays, then the one with the smallest id; of several such rows with the same id, one.
    Rows without an id are left out. Other columns are not read. An empty table gives an
    empty result. Columns: doc_id, keep_id, group_size, kept, text_sha256 (of the
    normalised text).
    """
    norm = F.regexp_replace("text", SPACE, "")
    rows = texts(docs, id_col, text_col).select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), norm.alias("norm"))
    rows = rows.withColumns({"head": F.substring("norm", 1, PREFIX), "digest": F.xxhash64("norm")})
    sorted_rows = rows.repartitionByRange("head", "digest", "doc_id").sortWithinPartitions(
        "head", "digest", "norm", F.desc("n_chars"), "doc_id")
    found = keep(sorted_rows.select("doc_id", "n_chars", "norm").mapInArrow(frugal(_runs), _SCHEMA),
                 "sorted")
    heads = keep(found.filter(F.col("edge_text").isNotNull()), "borders")
    best = F.min(F.struct((-F.col("n_chars")).alias("c"), F.col("keep_id").alias("id"), "run"))
    merged = heads.groupBy("edge_text").agg(
        F.collect_list("run").alias("runs"), best.alias("best"), F.sum("group_size").alias("n"))
    border = merged.select(F.explode("runs").alias("run"), F.col("best.id").alias("border_id"),
                           F.col("best.run").alias("border_run"), F.col("n").alias("border_n"))
    # At most two rows for every range of the sort.
    joined = found.filter(F.col("run").isNotNull()).join(F.broadcast(border), "run")
    names = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    edges = joined.select(
        "doc_id", F.col("border_id").alias("keep_id"), F.col("border_n").alias("group_size"),
        (F.col("first") & (F.col("run") == F.col("border_run"))).alias("kept"), "text_sha256")
    inside = found.filter(F.col("run").isNull()).withColumn("kept", F.col("first"))
    return inside.select(*names).unionByName(edges.select(*names))
