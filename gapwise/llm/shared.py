"""Tables in the shared folder, row filters by id, and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from gapwise.llm import words
from gapwise.plans.sizing import broadcast_if_small
from gapwise.session import shared_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the folder that all executors share."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


# Rows that go to a worker at a time where rows carry whole texts, and bytes of them where
# other rows of the same job are short.
TEXT_ROWS = 1_000
TEXT_BYTES = 1 << 20
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def keep(df: DataFrame, name: str, batch_rows: int | None = None,
         batch_bytes: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lost executor repeats nothing
    that lies before it, and the parts of the plan behind it are planned on real sizes.
    Arrow functions in it get at most ``batch_rows`` rows or some ``batch_bytes`` bytes at a
    time: executor and worker both hold a whole batch."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with small_batches(spark, batch_rows, batch_bytes):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession, batch_rows: int | None = None,
                  batch_bytes: int | None = None) -> Iterator[None]:
    """Arrow functions of what runs inside get so much at a time."""
    usual = {key: spark.conf.get(key) for key in (_ROWS, _BYTES)}
    if batch_rows is not None:
        most = int(usual[_ROWS])
        spark.conf.set(_ROWS, min(batch_rows, most) if most > 0 else batch_rows)
    if batch_bytes is not None:
        spark.conf.set(_BYTES, batch_bytes)
    try:
        yield
    finally:
        for key, value in usual.items():
            spark.conf.set(key, value)


# Functions whose cache lasts in this worker from task to task.
_lasting: list[Callable] = []


def only_keep(cached: Callable | None) -> None:
    """Empty the caches that tasks of other functions have left in this worker."""
    if any(other is not cached for other in _lasting):
        for other in _lasting:
            if other is not cached:
                other.cache_clear()
        _lasting.clear()
        gc.collect()
        give_back()
    if cached is not None and cached not in _lasting:
        _lasting.append(cached)


def frugal(fn: Callable[..., Iterator[pa.RecordBatch]], keeps: Callable | None = None
           ) -> Callable[..., Iterator[pa.RecordBatch]]:
    """An Arrow function whose worker returns the memory it freed when it ends. Workers live
    on between stages, and what one keeps for itself is missing for those beside it. Only the
    cache of ``keeps`` lasts, until the worker gets a task of another frugal function."""
    def run(batches):
        only_keep(keeps)
        try:
            yield from fn(batches)
        finally:
            words._powers.clear()
            gc.collect()
            give_back()

    return run


def give_back() -> None:
    """Return freed memory of this process to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        # Where the C library has it.
        ctypes.CDLL(None).malloc_trim(0)


def filesystem(uri: str):
    """The file system of a shared folder and the path in it, for use inside tasks."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return pafs.FileSystem.from_uri(uri)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, under fixed names. Rows without an id cannot be
    named in a result and are left out; a missing text counts as empty."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
                       ).filter(F.col("doc_id").isNotNull())


def keep_rows(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``doc_id`` is in the written table ``ids``. The ids are
    broadcast only if counting proves them few."""
    return docs.join(broadcast_if_small(ids.select("doc_id")), "doc_id", "left_semi").select(
        *[F.col(f"`{c}`") for c in docs.columns])


def one_text_per_id(docs: DataFrame) -> DataFrame:
    """``docs`` with a column ``row_key`` that operators can take as the id: the doc_id, but
    where several texts share one, only the first by hash keeps it and the others get a number
    of their own beyond all ids. Rows without an id, which no operator can judge, go."""
    docs = docs.filter(F.col("doc_id").isNotNull())
    again = keep(docs.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "again")
    if again.isEmpty():
        return docs.withColumn("row_key", F.col("doc_id").cast("long"))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    shared = keep_rows(docs, again).groupBy("doc_id").agg(F.min(digest).alias("first"))
    shared = keep(shared.withColumnRenamed("doc_id", "shared_id"), "shared-ids")
    apart = F.lit(1 << 61) + F.shiftrightunsigned(F.xxhash64("doc_id", digest), 4)
    key = F.when(F.col("first").isNull() | (F.col("first") == digest), F.col("doc_id").cast("long"))
    return docs.join(broadcast_if_small(shared), F.col("doc_id") == F.col("shared_id"), "left").select(
        *[F.col(f"`{c}`") for c in docs.columns], key.otherwise(apart).alias("row_key"))


def drop_rows(keyed: DataFrame, keys: DataFrame, once: bool = False) -> DataFrame:
    """Rows whose ``row_key`` is not in ``keys`` (column doc_id), without that column.
    ``once`` also leaves one of several rows with one key, which have the same text."""
    names = [F.col(f"`{c}`") for c in keyed.columns if c != "row_key"]
    gone = broadcast_if_small(keep(keys.select(F.col("doc_id").alias("row_key")).distinct(),
                                   "rejected", batch_rows=TEXT_ROWS))
    rows = keyed.join(gone, "row_key", "left_anti")
    if not once:
        return rows.select(*names)
    again = broadcast_if_small(keep(
        keyed.groupBy("row_key").count().filter("count > 1").select("row_key"), "again"))
    return rows.join(again, "row_key", "left_anti").select(*names).unionByName(
        rows.join(again, "row_key", "left_semi").dropDuplicates(["row_key"]).select(*names))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (node, root), root the smallest node.

    Each round hangs every node below its smallest neighbour, follows those pointers to
    their ends and contracts the edges to what is left between different ends. Every node
    with a smaller neighbour disappears, so the rounds grow with the logarithm of the
    longest path. All steps are joins of written tables, which adaptive execution may split.
    """
    edges = keep(edges.filter("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.select(F.col("b").alias("node"), F.col("a").alias("up")).unionByName(
            edges.select(F.col("a").alias("node"), F.col("a").alias("up")))
        tree = keep(both.groupBy("node").agg(F.min("up").alias("root")), "tree")
        while True:
            above = tree.select(F.col("node").alias("root"), F.col("root").alias("top"))
            hop = keep(tree.join(above, "root").select("node", "root", "top"), "hop")
            done = hop.filter("root <> top").isEmpty()
            tree = hop.select("node", F.col("top").alias("root"))
            if done:
                break
        if labels is None:
            labels = tree
        else:
            higher = tree.select(F.col("node").alias("root"), F.col("root").alias("top"))
            old = labels.join(higher, "root", "left").select(
                "node", F.coalesce("top", "root").alias("root"))
            labels = keep(old, "labels")
        end = tree.select("node", "root")
        edges = keep(
            edges.join(end.withColumnsRenamed({"node": "a", "root": "ra"}), "a")
            .join(end.withColumnsRenamed({"node": "b", "root": "rb"}), "b")
            .filter("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct(), "edges")
    if labels is None:
        spark = edges.sparkSession
        kind = dict(edges.dtypes)["a"]
        return spark.createDataFrame([], f"node {kind}, root {kind}")
    return labels
