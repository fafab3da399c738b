"""The course of a document table through five operators, each stage written and read back.

Every stage works on what the one before it kept, and all but the last return the columns
of the documents. Rows without a doc_id cannot be judged by any operator and go in the first
stage. Texts that share an id are judged each by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gapwise.llm.bpe import bpe_digests
from gapwise.llm.content_sort import exact_duplicates
from gapwise.llm.fm_index import contamination
from gapwise.llm.jaccard_join import jaccard_groups
from gapwise.llm.queries import tokenizer_path
from gapwise.llm.shared import TEXT_ROWS, drop_rows, keep, one_text_per_id
from gapwise.llm.toxicity import toxicity_scores


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = one_text_per_id(docs)
    found = toxicity_scores(docs, labels, id_col="row_key", label_id_col="doc_id")
    return drop_rows(docs, found.filter("predicted = 1"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of equal texts; a repeated row stays once."""
    docs = one_text_per_id(docs)
    found = exact_duplicates(docs, id_col="row_key")
    return drop_rows(docs, found.filter("doc_id <> keep_id"), once=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of similar texts: sets of five-word
    shingles with a Jaccard similarity of 0.8 or more."""
    docs = one_text_per_id(docs)
    groups = jaccard_groups(docs, k=5, num=80, den=100, id_col="row_key")
    return drop_rows(docs, groups.filter("doc_id <> component_id"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    docs = one_text_per_id(docs)
    found = contamination(docs, benchmark, id_col="row_key")
    return drop_rows(docs, found.filter(F.col("contaminated")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the documents that are left."""
    return keep(bpe_digests(docs, tokenizer_path()), "digests", batch_rows=TEXT_ROWS)


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", encode),
]

# A classifier and a tokenizer have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
