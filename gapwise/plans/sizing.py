"""Size checks behind broadcast and chunking decisions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from gapwise.session import shared_dir

# A broadcast side may have at most this many rows and bytes of text form.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 * 1024 * 1024


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS,
                       max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast if counting its rows and bytes proves it small.

    A larger side is returned as it is: the join then shuffles, and adaptive
    execution splits the skewed partitions.
    """
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    found = df.limit(max_rows + 1).agg(F.count("*").alias("rows"), F.sum(size).alias("bytes")).first()
    small = found["rows"] <= max_rows and (found["bytes"] or 0) <= max_bytes
    return F.broadcast(df) if small else df


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared folder and read back, so that several passes over it
    compute it once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
