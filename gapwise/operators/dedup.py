"""Duplicate removal and counting.

Every function aggregates before it shuffles, so a huge group of copies leaves each
task as a single row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from gapwise.functions.names import named


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    """One row of every set of equal rows; nulls count as equal."""
    return df.dropDuplicates()


def exact_duplicate_count(df: DataFrame) -> DataFrame:
    """Rows, distinct rows and the surplus, as one row."""
    copies = df.groupBy(*map(named, df.columns)).agg(F.count("*").alias("copies"))
    rows = F.coalesce(F.sum("copies"), F.lit(0))
    return copies.agg(
        rows.alias("n_rows"), F.count("*").alias("n_distinct"),
        (rows - F.count("*")).alias("duplicate_rows"))


def rows_in_duplicated_keys(df: DataFrame, keys) -> DataFrame:
    """How many rows share their key with another row, counting all of them."""
    sizes = df.groupBy(*map(named, keys)).agg(F.count("*").alias("n"))
    shared = F.when(F.col("n") > 1, F.col("n"))
    return sizes.agg(
        F.coalesce(F.sum(shared), F.lit(0)).alias("rows_in_duplicated_keys"),
        F.count(shared).alias("duplicated_keys"))


def keep_first(df: DataFrame, keys, order) -> DataFrame:
    """The first row of every key in the given order.

    Tables have no row order, so ``order`` decides; make it unique within a key. The
    rank filter is pushed below the shuffle: a task sends one row per key.
    """
    first = Window.partitionBy(*keys).orderBy(*order)
    return (df.withColumn("__rank", F.row_number().over(first))
            .filter(F.col("__rank") == 1).drop("__rank"))
