"""Joins of a panel with small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gapwise.plans.sizing import broadcast_if_small


def enrich(panel: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Left join that keeps every reading; a null key matches a null key.

    The dimension is broadcast if a count shows it is small.
    """
    right = broadcast_if_small(dimension.withColumnRenamed(key, "__key"))
    return panel.join(right, F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key")


def missing_metadata(enriched: DataFrame, column: str) -> DataFrame:
    """How many rows found no partner, judged by a dimension column."""
    return enriched.agg(F.count("*").alias("n_rows"),
                        F.count_if(F.col(column).isNull()).alias("n_missing_metadata"))


def keep_selected(panel: DataFrame, selected: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among the selected ones."""
    return panel.join(broadcast_if_small(selected.select(key)), key, "left_semi")
