"""Median imputation: fitted on the training rows, applied everywhere."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from gapwise.functions.quantile import exact_medians


def fit_medians(train: DataFrame, columns) -> dict[str, float]:
    """Exact medians; a column without any value is an error, since nothing could
    stand in for it."""
    medians = exact_medians(train, columns)
    empty = [c for c, m in medians.items() if m is None]
    if empty:
        raise ValueError(f"no training value at all in: {', '.join(empty)}")
    return {c: float(m) for c, m in medians.items()}


def impute(df: DataFrame, medians: Mapping[str, float]) -> DataFrame:
    """Replace nulls by the fitted medians; only transforms."""
    return df.withColumns({
        c: F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in medians.items()})


def median_table(spark, medians: Mapping[str, float]) -> DataFrame:
    return spark.createDataFrame(list(medians.items()), "feature string, median double")
