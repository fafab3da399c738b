"""Writers. Tables go to Parquet; only reports, whose size is that of the calendar or
of the column list, go to a single CSV or JSON file."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_table(df: DataFrame, path: str, partition_by=()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_periods(df: DataFrame, path: str, period: str, only_these: bool = False) -> None:
    """A table in one folder per value of the column ``period``, rows of a folder gathered in
    few files. ``only_these`` replaces the folders that ``df`` has rows for and leaves all
    others as they are; otherwise the table is replaced."""
    gathered = df.hint("rebalance", F.col(f"`{period}`"))
    gathered.write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic" if only_these else "static").partitionBy(period).parquet(path)


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str, single_file: bool = True) -> None:
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_document(spark: SparkSession, document: dict, path: str) -> None:
    """One small JSON document, e.g. model metadata."""
    text = json.dumps(document, indent=2, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_document(spark: SparkSession, path: str):
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])
