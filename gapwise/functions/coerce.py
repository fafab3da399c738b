"""Lenient typing: what cannot be read becomes null, and NaN is null too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from gapwise.functions.names import named

# Fixed value: text that counts as a number.
NUMBER_PATTERN = (
    r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"
)
# Fixed value: text that counts as a time without a pattern: a full date, perhaps a time of day.
TIME_PATTERN = r"^\s*\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{1,2}(:\d{1,2}([.]\d{1,9})?)?)?\s*$"
EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def nan_to_null(column: str) -> Column:
    return F.when(~F.isnan(named(column)), named(column))


def to_number(column: str, data_type: T.DataType) -> Column:
    """The column as a double; unreadable text and NaN become null."""
    c = named(column)
    if isinstance(data_type, T.StringType):
        return F.when(c.rlike(NUMBER_PATTERN), F.trim(c).try_cast("double"))
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return nan_to_null(column).cast("double")
    if isinstance(data_type, T.NumericType):
        return c.cast("double")
    return c.cast("string").try_cast("double")


def coerce_numeric(df: DataFrame, columns) -> DataFrame:
    """Read the columns that are present as numbers."""
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: to_number(c, df.schema[c].dataType) for c in present})


def to_time(column: str, data_type: T.DataType, pattern: str | None = None) -> Column:
    """The column as a timestamp without zone; unreadable text becomes null."""
    c = named(column)
    if isinstance(data_type, T.StringType):
        if pattern is None:
            return F.when(c.rlike(TIME_PATTERN), F.trim(c).try_cast("timestamp_ntz"))
        return F.try_to_timestamp(c, F.lit(pattern)).cast("timestamp_ntz")
    return c.cast("timestamp_ntz")


def parse_time(df: DataFrame, column: str, pattern: str | None = None,
               into: str | None = None) -> DataFrame:
    """Parse ``column``; rows that do not parse stay, with a null time."""
    into = into or column
    parsed = df.withColumn(column, to_time(column, df.schema[column].dataType, pattern))
    return parsed if into == column else parsed.withColumnRenamed(column, into)


def parse_time_or_drop(df: DataFrame, column: str, pattern: str | None = None) -> DataFrame:
    """Parse ``column`` and drop the rows that do not parse; they cannot be placed
    in a series. ``audit.time_range`` counts them."""
    return parse_time(df, column, pattern).filter(named(column).isNotNull())


def epoch_micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970 as a long."""
    if isinstance(df.schema[column].dataType, T.TimestampType):
        return F.unix_micros(column)
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, `{column}`)")
