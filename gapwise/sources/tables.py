"""Readers for the raw and the cleaned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from gapwise.functions.coerce import coerce_numeric, parse_time_or_drop
from gapwise.functions.names import require_columns, snake_columns
from gapwise.operators.states import PERIOD
from gapwise.spec import PanelSpec

# Raw file layouts. Values are read as text and typed later, so that a
# bad cell becomes null instead of failing the read.
READING_COLUMNS = (
    "StationId", "Datetime", "PM2.5", "PM10", "NO", "NO2", "NOx", "NH3", "CO", "SO2",
    "O3", "Benzene", "Toluene", "Xylene", "AQI", "AQI_Bucket",
)
STATION_COLUMNS = ("StationId", "StationName", "City", "State", "Status")
SNAPSHOT_COLUMNS = (
    "country", "state", "city", "station", "last_update", "latitude", "longitude",
    "pollutant_id", "pollutant_min", "pollutant_max", "pollutant_avg",
)

# Fixed value: text that means "no value" in a raw file.
NO_VALUE_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


# Columns that marked rows of a file carry beside its own: why a row is none of the table,
# its line, and its place among the rows of all files.
REASON, LINE = "row_reason", "row_line"
FILE_ORDER = ("source_file", "source_block", "source_row")
_MARKS = (REASON, LINE, *FILE_ORDER)


def marked_csv(spark: SparkSession, path: str, columns=(), multi_line: bool = False,
               short_rows: bool = True) -> DataFrame:
    """Every row of a CSV file with a header, each cell as text, and the marks.

    Cells may be quoted by ``"``, with ``""`` for a quote inside; with ``multi_line`` quoted
    cells may hold line ends, and a file is no longer read in pieces. The header names the
    columns, in any order and number; those of ``columns`` that are there come first, the
    others follow. Files that are read together need the same header: another one raises.

    A row is marked, with its line, where its cells do not fit the header: ``surplus_cells``,
    ``unclosed_quote``, or ``missing_cells`` unless ``short_rows`` takes the cells that a row
    lacks at its end as empty. ``FILE_ORDER`` orders rows as the files have them.
    """
    reader = spark.read.options(header=True, quote='"', escape='"', mode="PERMISSIVE",
                                enforceSchema=False, multiLine=multi_line)
    names = reader.csv(path).schema.names
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, LINE]])
    # Pruned scans would not see how many cells a row has.
    df = reader.options(columnNameOfCorruptRecord=LINE, columnPruning=False).schema(schema).csv(path)
    cells = F.regexp_replace(F.col(LINE), '"[^"]*"', "")
    n_cells = F.length(cells) - F.length(F.replace(cells, F.lit(","))) + 1
    # The scan refuses to give nothing but the line, so that a mere count needs a cell as well.
    fits = F.col(LINE).isNull() & (F.length(F.coalesce(F.col(f"`{names[0]}`"), F.lit(""))) >= 0)
    reason = F.when(fits, None).when(
        n_cells > len(names), "surplus_cells").when(
        F.contains(cells, F.lit('"')), "unclosed_quote")
    if not short_rows:
        reason = F.when(~fits & reason.isNull(), "missing_cells").otherwise(reason)
    first = [c for c in columns if c in names]
    cell = {c: F.when(~F.trim(F.col(f"`{c}`")).isin(*NO_VALUE_TEXTS), F.col(f"`{c}`")) for c in names}
    return df.select(
        *[cell[c].alias(c) for c in [*first, *[c for c in names if c not in first]]],
        reason.alias(REASON), F.when(reason.isNotNull(), F.col(LINE)).alias(LINE),
        F.col("_metadata.file_path").alias(FILE_ORDER[0]),
        F.col("_metadata.file_block_start").alias(FILE_ORDER[1]),
        F.monotonically_increasing_id().alias(FILE_ORDER[2]))


def fitting_rows(marked: DataFrame, keep_order: bool = False) -> DataFrame:
    """The rows of a marked table whose cells fit its header; with ``keep_order`` the columns
    of their order in the files stay."""
    dropped = (REASON, LINE) if keep_order else _MARKS
    return marked.filter(F.col(REASON).isNull()).drop(*dropped)


def misfit_lines(marked: DataFrame) -> DataFrame:
    """The other rows: file, reason and line."""
    return marked.filter(F.col(REASON).isNotNull()).select(
        F.col(FILE_ORDER[0]).alias("file"), F.col(REASON).alias("reason"), F.col(LINE).alias("line"))


def in_file_order(df: DataFrame) -> DataFrame:
    """A Parquet table, as read, with the columns of ``FILE_ORDER``: file and row in it."""
    return df.select("*", F.col("_metadata.file_path").alias(FILE_ORDER[0]),
                     F.lit(0).cast("long").alias(FILE_ORDER[1]),
                     F.col("_metadata.row_index").alias(FILE_ORDER[2]))


def read_csv(spark: SparkSession, path: str, columns=(), multi_line: bool = False) -> DataFrame:
    """The fitting rows of ``marked_csv``; ``misfit_lines`` has the others."""
    return fitting_rows(marked_csv(spark, path, columns, multi_line))


def read_readings(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, READING_COLUMNS)


def staged_readings(spark: SparkSession, path: str, periods=None) -> DataFrame:
    """Marked readings that were written by periods, all or those of some periods."""
    df = spark.read.parquet(path)
    if periods is not None:
        df = df.filter(F.col(PERIOD).isin(list(periods)))
    return df.drop(PERIOD)


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, STATION_COLUMNS)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, SNAPSHOT_COLUMNS)


def read_table(spark: SparkSession, path: str, split_camel: bool = True) -> DataFrame:
    """A Parquet or CSV table with snake-case column names."""
    df = read_csv(spark, path) if path.rstrip("/").endswith(".csv") else spark.read.parquet(path)
    return snake_columns(df, split_camel)


def read_panel(spark: SparkSession, path: str, spec: PanelSpec,
               split_camel: bool = True, pattern: str | None = None,
               periods=None) -> DataFrame:
    """A cleaned panel or feature table read back: keys checked, times parsed, rows
    without a time left out. Columns nobody uses are pruned by the scan. Of a table written
    by periods, ``periods`` names those to read; the column of the period is left out."""
    df = read_table(spark, path, split_camel)
    if periods is not None:
        df = df.filter(F.col(PERIOD).isin(list(periods)))
    df = df.drop(PERIOD)
    require_columns(df, spec.keys, "panel")
    df = coerce_numeric(parse_time_or_drop(df, spec.time, pattern), spec.values)
    flags = [c for c, kind in df.dtypes
             if kind == "string" and (c.endswith("_was_filled") or c == spec.target_valid)]
    return df.withColumns({c: F.col(c).cast("boolean") for c in flags})


def verify_inputs(spark: SparkSession, paths) -> None:
    """Raise one error that names every missing path."""
    missing = [p for p in paths if not path_exists(spark, p)]
    if missing:
        raise FileNotFoundError("missing input: " + ", ".join(missing))


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return hadoop.getFileSystem(conf).exists(hadoop)
