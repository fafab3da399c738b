"""Table profiles in long form. Each report is one aggregate over one scan, turned
on its side afterwards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from gapwise.functions.coerce import coerce_numeric, to_number, to_time
from gapwise.functions.names import named
from gapwise.operators.dedup import exact_duplicate_count, rows_in_duplicated_keys
from gapwise.spec import FILLED_SUFFIX, PanelSpec


def _per_column(df: DataFrame, columns, label: str, **measures) -> DataFrame:
    """``measures`` maps a field name to a function from column name to aggregate."""
    one_row = df.agg(*[measure(c).alias(f"{i}_{name}")
                       for i, c in enumerate(columns) for name, measure in measures.items()])
    entries = [
        F.struct(F.lit(c).alias(label),
                 *[F.col(f"{i}_{name}").alias(name) for name in measures])
        for i, c in enumerate(columns)]
    return one_row.select(F.inline(F.array(*entries)))


def missing_values(df: DataFrame) -> DataFrame:
    """Per column: its type, the number of rows and of nulls."""
    types = dict(df.dtypes)
    return _per_column(
        df, df.columns, "column",
        dtype=lambda c: F.any_value(F.lit(types[c])),
        n_rows=lambda c: F.count(F.lit(1)),
        n_missing=lambda c: F.count_if(named(c).isNull()),
    )


def table_shape(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).select(
        F.lit(name).alias("table"), "n_rows", F.lit(len(df.columns)).alias("n_columns"))


def distinct_counts(df: DataFrame, columns) -> DataFrame:
    """Distinct values of every column, nulls left out."""
    return _per_column(df, columns, "column",
                       n_distinct=lambda c: F.count_distinct(named(c)))


def time_range(df: DataFrame, column: str, pattern: str | None = None) -> DataFrame:
    """Earliest and latest time and how many rows have no readable time."""
    parsed = df.select(to_time(column, df.schema[column].dataType, pattern).alias("t"))
    return parsed.agg(F.min("t").alias("min_time"), F.max("t").alias("max_time"),
                      F.count_if(F.col("t").isNull()).alias("unparseable"))


def numeric_ranges(df: DataFrame, columns) -> DataFrame:
    """Per column: min, max, mean, nulls and their share in percent."""
    columns = [c for c in columns if c in df.columns]
    return _per_column(
        coerce_numeric(df.select(*map(named, columns)), columns), columns, "column",
        min=lambda c: F.min(named(c)), max=lambda c: F.max(named(c)),
        mean=lambda c: F.avg(named(c)),
        n_missing=lambda c: F.count_if(named(c).isNull()),
        missing_pct=lambda c: F.round(
            F.avg(named(c).isNull().cast("double")) * 100, 2),
    )


def negative_counts(df: DataFrame, columns) -> DataFrame:
    columns = [c for c in columns if c in df.columns]
    return _per_column(
        coerce_numeric(df.select(*map(named, columns)), columns), columns, "column",
        n_negative=lambda c: F.count_if(named(c) < 0))


def table_report(df: DataFrame, name: str, distinct=(), time: str | None = None,
                 pattern: str | None = None, values=(), keys=()) -> DataFrame:
    """The whole audit of one table as rows (table, column, measure, value), the value
    as text. Columns that are absent are skipped. Three scans: one for all profiles, one
    for equal rows, one for keys."""
    def there(columns):
        return [c for c in columns if c in df.columns]

    numbers = {f"__number_{c}": to_number(c, df.schema[c].dataType) for c in there(values)}
    if time in df.columns:
        numbers["__time"] = to_time(time, df.schema[time].dataType, pattern)
    entries = _profile(df.withColumns(numbers), df.dtypes, there(distinct), time, there(values))
    measured = df.withColumns(numbers).agg(*[
        value.cast("string").alias(f"m{i}") for i, (_, _, value) in enumerate(entries)])
    profile = measured.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("table"), F.lit(column).cast("string").alias("column"),
                 F.lit(measure).alias("measure"), F.col(f"m{i}").alias("value"))
        for i, (column, measure, _) in enumerate(entries)])))
    parts = [profile, _in_rows(exact_duplicate_count(df).select("duplicate_rows"), name)]
    if keys and there(keys) == list(keys):
        parts.append(_in_rows(rows_in_duplicated_keys(df, keys), name))
    return reduce(DataFrame.unionByName, parts)


def _profile(df: DataFrame, dtypes, distinct, time, values) -> list[tuple]:
    """(column, measure, aggregate) of all that one scan can tell."""
    rows = F.count(F.lit(1))
    entries = [(None, "n_rows", rows), (None, "n_columns", F.any_value(F.lit(len(dtypes))))]
    for c, kind in dtypes:
        entries += [(c, "dtype", F.any_value(F.lit(kind))), (c, "n_rows", rows),
                    (c, "n_missing", F.count_if(named(c).isNull()))]
    entries += [(c, "n_distinct", F.count_distinct(named(c))) for c in distinct]
    if "__time" in df.columns:
        entries += [(time, "min_time", F.min("__time")), (time, "max_time", F.max("__time")),
                    (time, "unparseable", F.count_if(F.col("__time").isNull()))]
    for c in values:
        v = named(f"__number_{c}")
        share = F.round(F.avg(v.isNull().cast("double")) * 100, 2)
        entries += [(c, "min", F.min(v)), (c, "max", F.max(v)), (c, "mean", F.avg(v)),
                    (c, "n_unreadable", F.count_if(v.isNull())), (c, "missing_pct", share),
                    (c, "n_negative", F.count_if(v < 0))]
    return entries


def _in_rows(report: DataFrame, name: str) -> DataFrame:
    """One row per measure of a small report."""
    column = F.col("column") if "column" in report.columns else F.lit(None).cast("string")
    measures = [c for c in report.columns if c != "column"]
    entries = F.array(*[
        F.struct(F.lit(m).alias("measure"), F.col(m).cast("string").alias("value"))
        for m in measures])
    return report.select(F.lit(name).alias("table"), column.alias("column"), F.inline(entries))


def fill_report(filled: DataFrame, spec: PanelSpec) -> DataFrame:
    """Per column: nulls before the fill, filled rows, nulls left."""
    def was_filled(c):
        return F.col(c + FILLED_SUFFIX)

    columns = [c for c in spec.present(filled.columns) if c + FILLED_SUFFIX in filled.columns]
    return _per_column(
        filled, columns, "column",
        missing_before=lambda c: F.count_if(F.col(c).isNull() | was_filled(c)),
        filled=lambda c: F.count_if(was_filled(c)),
        missing_after=lambda c: F.count_if(F.col(c).isNull()))


def stage_counts(raw: DataFrame, spec: PanelSpec, pattern: str | None = None) -> DataFrame:
    """Rows left after each cleaning step, from one pass over the raw table:
    read, exact duplicates dropped, unreadable times dropped, null entities dropped, first
    of each key. The last number is that of the rows of the cleaned panel."""
    copies = raw.groupBy(*map(named, raw.columns)).agg(F.count("*").alias("__copies"))
    time = to_time(spec.time, raw.schema[spec.time].dataType, pattern)
    per_key = copies.groupBy(spec.entity, time.alias("__time")).agg(
        F.sum("__copies").alias("raw"), F.count("*").alias("distinct"))
    readable = F.col("__time").isNotNull()
    placed = readable & F.col(spec.entity).isNotNull()
    counts = per_key.agg(
        F.sum("raw").alias("raw"), F.sum("distinct").alias("exact_dedup"),
        F.sum(F.when(readable, F.col("distinct"))).alias("parsed_time"),
        F.sum(F.when(placed, F.col("distinct"))).alias("known_entity"),
        F.count_if(placed).alias("first_of_key"))
    entries = [F.struct(F.lit(stage).alias("stage"),
                        F.coalesce(stage, F.lit(0)).alias("n_rows"))
               for stage in counts.columns]
    return counts.select(F.inline(F.array(*entries)))
