"""Partial states of a panel, one per entity and calendar period.

A state holds what reports need of the rows of one entity in one period: counts, first and
last time, names. States of several periods merge into the report over all of them, so a
new period is added without reading the old ones; and their counts tell which periods hold
an entity's newest rows, or the rows that windows reach from a given period, before any row
of the panel is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gapwise.operators.coverage import META, coverage_columns, deep_columns, usable
from gapwise.functions.coerce import epoch_micros
from gapwise.spec import PanelSpec

# The column of the period, a number such as 202401 or 20240115.
PERIOD = "part_period"
_SKETCH = 12


def period_of(time: Column, kind: str = "month") -> Column:
    """The month or day of a time as a number in calendar order."""
    month = F.year(time) * 100 + F.month(time)
    if kind == "month":
        return month.cast("int")
    if kind == "day":
        return (month * 100 + F.dayofmonth(time)).cast("int")
    raise ValueError(f"no such period: {kind}")


def with_period(df: DataFrame, spec: PanelSpec, kind: str = "month") -> DataFrame:
    return df.withColumn(PERIOD, period_of(F.col(spec.time), kind))


def period_states(df: DataFrame, spec: PanelSpec, kind: str = "month") -> DataFrame:
    """The states of a panel or feature table; rows without entity or time have none."""
    has_target = spec.target in df.columns and spec.target_valid in df.columns
    wanted = F.count_if(usable(df, spec)) if has_target else F.lit(None).cast("long")
    meta = [F.min_by(c, spec.time).alias(c) for c in META if c in df.columns]
    known = with_period(df, spec, kind).filter(
        F.col(spec.entity).isNotNull() & F.col(spec.time).isNotNull())
    return known.groupBy(spec.entity, PERIOD).agg(
        *meta, F.min(spec.time).alias("first_time"), F.max(spec.time).alias("last_time"),
        F.count("*").alias("n_rows"), F.count(spec.target_of).alias("n_present"),
        wanted.alias("n_usable"))


def merged_states(states: DataFrame, spec: PanelSpec) -> DataFrame:
    """One state per entity, of all its periods."""
    meta = [F.min_by(c, "first_time").alias(c) for c in META if c in states.columns]
    return states.groupBy(spec.entity).agg(
        *meta, F.min("first_time").alias("first_time"), F.max("last_time").alias("last_time"),
        *[F.sum(c).alias(c) for c in ("n_rows", "n_present", "n_usable")])


def coverage_of_states(states: DataFrame, spec: PanelSpec) -> DataFrame:
    """The report of ``coverage.coverage_report``, from states."""
    merged = merged_states(states, spec).drop("n_usable").withColumnsRenamed(
        {"first_time": "first_reading", "last_time": "last_reading", "n_rows": "n_records"})
    return coverage_columns(merged, spec)


def deep_coverage_of_states(states: DataFrame, spec: PanelSpec) -> DataFrame:
    """The report of ``coverage.deep_coverage``, from states of a feature table."""
    merged = merged_states(states, spec).withColumnsRenamed(
        {"first_time": "date_range_start", "last_time": "date_range_end",
         "n_rows": "n_observations", "n_usable": "usable_rows"})
    ends = {"__first": epoch_micros(merged, "date_range_start"),
            "__last": epoch_micros(merged, "date_range_end")}
    return deep_columns(merged.withColumns(ends), spec)


def short_entities(states: DataFrame, spec: PanelSpec, min_rows: int) -> DataFrame:
    """Entities with fewer than ``min_rows`` rows, with the reason."""
    counts = states.groupBy(spec.entity).agg(F.sum("n_rows").alias("n_rows"))
    return counts.filter(F.col("n_rows") < min_rows).withColumn(
        "reason", F.lit(f"fewer than {min_rows} rows of history"))


def _rows_between(states: DataFrame, keys, newest_first: bool) -> Column:
    """Rows of an entity in the periods passed before this one."""
    order = F.desc(PERIOD) if newest_first else F.asc(PERIOD)
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("n_rows").over(w), F.lit(0))


def newest_periods(states: DataFrame, spec: PanelSpec, rows: int) -> DataFrame:
    """The periods, per entity, that hold its last ``rows`` rows."""
    newer = _rows_between(states, [spec.entity], newest_first=True)
    return states.withColumn("__newer", newer).filter(F.col("__newer") < rows).select(
        spec.entity, PERIOD)


def reached_periods(states: DataFrame, spec: PanelSpec, periods, back: int = 0,
                    ahead: int = 0) -> list[int]:
    """The given periods and those with any of the ``back`` rows before or the ``ahead``
    rows after them, of any entity. The list is at most as long as the calendar."""
    periods = sorted(set(periods))
    if not periods or not (back or ahead):
        return periods
    per = states.select(spec.entity, PERIOD, "n_rows",
                        F.explode(F.array(*[F.lit(p) for p in periods])).alias("__at"))
    found = []
    for rows, side, newest_first in ((back, F.col(PERIOD) < F.col("__at"), True),
                                     (ahead, F.col(PERIOD) > F.col("__at"), False)):
        part = per.filter(side)
        passed = _rows_between(part, [spec.entity, "__at"], newest_first)
        found.append(part.withColumn("__passed", passed).filter(F.col("__passed") < rows).select(PERIOD))
    reached = found[0].unionByName(found[1]).distinct().collect()
    return sorted({*periods, *[r[0] for r in reached]})


def distinct_sketches(df: DataFrame, columns, by=()) -> DataFrame:
    """Mergeable sketches of the distinct values of every column (nulls left out), one row
    per group of ``by``, columns ``<name>_sketch``. One plain aggregate: unlike several
    exact distinct counts it multiplies no rows."""
    return df.groupBy(*by).agg(*[
        F.hll_sketch_agg(F.col(f"`{c}`").cast("string"), F.lit(_SKETCH)).alias(f"{c}_sketch")
        for c in columns])


def distinct_estimates(sketches: DataFrame, columns) -> DataFrame:
    """Estimated distinct values over all groups: rows (column, n_estimated)."""
    one_row = sketches.agg(*[
        F.hll_sketch_estimate(F.hll_union_agg(f"`{c}_sketch`")).alias(f"e{i}")
        for i, c in enumerate(columns)])
    entries = [F.struct(F.lit(c).alias("column"), F.coalesce(f"e{i}", F.lit(0)).cast("long").alias(
        "n_estimated")) for i, c in enumerate(columns)]
    return one_row.select(F.inline(F.array(*entries)))
