"""How complete each entity's series is, and which entities are good enough."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gapwise.functions.coerce import epoch_micros
from gapwise.spec import (
    MAX_MISSING_PCT, MIN_CONTINUITY_PCT, MIN_COVERAGE, MIN_RECORDS, MIN_SPAN_DAYS,
    SUBSET_SIZE, PanelSpec)

META = ("station_name", "city", "state")


def _first_meta(df: DataFrame, spec: PanelSpec):
    """The dimension columns of each entity's earliest row, which may be null."""
    return [F.min_by(c, spec.time).alias(c) for c in META if c in df.columns]


def coverage_report(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Span in whole days, rows and share of rows with a value, best first.
    ``coverage_exact`` is the share before rounding."""
    measured = spec.target_of
    return coverage_columns(
        df.filter(F.col(spec.entity).isNotNull())
        .groupBy(spec.entity)
        .agg(*_first_meta(df, spec),
             F.min(spec.time).alias("first_reading"), F.max(spec.time).alias("last_reading"),
             F.count("*").alias("n_records"), F.count(measured).alias("n_present")), spec)


def coverage_columns(counts: DataFrame, spec: PanelSpec) -> DataFrame:
    """Span and coverage of counted entities."""
    span = F.timestamp_diff("DAY", F.col("first_reading"), F.col("last_reading"))
    share = F.col("n_present") / F.col("n_records")
    return counts.withColumns({"span_days": span, "coverage_exact": share,
                               "coverage": F.round(share, 4)}
                              ).orderBy(F.desc("coverage"), spec.entity)


def select_entities(report: DataFrame, min_coverage: float = MIN_COVERAGE,
                    min_span_days: int = MIN_SPAN_DAYS,
                    min_records: int = MIN_RECORDS) -> DataFrame:
    """Entities that pass all three gates of the first pass."""
    return report.filter((F.col("coverage") >= min_coverage)
                         & (F.col("span_days") >= min_span_days)
                         & (F.col("n_records") >= min_records))


def usable(df: DataFrame, spec: PanelSpec):
    """Condition for a row with a checked target."""
    return F.col(spec.target).isNotNull() & F.coalesce(F.col(spec.target_valid), F.lit(False))


def deep_coverage(features: DataFrame, spec: PanelSpec) -> DataFrame:
    """Missing share, continuity on the clock and usable rows of every entity, most
    usable rows first."""
    clock = epoch_micros(features, spec.time)
    return deep_columns(
        features.filter(F.col(spec.entity).isNotNull())
        .groupBy(spec.entity)
        .agg(*_first_meta(features, spec),
             F.count("*").alias("n_observations"), F.count(spec.target_of).alias("n_present"),
             F.min(spec.time).alias("date_range_start"),
             F.max(spec.time).alias("date_range_end"),
             F.min(clock).alias("__first"), F.max(clock).alias("__last"),
             F.count_if(usable(features, spec)).alias("usable_rows")), spec)


def deep_columns(counts: DataFrame, spec: PanelSpec) -> DataFrame:
    """Shares of counted entities, ``__first`` and ``__last`` being their ends in microseconds."""
    hours = F.floor((F.col("__last") - F.col("__first")) / F.lit(spec.step_seconds * 1_000_000))
    missing = 100 * (1 - F.col("n_present") / F.col("n_observations"))
    continuity = 100 * F.col("n_observations") / F.col("expected_slots")
    return (
        counts.withColumn("expected_slots", (hours + 1).cast("long"))
        .withColumns({"missing_pct": F.round(missing, 2),
                      "continuity_pct": F.round(continuity, 2)})
        .drop("__first", "__last", "n_present")
        .orderBy(F.desc("usable_rows"), spec.entity)
    )


def recommend_subset(report: DataFrame, spec: PanelSpec, max_missing: float = MAX_MISSING_PCT,
                     min_continuity: float = MIN_CONTINUITY_PCT,
                     size: int = SUBSET_SIZE) -> DataFrame:
    """The entities with most usable rows among those that pass both quality gates."""
    eligible = report.filter((F.col("missing_pct") <= max_missing)
                             & (F.col("continuity_pct") >= min_continuity))
    return eligible.orderBy(F.desc("usable_rows"), spec.entity).limit(size)
