"""From raw tables to the feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gapwise.functions.calendar import (
    CYCLIC_FEATURES, TIME_FEATURES, add_cyclic_features, add_time_features)
from gapwise.functions.coerce import coerce_numeric, parse_time, to_time
from gapwise.functions.flags import add_geo_flag, add_impossible_flag, add_negative_flag
from gapwise.functions.names import snake_columns
from gapwise.operators.dedup import drop_exact_duplicates, keep_first
from gapwise.operators.joins import enrich, keep_selected
from gapwise.operators.series import add_lags, add_rolling_means, add_target, forward_fill
from gapwise.operators.snapshot import snapshot_wide
from gapwise.plans.chunks import CHUNK_ROWS, over_series
from gapwise.plans.sizing import written
from gapwise.spec import SNAPSHOT_TIME_FORMAT, PanelSpec


def split_readings(readings: DataFrame, spec: PanelSpec, pattern: str | None = None
                   ) -> tuple[DataFrame, DataFrame]:
    """Readings with a readable time and a station, and the rejected rows as they were read
    with the ``reason``: unreadable_time or null_entity."""
    raw = snake_columns(readings)
    time = to_time(spec.time, raw.schema[spec.time].dataType, pattern)
    reason = F.when(time.isNull(), "unreadable_time").when(
        F.col(spec.entity).isNull(), "null_entity")
    marked = raw.withColumn("reason", reason)
    good = parse_time(marked.filter(F.col("reason").isNull()).drop("reason"), spec.time, pattern)
    return good, marked.filter(F.col("reason").isNotNull())


def clean_panel(readings: DataFrame, stations: DataFrame, spec: PanelSpec,
                fill: bool = True, chunk_rows: int = CHUNK_ROWS,
                pattern: str | None = None, order=()) -> DataFrame:
    """Raw readings and stations to the cleaned panel: names, times, duplicates,
    numbers, negative flag, station columns, fill.

    Rows with a null entity or time belong to no series and are left out:
    ``split_readings`` returns them, ``audit.stage_counts`` counts them. ``pattern`` is the
    format of the times; without it they are read as ISO times. Of several rows with one key
    the first in the ``order`` of the named columns stays (``tables.FILE_ORDER`` for the order of
    files), else the first by its values; exact duplicates go in the same shuffle.
    """
    raw = snake_columns(readings)
    panel, _ = split_readings(readings, spec, pattern)
    rest = [c for c in panel.columns if c not in (*spec.keys, *order)]
    panel = keep_first(panel, spec.keys, [F.col(c).asc_nulls_last() for c in (*order, *rest)])
    panel = panel.drop(*order)
    panel = add_negative_flag(coerce_numeric(panel, spec.values),
                              spec.present(panel.columns))
    # Written, so that its size check and the join compute it once.
    places = written(drop_exact_duplicates(snake_columns(stations)), "stations")
    panel = enrich(panel, places, spec.entity)
    if not fill:
        return panel
    return over_series(panel, spec, lambda d, by: forward_fill(d, spec, by=by),
                       history=spec.fill_limit, chunk_rows=chunk_rows, bound=raw)


def clean_snapshot(snapshot: DataFrame, pollutants=None,
                   drop_null_keys: bool = False) -> DataFrame:
    """Raw long snapshot to one row per station with flags and a column per pollutant
    found. Rows with an unreadable time stay."""
    return snapshot_wide(flagged_snapshot(snapshot), pollutants, drop_null_keys=drop_null_keys)


def flagged_snapshot(snapshot: DataFrame) -> DataFrame:
    """The long snapshot with names, types and both flags, exact duplicates dropped."""
    df = drop_exact_duplicates(snake_columns(snapshot))
    time = "last_update" if "last_update" in df.columns else "timestamp"
    df = parse_time(df, time, SNAPSHOT_TIME_FORMAT, into="timestamp")
    df = coerce_numeric(df, ["pollutant_min", "pollutant_max", "pollutant_avg",
                             "latitude", "longitude"])
    return add_impossible_flag(add_geo_flag(df))


def feature_table(clean: DataFrame, spec: PanelSpec, selected: DataFrame | None = None,
                  fill: bool = False, chunk_rows: int = CHUNK_ROWS,
                  bound: DataFrame | None = None) -> DataFrame:
    """The modelling table of the selected entities: calendar features, lags, rolling
    means and the checked target.

    All window columns share one shuffle and one sort. ``fill`` fills short gaps on
    the way, for a panel that was not cleaned yet. Rolling means come first because
    their helper columns are dropped before the row grows wide. ``bound`` is a cheaper table
    with at least as many rows per entity (see ``over_series``).
    """
    panel = clean if selected is None else keep_selected(clean, selected, spec.entity)

    def windows(df, by):
        if fill:
            df = forward_fill(df, spec, by=by)
        df = add_rolling_means(df, spec, by=by)
        return add_lags(add_target(df, spec, by=by), spec, by=by)

    reach = spec.feature_history + (spec.fill_limit if fill else 0)
    table = over_series(panel, spec, windows, history=reach, lookahead=spec.horizon,
                        chunk_rows=chunk_rows, bound=bound)
    table = add_cyclic_features(add_time_features(table, spec.time), spec.time)
    return table.select(*_in_order(table.columns, spec))


def _in_order(columns, spec: PanelSpec) -> list[str]:
    """Panel columns, calendar, lags, rolling means, target."""
    def place(name: str) -> int:
        if name in (spec.target, spec.target_valid):
            return 4
        if "_roll_mean_" in name:
            return 3
        if "_lag_" in name:
            return 2
        return 1 if name in (*TIME_FEATURES, *CYCLIC_FEATURES) else 0

    return sorted(columns, key=place)
