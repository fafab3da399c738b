"""Forecasts from the newest row of every entity, in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from gapwise.functions.calendar import add_cyclic_features, add_time_features
from gapwise.operators.models import Forecaster
from gapwise.operators.series import (
    add_lags, add_rolling_means, forward_fill, is_entity, newest_rows, short_histories)
from gapwise.spec import MIN_HISTORY_ROWS, PanelSpec

_RANK, _ROWS = "__rank", "__rows"


def newest_features(clean: DataFrame, spec: PanelSpec, min_rows: int = MIN_HISTORY_ROWS,
                    fill: bool = False) -> DataFrame:
    """The feature row of every entity's newest reading, for entities with at least
    ``min_rows`` rows.

    Only the rows those features look at leave the scan, so windows hold a few dozen
    rows per entity however long its series is. ``fill`` fills short gaps of a panel that
    was not filled; the rows a fill reaches back to come along.
    """
    rows = max(min_rows, spec.feature_history + 1)
    tail = newest_rows(clean, spec, rows + (spec.fill_limit if fill else 0), rank=_RANK)
    if fill:
        tail = forward_fill(tail, spec).filter(F.col(_RANK) <= rows)
    whole = Window.partitionBy(spec.entity)
    features = add_lags(add_rolling_means(tail, spec), spec)
    features = features.withColumn(_ROWS, F.count("*").over(whole))
    newest = features.filter((F.col(_RANK) == 1) & (F.col(_ROWS) >= min_rows))
    return add_cyclic_features(add_time_features(newest.drop(_RANK, _ROWS), spec.time), spec.time)


def score_latest(clean: DataFrame, forecaster: Forecaster, spec: PanelSpec, entity=None,
                 min_rows: int = MIN_HISTORY_ROWS, trained_on=None,
                 fill: bool = False) -> DataFrame:
    """One forecast per entity (or for one entity): the current and the predicted
    value, not below 0, with both times.

    ``trained_on`` lists the entities the model saw and adds ``in_training``. Entities
    with too little history give no row; ``short_histories`` names them.
    """
    known = clean.filter(F.col(spec.entity).isNotNull() & F.col(spec.time).isNotNull())
    if entity is not None:
        known = known.filter(is_entity(known, spec, entity))
    scored = forecaster.predict(newest_features(known, spec, min_rows, fill), into="__predicted")
    city = F.coalesce(F.col("city"), F.lit("Unknown")) if "city" in clean.columns else F.lit("Unknown")
    ahead = F.expr(f"INTERVAL {spec.horizon * spec.step_seconds} SECONDS")
    out = [
        F.col(spec.entity).cast("string").alias("station"),
        city.alias("city"),
        F.col(spec.target_of).alias("current_pm25"),
        F.when(F.col("__predicted").isNotNull(),
               F.greatest(F.lit(0.0), "__predicted")).alias("predicted_pm25"),
        F.lit(spec.horizon).alias("prediction_horizon_hours"),
        F.col(spec.time).alias("current_timestamp"),
        (F.col(spec.time) + ahead).alias("prediction_timestamp"),
        F.lit(forecaster.name).alias("model"),
    ]
    if trained_on is not None:
        known_ids = [str(e) for e in trained_on]
        out.append(F.col(spec.entity).cast("string").isin(known_ids).alias("in_training"))
    return scored.select(*out)


def score_station(clean: DataFrame, forecaster: Forecaster, spec: PanelSpec, entity,
                  min_rows: int = MIN_HISTORY_ROWS, fill: bool = False) -> DataFrame:
    """The forecast of one entity; raises if it is unknown or its history too short."""
    rows = clean.filter(is_entity(clean, spec, entity))
    short = short_histories(rows, spec, min_rows).first()
    if short is not None:
        raise ValueError(f"station {entity}: {short['reason']}")
    if rows.limit(1).count() == 0:
        raise ValueError(f"no rows for station {entity}")
    return score_latest(rows, forecaster, spec, min_rows=min_rows, fill=fill)
