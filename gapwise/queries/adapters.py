"""Views of the given tables in the shapes the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gapwise.functions.coerce import parse_time
from gapwise.operators.coverage import deep_coverage, recommend_subset
from gapwise.operators.impute import fit_medians
from gapwise.operators.series import add_target, forward_fill
from gapwise.operators.split import feature_columns, usable_rows, with_split
from gapwise.plans.build import feature_table
from gapwise.plans.chunks import over_series
from gapwise.plans.sizing import written
from gapwise.spec import SNAPSHOT_TIME_FORMAT, PanelSpec

# Which event type stands for which quantity.
QUANTITIES = {"pm2_5": "view", "pm10": "click", "no2": "purchase", "co": "signup",
              "so2": "error"}
SNAPSHOT_NAMES = {"view": "PM2.5", "click": "PM10", "purchase": "NO2", "signup": "CO",
                  "error": "SO2"}
RAW_NAMES = ("StationId", "Datetime", "PM2.5", "PM10", "NO2", "CO", "SO2")
SPEC = PanelSpec(values=tuple(QUANTITIES), lagged=("pm2_5", "pm10", "no2", "so2", "co"))
USER_SPEC = PanelSpec(entity="user_id", values=tuple(QUANTITIES), lagged=SPEC.lagged)
USERS_PER_STATION = 30

# Thresholds for 30 days of data.
TRAIN_END, VALID_END = "2024-01-19", "2024-01-25"
GATES = {"min_coverage": 0.82, "min_span_days": 28, "min_records": 500}
DEEP_GATES = {"max_missing": 60.0, "min_continuity": 70.0, "size": 3}
LONG_HISTORY = 60


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hourly(events: DataFrame, entity, name: str) -> DataFrame:
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    return events.groupBy(entity.alias(name), hour.alias("datetime")).agg(*[
        F.max(F.when(F.col("event_type") == kind, F.col("value"))).alias(q)
        for q, kind in QUANTITIES.items()])


def station_of():
    return F.expr(f"user_id div {USERS_PER_STATION}")


def readings(spark, sf_dir) -> DataFrame:
    """Hourly peaks per station: one row per station and hour with any event."""
    return _hourly(table(spark, sf_dir, "events"), station_of(), "station_id")


def user_readings(spark, sf_dir) -> DataFrame:
    """The same per user: many short series."""
    return _hourly(table(spark, sf_dir, "events"), F.col("user_id"), "user_id")


def raw_rows(spark, sf_dir) -> DataFrame:
    """Uncleaned rows: repeated, with the time as text that is sometimes no time."""
    e = table(spark, sf_dir, "events")
    text = F.when(F.col("event_type") == "error", F.col("props")).otherwise(
        F.date_format("ts", "yyyy-MM-dd HH:00:00"))
    return e.select("event_id", station_of().alias("station_id"), text.alias("datetime"),
                    "event_type")


def stations(spark, sf_dir) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").cast("long").alias("station_id"),
        F.concat_ws("/", "n_name", "r_name").alias("station_name"),
        F.col("n_name").alias("city"), F.col("r_name").alias("state"))


def snapshot_long(spark, sf_dir) -> DataFrame:
    """One row per station, hour and quantity. A mean of a single reading is missing;
    the lower bound allows for a zero offset of 1."""
    e = table(spark, sf_dir, "events")
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    place = stations(spark, sf_dir)
    value = F.col("value")
    pollutant = F.create_map(*[F.lit(x) for kv in SNAPSHOT_NAMES.items() for x in kv])
    grouped = e.groupBy(
        station_of().alias("station_id"), hour.alias("hour"),
        pollutant[F.col("event_type")].alias("pollutant_id"),
    ).agg((F.min(value) - 1.0).alias("pollutant_min"), F.max(value).alias("pollutant_max"),
          F.when(F.count("*") > 1, F.avg(value)).alias("pollutant_avg"))
    return grouped.join(place, "station_id", "left").select(
        F.lit("IN").alias("country"), "state", "city",
        F.concat(F.lit("S"), F.col("station_id").cast("string")).alias("station"),
        F.date_format("hour", SNAPSHOT_TIME_FORMAT).alias("last_update"),
        (F.col("station_id") + 5.0).alias("latitude"),
        (F.col("station_id") + 70.0).alias("longitude"),
        "pollutant_id", "pollutant_min", "pollutant_max", "pollutant_avg")


def parsed_snapshot(spark, sf_dir) -> DataFrame:
    return parse_time(snapshot_long(spark, sf_dir), "last_update", SNAPSHOT_TIME_FORMAT,
                      into="timestamp")


def sources(spark, sf_dir) -> DataFrame:
    """The events behind the readings: never fewer per station."""
    return table(spark, sf_dir, "events").select(station_of().alias("station_id"))


def filled(spark, sf_dir) -> DataFrame:
    return over_series(readings(spark, sf_dir), SPEC,
                       lambda d, by: forward_fill(d, SPEC, by=by), history=SPEC.fill_limit,
                       bound=sources(spark, sf_dir))


def features(spark, sf_dir, only=None) -> DataFrame:
    panel = readings(spark, sf_dir)
    if only is not None:
        panel = panel.filter(F.col("station_id").isin(only))
    return feature_table(panel, SPEC, fill=True, bound=sources(spark, sf_dir))


def labelled(spark, sf_dir, only=None) -> DataFrame:
    """Filled readings with the target: all that coverage needs of the features."""
    panel = readings(spark, sf_dir)
    if only is not None:
        panel = panel.filter(F.col("station_id").isin(only))

    def fill_then_target(df, by):
        return add_target(forward_fill(df, SPEC, by=by), SPEC, by=by)

    return over_series(panel, SPEC, fill_then_target,
                       history=SPEC.fill_limit, lookahead=SPEC.horizon,
                       bound=sources(spark, sf_dir))


def recommended_ids(spark, sf_dir) -> list[int]:
    """The chosen stations: at most as many as the subset may hold."""
    report = deep_coverage(labelled(spark, sf_dir), SPEC)
    return [r["station_id"] for r in recommend_subset(report, SPEC, **DEEP_GATES).collect()]


def modeling_rows(spark, sf_dir, columns=None) -> DataFrame:
    """Usable rows of the chosen stations with their split, written for several passes.
    With ``columns`` only those and what they need are computed."""
    ids = recommended_ids(spark, sf_dir)
    plain = columns is not None and set(columns) <= set(SPEC.values)
    table_of = labelled if plain else features
    rows = with_split(usable_rows(table_of(spark, sf_dir, ids), SPEC), SPEC, TRAIN_END, VALID_END)
    if columns is not None:
        rows = rows.select(*SPEC.keys, "split", SPEC.target, *columns)
    return written(rows, "modeling")


def fitted_medians(rows: DataFrame, columns=None) -> dict[str, float]:
    columns = columns or feature_columns(rows.columns, SPEC)
    return fit_medians(rows.filter(F.col("split") == "train"), columns)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of a sum cannot show."""
    return df.select(*[
        F.round(F.col(f"`{c}`"), digits).alias(c) if kind == "double" else F.col(f"`{c}`")
        for c, kind in df.dtypes])
