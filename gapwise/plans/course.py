"""The whole course over a folder of tables: build, learn, judge, forecast.

Each step writes its tables below ``out`` and the next one reads them back, so steps
can be repeated alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from gapwise.functions.coerce import to_time
from gapwise.functions.names import named, require_columns, snake_columns
from gapwise.operators import audit, coverage, dedup, score, series, states
from gapwise.operators import snapshot as snapshots
from gapwise.operators.attribution import NotExplainable
from gapwise.operators.models import MODEL_ORDER
from gapwise.plans import train as training
from gapwise.operators.states import PERIOD
from gapwise.plans.build import clean_panel, feature_table, flagged_snapshot, split_readings
from gapwise.plans.sizing import broadcast_if_small, written
from gapwise.sources import bundle, sinks, tables
from gapwise.spec import (
    FILLED_SUFFIX, MIN_HISTORY_ROWS, SNAPSHOT_TIME_FORMAT, TRAIN_END, VALID_END, PanelSpec)

# Raw columns the audit looks at.
RAW_VALUES = ("PM2.5", "PM10", "NO", "NO2", "NOx", "NH3", "CO", "SO2", "O3", "Benzene",
              "Toluene", "Xylene", "AQI")


# Why a raw row is not used.
REASONS = ("surplus_cells", "unclosed_quote", "missing_cells", "unreadable_time", "null_entity")


def build(spark: SparkSession, readings: str, stations: str, snapshot: str, out: str,
          spec: PanelSpec | None = None, gates: dict | None = None,
          pattern: str | None = None, multi_line: bool = False) -> None:
    """Audit and clean the raw tables, choose stations by coverage, build features.

    The readings are read once and kept as they are, by month, in ``readings``; rows that
    cannot be used go to ``rejected`` with the reason. ``pattern`` is the format of their times;
    ``multi_line`` allows line ends inside quoted cells. Every table is written once and read
    back for what follows; panel, features and their states by month, so that
    ``rebuild_months`` can replace some.
    """
    spec = spec or PanelSpec()
    tables.verify_inputs(spark, [readings, stations, snapshot])
    marked = tables.marked_csv(spark, readings, tables.READING_COLUMNS, multi_line)
    read = stage_readings(marked, f"{out}/readings", spec, pattern)
    staged = tables.staged_readings(spark, f"{out}/readings")
    raw = tables.fitting_rows(staged.withColumn(tables.REASON, _misfit()))
    places = tables.read_stations(spark, stations)
    current = tables.read_snapshot(spark, snapshot)
    sinks.write_json(audit_raw(raw, places, current), f"{out}/audit")
    sinks.write_table(staged.filter(F.col(tables.REASON).isNotNull()), f"{out}/rejected")

    told = write_clean(spark, staged, stations, out, spec, pattern)
    clean = tables.read_panel(spark, f"{out}/clean", spec)
    for name, report in cleaning_log(raw, places, clean, read, told, spec, pattern).items():
        sinks.write_json(report, f"{out}/cleaning/{name}")

    sinks.write_table(flagged_snapshot(current), f"{out}/snapshot_long")
    long = spark.read.parquet(f"{out}/snapshot_long")
    sinks.write_table(snapshots.snapshot_wide(long), f"{out}/snapshot")
    wide = spark.read.parquet(f"{out}/snapshot")
    for name, report in snapshot_log(current, long, wide).items():
        sinks.write_json(report, f"{out}/snapshot_log/{name}")

    write_states(spark, clean, f"{out}/clean_states", spec)
    sinks.write_table(
        states.coverage_of_states(spark.read.parquet(f"{out}/clean_states"), spec), f"{out}/coverage_table")
    report = spark.read.parquet(f"{out}/coverage_table")
    sinks.write_csv(report.orderBy(F.desc("coverage"), spec.entity), f"{out}/coverage",
                    single_file=True)
    sinks.write_table(coverage.select_entities(report, **(gates or {})), f"{out}/selected")
    chosen = spark.read.parquet(f"{out}/selected")
    write_features(spark, clean, chosen, out, spec)


def rebuild_months(spark: SparkSession, readings: str, stations: str, out: str,
                   spec: PanelSpec | None = None, pattern: str | None = None,
                   multi_line: bool = False) -> list[int]:
    """Add a late file of readings to what ``build`` wrote and replace the months it touches.

    The file's months are those of its readable times; also replaced are months whose fills,
    features or targets reach into them. Only these months, and those that hold the rows which
    windows look back or ahead to, are read; the files of all others stay untouched. The
    stations with features stay those that were chosen. Returns the months of the new rows.
    """
    spec = spec or PanelSpec()
    tables.verify_inputs(spark, [readings, stations, f"{out}/readings"])
    marked = tables.marked_csv(spark, readings, tables.READING_COLUMNS, multi_line)
    late = written(_placed(marked, spec, pattern), "late")
    months = sorted(r[0] for r in late.filter(F.col(PERIOD).isNotNull()).select(PERIOD).distinct().collect())
    late.write.mode("append").partitionBy(PERIOD).parquet(f"{out}/readings")
    late.filter(F.col(tables.REASON).isNotNull()).drop(PERIOD).write.mode("append").parquet(f"{out}/rejected")
    if not months:
        return months

    names = dict(zip(snake_columns(marked).columns, marked.columns))
    touched = late.filter(F.col(PERIOD).isNotNull()).select(
        named(names[spec.entity]).alias(spec.entity)).distinct()
    fill, reach = spec.fill_limit, spec.feature_history

    def states_of(entities=None):
        known = spark.read.parquet(f"{out}/clean_states")
        return known if entities is None else known.join(
            broadcast_if_small(entities), spec.entity, "left_semi")

    changed = states.reached_periods(states_of(touched), spec, months, ahead=fill)
    read = states.reached_periods(states_of(), spec, changed, back=fill)
    staged = tables.staged_readings(spark, f"{out}/readings", read)
    write_clean(spark, staged, stations, out, spec, pattern, changed)
    write_states(spark, tables.read_panel(spark, f"{out}/clean", spec, periods=changed),
                 f"{out}/clean_states", spec, only_these=True)

    wanted = states.reached_periods(
        states_of(touched), spec, months, back=spec.horizon, ahead=reach + fill)
    read = states.reached_periods(states_of(), spec, wanted, back=reach, ahead=spec.horizon)
    clean = tables.read_panel(spark, f"{out}/clean", spec, periods=read)
    write_features(spark, clean, spark.read.parquet(f"{out}/selected"), out, spec, wanted)
    return months


def _misfit():
    """The reason of rows that do not fit the header; others are rows of the raw table."""
    reason = F.col(tables.REASON)
    return F.when(reason.isin(*REASONS[:3]), reason)


def _placed(marked: DataFrame, spec: PanelSpec, pattern: str | None) -> DataFrame:
    """Marked rows with the reason they are not used, if any, and their month."""
    names = dict(zip(snake_columns(marked).columns, marked.columns))
    require_columns(snake_columns(marked), spec.keys, "readings")
    time = to_time(names[spec.time], marked.schema[names[spec.time]].dataType, pattern)
    reason = F.coalesce(
        tables.REASON, F.when(time.isNull(), "unreadable_time"),
        F.when(named(names[spec.entity]).isNull(), "null_entity"))
    return marked.withColumns({tables.REASON: reason, PERIOD: states.period_of(time)})


def stage_readings(marked: DataFrame, path: str, spec: PanelSpec, pattern: str | None = None) -> dict:
    """Write marked readings by month. Returns the rows read and rejected, counted on the way."""
    told = Observation()
    counts = [F.count_if(F.coalesce(F.col(tables.REASON) == r, F.lit(False))).alias(r) for r in REASONS]
    placed = _placed(marked, spec, pattern)
    sinks.write_periods(placed.observe(told, F.count(F.lit(1)).alias("rows_read"), *counts), path, PERIOD)
    return told.get


def write_clean(spark: SparkSession, staged: DataFrame, stations: str, out: str, spec: PanelSpec,
                pattern: str | None = None, months=None) -> dict:
    """Clean staged readings and write the panel by month, or only some months of it.
    Returns what was counted on the way."""
    good = tables.fitting_rows(staged, keep_order=True)
    panel = clean_panel(good, tables.read_stations(spark, stations), spec, pattern=pattern,
                        order=tables.FILE_ORDER)
    panel = states.with_period(panel, spec)
    if months is not None:
        panel = panel.filter(F.col(PERIOD).isin(months))
    told = Observation()
    sinks.write_periods(panel.observe(told, *_counts(panel, spec)), f"{out}/clean", PERIOD,
                        only_these=months is not None)
    return told.get


def _counts(panel: DataFrame, spec: PanelSpec) -> list:
    """All that one pass over the cleaned panel tells, as flat aggregates."""
    name = F.col("station_name") if "station_name" in panel.columns else F.lit(None)
    out = [F.count(F.lit(1)).alias("n_rows"), F.count_if("negative_value_flag").alias("negative"),
           F.min(spec.time).alias("min_time"), F.max(spec.time).alias("max_time"),
           F.count_if(name.isNull()).alias("n_missing_metadata")]
    for c in spec.present(panel.columns):
        if c + FILLED_SUFFIX in panel.columns:
            out += [F.count_if(F.col(c + FILLED_SUFFIX)).alias(f"{c}:filled"),
                    F.count_if(F.col(c).isNull()).alias(f"{c}:missing_after")]
    return out


def write_states(spark: SparkSession, panel: DataFrame, path: str, spec: PanelSpec,
                 only_these: bool = False) -> None:
    """The states of a panel by month; a month's states are a small file."""
    sinks.write_periods(states.period_states(panel, spec), path, PERIOD, only_these)


def write_features(spark: SparkSession, clean: DataFrame, chosen: DataFrame, out: str,
                   spec: PanelSpec, months=None) -> None:
    """Features of the chosen stations by month, or only some months, and their states."""
    table = states.with_period(feature_table(clean, spec, chosen), spec)
    if months is not None:
        table = table.filter(F.col(PERIOD).isin(months))
    sinks.write_periods(table, f"{out}/features", PERIOD, only_these=months is not None)
    features = tables.read_panel(spark, f"{out}/features", spec, periods=months)
    write_states(spark, features, f"{out}/feature_states", spec, only_these=months is not None)


def audit_raw(readings: DataFrame, stations: DataFrame, snapshot: DataFrame) -> DataFrame:
    """The audits of the three raw tables in one report."""
    parts = [
        audit.table_report(readings, "readings", ["StationId"], "Datetime", None, RAW_VALUES,
                           ["StationId", "Datetime"]),
        audit.table_report(stations, "stations", ["City", "State", "StationId"]),
        audit.table_report(snapshot, "snapshot", ["city", "station"], "last_update",
                           SNAPSHOT_TIME_FORMAT),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def cleaning_log(raw: DataFrame, places: DataFrame, clean: DataFrame, read: dict, told: dict,
                 spec: PanelSpec, pattern: str | None = None) -> dict[str, DataFrame]:
    """What cleaning did, as small tables. ``read`` and ``told`` were counted while staging
    the readings and writing the panel."""
    spark = raw.sparkSession
    good, _ = split_readings(raw, spec, pattern)
    rejected = [(r, read[r]) for r in REASONS if read[r]]
    fills = [(c, told[f"{c}:filled"] + told[f"{c}:missing_after"], told[f"{c}:filled"],
              told[f"{c}:missing_after"])
             for c in spec.values if f"{c}:filled" in told]
    return {
        "stages": audit.stage_counts(snake_columns(raw), spec, pattern),
        "duplicated_keys": dedup.rows_in_duplicated_keys(good, spec.keys),
        "station_duplicates": dedup.exact_duplicate_count(places),
        "rows": spark.createDataFrame([(read["rows_read"], told["n_rows"])],
                                      "rows_read long, rows_cleaned long"),
        "rejected": spark.createDataFrame(rejected, "reason string, n_rows long"),
        "negative": spark.createDataFrame([(told["negative"],)], "rows_with_negative_value long"),
        "fills": spark.createDataFrame(
            fills, "column string, missing_before long, filled long, missing_after long"),
        "time_range": spark.createDataFrame(
            [(told["min_time"], told["max_time"], 0)],
            "min_time timestamp_ntz, max_time timestamp_ntz, unparseable long"),
        "distinct": audit.distinct_counts(
            clean, [c for c in (spec.entity, "city") if c in clean.columns]),
        "metadata": spark.createDataFrame(
            [(told["n_rows"], told["n_missing_metadata"])], "n_rows long, n_missing_metadata long"),
    }


def snapshot_log(raw: DataFrame, long: DataFrame, wide: DataFrame) -> dict[str, DataFrame]:
    """What the snapshot holds, as small tables."""
    return {
        "rows": raw.agg(F.count("*").alias("rows_read")).join(long.agg(
            F.count("*").alias("rows_distinct"),
            F.count_if(F.col("timestamp").isNull()).alias("unreadable_times"),
            F.count_if(F.col("lat_lon_flag_invalid")).alias("rows_outside"),
            F.count_if(F.col("pollutant_flag_impossible")).alias("rows_impossible"),
            F.count_if(F.col("pollutant_avg").isNull()).alias("missing_averages"),
            F.count_distinct("station").alias("n_stations"),
            F.count_distinct("city").alias("n_cities"),
        )).join(wide.agg(F.count("*").alias("rows_wide"))),
        "time": snapshots.single_timestamp(long),
        "duplicate_combinations": snapshots.duplicate_combinations(long),
    }


def learn(spark: SparkSession, out: str, spec: PanelSpec | None = None,
          train_end: str = TRAIN_END, valid_end: str = VALID_END, models=MODEL_ORDER,
          deep_gates: dict | None = None, forest: dict | None = None,
          boosted: dict | None = None) -> training.Training:
    """Choose the modelling stations, train and keep the best model."""
    spec = spec or PanelSpec()
    features = tables.read_panel(spark, f"{out}/features", spec)
    known = spark.read.parquet(f"{out}/feature_states")
    sinks.write_table(states.deep_coverage_of_states(known, spec), f"{out}/coverage_deep_table")
    report = spark.read.parquet(f"{out}/coverage_deep_table")
    sinks.write_csv(report.orderBy(F.desc("usable_rows"), spec.entity), f"{out}/coverage_deep",
                    single_file=True)
    picked = coverage.recommend_subset(report, spec, **(deep_gates or {}))
    ids = [r[spec.entity] for r in picked.collect()]
    done = training.train(features, _ids(spark, ids, spec), spec, train_end, valid_end, models,
                          forest, boosted)
    bundle.save_bundle(spark, done.best, f"{out}/model",
                       done.metadata(spec, ids, train_end, valid_end))
    return done


def judge(spark: SparkSession, out: str, spec: PanelSpec | None = None,
          sample_rows: int | None = None) -> None:
    """Error reports of the saved model on the held-out rows, and its explanation.
    Nothing is fitted; a model without a learned function gets no explanation. All held-out
    rows are explained, or a sample of ``sample_rows``."""
    spec = spec or PanelSpec()
    forecaster, meta = bundle.load_bundle(spark, f"{out}/model"), bundle.load_metadata(
        spark, f"{out}/model")
    features = tables.read_panel(spark, f"{out}/features", spec)
    dates = meta["split_boundaries"]
    rows = training.test_rows(features, _ids(spark, meta["stations_used"], spec), spec,
                              dates["train_end_date"], dates["valid_end_date"])
    names = None
    if "station_name" in features.columns:
        names = spark.read.parquet(f"{out}/coverage_deep_table").select(spec.entity, "station_name")
    for name, report in training.evaluate(rows, forecaster, spec, names).items():
        sinks.write_csv(report, f"{out}/evaluation/{name}", single_file=True)
    try:
        told = training.explain(rows, forecaster, spec, meta.get("training_means"), sample_rows)
    except NotExplainable:
        return
    sinks.write_csv(told["importance"], f"{out}/explanation/importance", single_file=True)
    sinks.write_json(told["example"], f"{out}/explanation/example")


def forecast(spark: SparkSession, out: str, spec: PanelSpec | None = None, station=None,
             min_rows: int = MIN_HISTORY_ROWS) -> DataFrame:
    """Forecasts of all stations with enough history, or of one (which must have it). Only
    the months that hold a station's newest rows are read: its states name them."""
    spec = spec or PanelSpec()
    forecaster = bundle.load_bundle(spark, f"{out}/model")
    clean = newest_months(spark, out, spec, max(min_rows, spec.feature_history + 1), station)
    if station is not None:
        return score.score_station(clean, forecaster, spec, station, min_rows)
    trained_on = bundle.load_metadata(spark, f"{out}/model")["stations_used"]
    return score.score_latest(clean, forecaster, spec, min_rows=min_rows, trained_on=trained_on)


def newest_months(spark: SparkSession, out: str, spec: PanelSpec, rows: int, station=None) -> DataFrame:
    """The cleaned panel's months that hold the last ``rows`` rows of any station, or of one,
    less the months of a station that lie before its own."""
    known = spark.read.parquet(f"{out}/clean_states")
    if station is not None:
        known = known.filter(series.is_entity(known, spec, station))
    wanted = written(states.newest_periods(known, spec, rows), "newest")
    # At most as many as the calendar has months.
    months = [r[0] for r in wanted.select(PERIOD).distinct().collect()]
    clean = states.with_period(tables.read_panel(spark, f"{out}/clean", spec, periods=months), spec)
    return clean.join(broadcast_if_small(wanted), [spec.entity, PERIOD], "left_semi").select(
        *[c for c in clean.columns if c != PERIOD])


def without_forecast(spark: SparkSession, out: str, spec: PanelSpec | None = None,
                     min_rows: int = MIN_HISTORY_ROWS) -> DataFrame:
    """The stations ``forecast`` leaves out, with the reason, from the states."""
    spec = spec or PanelSpec()
    return states.short_entities(spark.read.parquet(f"{out}/clean_states"), spec, min_rows)


def _ids(spark: SparkSession, ids, spec: PanelSpec) -> DataFrame:
    """The chosen stations as a table: at most as many as a subset may hold."""
    kind = "long" if ids and isinstance(ids[0], int) else "string"
    return spark.createDataFrame([(i,) for i in ids], f"`{spec.entity}` {kind}")
