"""The queries: name to function of (session, folder of the tables)."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from gapwise.functions.aqi import add_forecast_change, aqi_category
from gapwise.functions.calendar import (
    CYCLIC_FEATURES, TIME_FEATURES, add_cyclic_features, add_time_features)
from gapwise.functions.coerce import coerce_numeric, parse_time, parse_time_or_drop
from gapwise.functions.flags import add_geo_flag, add_impossible_flag, add_negative_flag
from gapwise.functions.names import snake_columns
from gapwise.operators import attribution as attr
from gapwise.operators import (
    audit, coverage, dedup, joins, metrics, series, snapshot, split, states)
from gapwise.operators.impute import impute, median_table
from gapwise.operators.models import (
    BOOSTED, FOREST, LINEAR, MODEL_ORDER, PERSISTENCE, PREDICTION, Forecaster)
from gapwise.operators.score import score_latest as score_newest, score_station
from gapwise.plans import train as training
from gapwise.plans.build import clean_panel, split_readings
from gapwise.plans.chunks import over_series
from gapwise.queries.adapters import (
    DEEP_GATES, GATES, LONG_HISTORY, RAW_NAMES, SNAPSHOT_NAMES, SPEC, TRAIN_END, USER_SPEC,
    VALID_END, features, filled, fitted_medians, labelled, modeling_rows, parsed_snapshot, raw_rows,
    readings, recommended_ids, rounded, snapshot_long, sources, station_of, stations, table, user_readings)
from gapwise.session import shared_dir
from gapwise.sources import sinks
from gapwise.sources.bundle import load_bundle, save_bundle

QUERIES = {}
KEYS = SPEC.keys
EXPLAINED = ("pm2_5", "pm2_5_lag_1h", "pm2_5_roll_mean_3h")


def query(fn):
    """Register a query; a name that is taken by its operator carries a suffix."""
    QUERIES[fn.__name__.removesuffix("_query")] = fn
    return fn


# Names, types, flags -------------------------------------------------------------

@query
def snake_columns_query(spark, sf_dir):
    return snake_columns(readings(spark, sf_dir).toDF(*RAW_NAMES))


@query
def parse_drop_bad_time(spark, sf_dir):
    return parse_time_or_drop(raw_rows(spark, sf_dir), "datetime")


@query
def parse_snapshot_time(spark, sf_dir):
    rows = raw_rows(spark, sf_dir).join(
        table(spark, sf_dir, "events").select("event_id", "ts"), "event_id")
    text = F.when(F.col("event_type") == "click", F.col("datetime")).otherwise(
        F.date_format("ts", "dd-MM-yyyy HH:mm:ss"))
    return parse_time(rows.select("event_id", text.alias("last_update")), "last_update",
                      "dd-MM-yyyy HH:mm:ss", into="timestamp")


@query
def coerce_numeric_query(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    number = F.col("value").cast("string")
    kind = F.col("event_type")
    text = (F.when(kind == "error", F.col("props"))
            .when(kind == "click", F.concat(number, F.lit("d")))
            .when(kind == "signup", F.concat(F.lit(" "), number, F.lit("e1 ")))
            .when(kind == "purchase", F.lit("NaN"))
            .otherwise(number))
    return rounded(coerce_numeric(e.select("event_id", text.alias("reading")), ["reading"]))


def _balances(spark, sf_dir) -> DataFrame:
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return c.join(s, F.col("c_custkey") == F.col("s_suppkey"), "left").select(
        "c_custkey", "c_acctbal", "s_acctbal")


@query
def negative_flag(spark, sf_dir):
    return add_negative_flag(_balances(spark, sf_dir), ["c_acctbal", "s_acctbal"])


@query
def geo_flag(spark, sf_dir):
    e, n = table(spark, sf_dir, "events"), table(spark, sf_dir, "nation")
    at = e.join(n, F.col("user_id") == F.col("n_nationkey"), "left").select(
        "event_id", (F.col("user_id") / 2.0).alias("latitude"),
        (F.col("n_nationkey") + 60.0).alias("longitude"))
    return add_geo_flag(at)


@query
def impossible_flag(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_tax").alias("pollutant_min"),
        F.col("l_discount").alias("pollutant_max"),
        (F.col("l_discount") - F.col("l_tax")).alias("pollutant_avg"))
    return rounded(add_impossible_flag(rows))


@query
def aqi_category_query(spark, sf_dir):
    return readings(spark, sf_dir).select(
        *KEYS, "pm2_5", aqi_category(F.col("pm2_5")).alias("category"))


@query
def forecast_change(spark, sf_dir):
    rows = readings(spark, sf_dir).select(
        *KEYS, F.col("pm2_5").alias("current_pm25"), F.col("pm10").alias("predicted_pm25"))
    return rounded(add_forecast_change(rows))


# Joins ---------------------------------------------------------------------------

def _enriched_users(spark, sf_dir) -> DataFrame:
    place = stations(spark, sf_dir).withColumnRenamed("station_id", "user_id")
    return joins.enrich(user_readings(spark, sf_dir), place, "user_id")


@query
def enrich_left_join(spark, sf_dir):
    return _enriched_users(spark, sf_dir).select(
        "user_id", "datetime", "pm2_5", "station_name", "city", "state")


@query
def missing_metadata(spark, sf_dir):
    return joins.missing_metadata(_enriched_users(spark, sf_dir), "station_name")


@query
def semi_join_selected(spark, sf_dir):
    return joins.keep_selected(readings(spark, sf_dir), select_stations(spark, sf_dir),
                               "station_id")


# Duplicates ----------------------------------------------------------------------

@query
def exact_dedup(spark, sf_dir):
    return dedup.drop_exact_duplicates(
        table(spark, sf_dir, "documents").select("text", "lang"))


@query
def exact_dup_count(spark, sf_dir):
    return dedup.exact_duplicate_count(
        table(spark, sf_dir, "documents").select("text", "lang"))


def _whole_rows(spark, sf_dir) -> DataFrame:
    """Raw readings without the number of the event: many rows are equal in all columns."""
    return raw_rows(spark, sf_dir).drop("event_id")


@query
def exact_dedup_rows(spark, sf_dir):
    return dedup.drop_exact_duplicates(_whole_rows(spark, sf_dir))


@query
def exact_dup_count_rows(spark, sf_dir):
    return dedup.exact_duplicate_count(_whole_rows(spark, sf_dir))


@query
def dup_key_rows(spark, sf_dir):
    return dedup.rows_in_duplicated_keys(
        table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query
def dedup_keep_first(spark, sf_dir):
    return dedup.keep_first(
        table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"],
        ["l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity",
         "l_discount", "l_tax", "l_returnflag", "l_linestatus"])


# Audit ---------------------------------------------------------------------------

@query
def audit_missing(spark, sf_dir):
    return audit.missing_values(readings(spark, sf_dir))


@query
def audit_distinct(spark, sf_dir):
    return audit.distinct_counts(table(spark, sf_dir, "orders"),
                                 ["o_custkey", "o_orderstatus", "o_orderpriority"])


@query
def audit_distinct_sketch(spark, sf_dir):
    """Distinct values estimated from sketches per event type, and whether the estimate lies
    within 3 % of the exact count."""
    columns = ("event_id", "user_id", "ts")
    e = table(spark, sf_dir, "events")
    merged = states.distinct_estimates(states.distinct_sketches(e, columns, ["event_type"]), columns)
    exact = audit.distinct_counts(e, columns)
    close = F.abs(F.col("n_estimated") - F.col("n_distinct")) <= 0.03 * F.col("n_distinct")
    return exact.join(merged, "column").select("column", "n_distinct", close.alias("estimate_is_close"))


@query
def audit_time_range(spark, sf_dir):
    return audit.time_range(raw_rows(spark, sf_dir), "datetime")


@query
def audit_numeric_ranges(spark, sf_dir):
    return rounded(audit.numeric_ranges(readings(spark, sf_dir), SPEC.values))


@query
def audit_negatives(spark, sf_dir):
    return audit.negative_counts(_balances(spark, sf_dir), ["c_acctbal", "s_acctbal"])


@query
def fill_report(spark, sf_dir):
    return audit.fill_report(filled(spark, sf_dir), SPEC)


@query
def stage_counts(spark, sf_dir):
    return audit.stage_counts(raw_rows(spark, sf_dir).drop("event_id"), SPEC)


# Coverage and selection ----------------------------------------------------------

def _coverage(spark, sf_dir) -> DataFrame:
    return coverage.coverage_report(
        joins.enrich(filled(spark, sf_dir), stations(spark, sf_dir), "station_id"), SPEC)


@query
def coverage_report(spark, sf_dir):
    return rounded(_coverage(spark, sf_dir))


@query
def select_stations(spark, sf_dir):
    return coverage.select_entities(_coverage(spark, sf_dir), **GATES).select(
        "station_id", "n_records", "span_days")


def _deep(spark, sf_dir) -> DataFrame:
    return coverage.deep_coverage(labelled(spark, sf_dir), SPEC)


@query
def coverage_deep(spark, sf_dir):
    return _deep(spark, sf_dir)


@query
def coverage_deep_incremental(spark, sf_dir):
    """The same report from stored states per station and day: the earlier days first, then
    each later part added to them without reading the earlier rows."""
    path = f"{shared_dir(spark)}/states-{uuid.uuid4().hex}"
    rows = labelled(spark, sf_dir)
    day = states.period_of(F.col(SPEC.time), "day")
    for days in (day < 20240116, day == 20240116, day > 20240116):
        part = states.period_states(rows.filter(days), SPEC, "day")
        part.write.mode("append").partitionBy(states.PERIOD).parquet(path)
    return states.deep_coverage_of_states(spark.read.parquet(path), SPEC)


@query
def coverage_of_states(spark, sf_dir):
    """The first report from states per station and day, written and read back."""
    path = f"{shared_dir(spark)}/states-{uuid.uuid4().hex}"
    rows = joins.enrich(filled(spark, sf_dir), stations(spark, sf_dir), "station_id")
    sinks.write_periods(states.period_states(rows, SPEC, "day"), path, states.PERIOD)
    return rounded(states.coverage_of_states(spark.read.parquet(path), SPEC))


@query
def newest_days(spark, sf_dir):
    """The days, per station, that hold its last 30 rows, from the states alone."""
    known = states.period_states(readings(spark, sf_dir), SPEC, "day")
    return states.newest_periods(known, SPEC, 30)


@query
def recommend_subset(spark, sf_dir):
    return coverage.recommend_subset(_deep(spark, sf_dir), SPEC, **DEEP_GATES).select(
        "station_id", "usable_rows")


# Snapshot ------------------------------------------------------------------------

@query
def snapshot_is_single(spark, sf_dir):
    return snapshot.single_timestamp(parsed_snapshot(spark, sf_dir))


@query
def snapshot_wide(spark, sf_dir):
    flagged = add_impossible_flag(add_geo_flag(parsed_snapshot(spark, sf_dir)))
    return rounded(snapshot.snapshot_wide(flagged))


@query
def snapshot_repeated_rows(spark, sf_dir):
    """Every event a row: several rows per place and quantity, some places without a city."""
    e = table(spark, sf_dir, "events")
    names = F.create_map(*[F.lit(x) for kv in SNAPSHOT_NAMES.items() for x in kv])
    value = F.col("value")
    rows = e.select(
        F.lit("IN").alias("country"), F.lit(None).cast("string").alias("state"),
        F.when(F.col("user_id") % 2 == 0, F.lit("even")).alias("city"),
        F.concat(F.lit("U"), (F.col("user_id") % 50).cast("string")).alias("station"),
        F.date_trunc("day", "ts").cast("timestamp_ntz").alias("timestamp"),
        F.lit(20.0).alias("latitude"), F.lit(80.0).alias("longitude"),
        names[F.col("event_type")].alias("pollutant_id"), (value - 1.0).alias("pollutant_min"),
        value.alias("pollutant_max"),
        F.when(F.col("event_id") % 3 > 0, value).alias("pollutant_avg"))
    return rounded(snapshot.snapshot_wide(add_impossible_flag(rows)))


@query
def snapshot_is_one_time(spark, sf_dir):
    one = table(spark, sf_dir, "events").select(
        F.when(F.col("event_id") % 2 == 0, F.lit("2024-01-05 00:00:00")).cast(
            "timestamp_ntz").alias("timestamp"))
    return snapshot.single_timestamp(one)


# Cleaning ------------------------------------------------------------------------

def _raw_readings(spark, sf_dir) -> DataFrame:
    """Readings as files have them: unreadable times, rows without a station, repeated keys."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.when(F.col("user_id") % 7 > 0, station_of()).alias("StationId"),
        F.when(kind == "error", F.col("props")).when(kind == "signup", F.lit("2024-01")).otherwise(
            F.date_format("ts", "yyyy-MM-dd HH:00:00")).alias("Datetime"),
        F.when(kind != "click", F.col("value") - 20.0).alias("PM2.5"))


@query
def clean_panel_query(spark, sf_dir):
    return rounded(clean_panel(_raw_readings(spark, sf_dir), stations(spark, sf_dir), SPEC))


@query
def rejected_rows(spark, sf_dir):
    return split_readings(_raw_readings(spark, sf_dir), SPEC)[1].withColumn(
        "station_id", F.col("station_id").cast("string"))


# Series --------------------------------------------------------------------------

@query
def ffill_limited(spark, sf_dir):
    return filled(spark, sf_dir)


@query
def time_features(spark, sf_dir):
    return add_time_features(readings(spark, sf_dir)).select(*KEYS, *TIME_FEATURES)


@query
def cyclic_features(spark, sf_dir):
    return rounded(add_cyclic_features(readings(spark, sf_dir)).select(*KEYS, *CYCLIC_FEATURES))


def _over(spark, sf_dir, fn, history, lookahead=0):
    return over_series(readings(spark, sf_dir), SPEC, fn, history, lookahead,
                       bound=sources(spark, sf_dir))


@query
def lag_features(spark, sf_dir):
    return _over(spark, sf_dir, lambda d, by: series.add_lags(d, SPEC, by=by),
                 SPEC.feature_history)


@query
def rolling_features(spark, sf_dir):
    return rounded(_over(spark, sf_dir,
                         lambda d, by: series.add_rolling_means(d, SPEC, by=by),
                         SPEC.feature_history))


@query
def target_ahead(spark, sf_dir):
    return labelled(spark, sf_dir).select(*KEYS, "pm2_5", SPEC.target, SPEC.target_valid)


@query
def feature_table(spark, sf_dir):
    return rounded(features(spark, sf_dir))


@query
def latest_per_station(spark, sf_dir):
    return series.latest_rows(readings(spark, sf_dir), SPEC)


@query
def insufficient_history(spark, sf_dir):
    return series.short_histories(user_readings(spark, sf_dir), USER_SPEC, LONG_HISTORY)


@query
def recent_trend(spark, sf_dir):
    return series.recent_trend(readings(spark, sf_dir), SPEC)


@query
def stations_list(spark, sf_dir):
    return series.entity_list(readings(spark, sf_dir), SPEC)


# Split and imputation ------------------------------------------------------------

@query
def usable_rows(spark, sf_dir):
    return split.usable_rows(labelled(spark, sf_dir), SPEC).select(*KEYS, "pm2_5", SPEC.target)


@query
def modeling_set(spark, sf_dir):
    chosen = recommend_subset(spark, sf_dir)
    return split.modeling_set(labelled(spark, sf_dir), chosen, SPEC).select(
        *KEYS, "pm2_5", SPEC.target)


@query
def chrono_split(spark, sf_dir):
    return split.with_split(readings(spark, sf_dir), SPEC, TRAIN_END, VALID_END).select(
        *KEYS, "split")


@query
def split_summary(spark, sf_dir):
    return split.split_summary(modeling_rows(spark, sf_dir, ["pm2_5"]), SPEC)


@query
def median_fit(spark, sf_dir):
    return rounded(median_table(spark, fitted_medians(modeling_rows(spark, sf_dir))))


@query
def median_impute(spark, sf_dir):
    rows = modeling_rows(spark, sf_dir, SPEC.values)
    ready = impute(rows, fitted_medians(rows, SPEC.values))
    return rounded(ready.select(*KEYS, "split", *SPEC.values))


@query
def median_impute_all(spark, sf_dir):
    """All features imputed: per row how many had no value, and the sum of all of them."""
    rows = modeling_rows(spark, sf_dir)
    names = sorted(split.feature_columns(rows.columns, SPEC))
    missing = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("long") for c in names])
    total = reduce(lambda a, b: a + b, [F.col(c).cast("double") for c in names])
    ready = impute(rows.withColumn("n_missing", missing), fitted_medians(rows, names))
    return ready.select(*KEYS, "split", "n_missing", F.round(total, 3).alias("total"))


@query
def seeded_sample(spark, sf_dir):
    return split.seeded_sample(table(spark, sf_dir, "orders"), ["o_orderkey"], 1000)


# Metrics -------------------------------------------------------------------------

def _persistence(rows: DataFrame, part: str) -> DataFrame:
    """Target and imputed current value of one split."""
    ready = impute(rows, fitted_medians(rows, ["pm2_5"])).filter(F.col("split") == part)
    return ready.select(*KEYS, F.col(SPEC.target).alias("actual"),
                        F.col("pm2_5").alias("predicted"))


def _test_pairs(spark, sf_dir) -> DataFrame:
    return _persistence(modeling_rows(spark, sf_dir, ["pm2_5"]), "test")


@query
def persistence_metrics(spark, sf_dir):
    return rounded(metrics.regression_metrics(
        _persistence(modeling_rows(spark, sf_dir, ["pm2_5"]), "valid"), "actual", "predicted"))


@query
def metrics_overall(spark, sf_dir):
    return rounded(metrics.regression_metrics(
        _test_pairs(spark, sf_dir), "actual", "predicted"))


@query
def metrics_by_station(spark, sf_dir):
    names = stations(spark, sf_dir).select("station_id", "station_name")
    return rounded(metrics.metrics_by_entity(
        _test_pairs(spark, sf_dir), "actual", "predicted", "station_id", names))


@query
def metrics_by_stratum(spark, sf_dir):
    return rounded(metrics.metrics_by_stratum(
        _test_pairs(spark, sf_dir), "actual", "predicted"))


@query
def residual_histogram(spark, sf_dir):
    return rounded(metrics.histogram(
        metrics.add_residual(_test_pairs(spark, sf_dir), "actual", "predicted"), "residual"))


def _line(rows: DataFrame, feature: str, medians) -> tuple[float, float]:
    """Slope and intercept of the target on one imputed feature, from training rows."""
    ready = impute(rows.filter(F.col("split") == "train"), {feature: medians[feature]})
    return tuple(ready.agg(F.regr_slope(SPEC.target, feature),
                           F.regr_intercept(SPEC.target, feature)).first())


@query
def ols_slope(spark, sf_dir):
    rows = modeling_rows(spark, sf_dir, ["pm2_5"])
    ready = impute(rows.filter(F.col("split") == "train"), fitted_medians(rows, ["pm2_5"]))
    return rounded(ready.agg(
        F.regr_slope(SPEC.target, "pm2_5").alias("slope"),
        F.regr_intercept(SPEC.target, "pm2_5").alias("intercept"),
        F.regr_count(SPEC.target, "pm2_5").alias("n_rows")))


@query
def select_model(spark, sf_dir):
    used = ["pm2_5", "pm2_5_roll_mean_3h"]
    rows = modeling_rows(spark, sf_dir, used)
    medians = fitted_medians(rows, used)
    slope, intercept = _line(rows, "pm2_5", medians)
    valid = impute(rows, medians).filter(F.col("split") == "valid")
    candidates = {
        "persistence": F.col("pm2_5"), "recent_mean": F.col("pm2_5_roll_mean_3h"),
        "line": F.lit(slope) * F.col("pm2_5") + F.lit(intercept)}
    scores = [
        metrics.regression_metrics(valid.withColumn("predicted", p), SPEC.target, "predicted")
        .select(F.lit(name).alias("model"), F.lit(i).alias("position"),
                F.lit("valid").alias("split"), "mae")
        for i, (name, p) in enumerate(candidates.items())]
    comparison = scores[0].unionByName(scores[1]).unionByName(scores[2])
    return rounded(metrics.select_model(comparison))


# Scoring and attribution ---------------------------------------------------------

@query
def score_latest(spark, sf_dir):
    medians = fitted_medians(modeling_rows(spark, sf_dir, ["pm2_5"]), ["pm2_5"])
    model = Forecaster(PERSISTENCE, ("pm2_5",), medians)
    panel = joins.enrich(readings(spark, sf_dir), stations(spark, sf_dir), "station_id")
    return rounded(score_newest(panel, model, SPEC, fill=True))


def _line_attribution(spark, sf_dir) -> DataFrame:
    rows = modeling_rows(spark, sf_dir, EXPLAINED)
    medians = fitted_medians(rows, EXPLAINED)
    ready = impute(rows, medians)
    weights = [_line(rows, f, medians)[0] for f in EXPLAINED]
    means = ready.filter(F.col("split") == "train").agg(
        *[F.avg(f).alias(f) for f in EXPLAINED]).first().asDict()
    return attr.linear_attribution(ready.filter(F.col("split") == "test"), EXPLAINED,
                                   [F.col(f) for f in EXPLAINED], weights, means)


@query
def linear_attribution(spark, sf_dir):
    shares = _line_attribution(spark, sf_dir)
    return rounded(shares.select(*KEYS, "base", *[
        F.col("phi")[i].alias(f"phi_{f}") for i, f in enumerate(EXPLAINED)]))


@query
def global_importance(spark, sf_dir):
    return rounded(attr.global_importance(_line_attribution(spark, sf_dir), EXPLAINED))


@query
def topk_contributions(spark, sf_dir):
    return rounded(attr.top_contributions(
        _line_attribution(spark, sf_dir), EXPLAINED, KEYS, top=2))


# Learned models ------------------------------------------------------------------

def _trained(spark, sf_dir, *models) -> training.Training:
    ids = recommended_ids(spark, sf_dir)
    chosen = spark.createDataFrame([(i,) for i in ids], "station_id long")
    return training.train(features(spark, sf_dir, ids), chosen, SPEC, TRAIN_END, VALID_END,
                          models)


def _recomputed(spark, sf_dir, trained: training.Training, splits=("train", "valid")) -> DataFrame:
    """Per model and split: rows, and whether the errors the training reports are those of
    the fitted model's predictions, which only the model itself could tell."""
    rows = modeling_rows(spark, sf_dir).filter(F.col("split").isin(*splits))
    parts = []
    for report in trained.comparison:
        if report["split"] not in splits:
            continue
        own = trained.forecasters[report["model"]].predict(
            rows.filter(F.col("split") == report["split"]), into=PREDICTION)
        miss = F.abs(F.col(SPEC.target) - F.col(PREDICTION))
        parts.append(own.agg(F.count("*").alias("n_rows"), F.avg(miss).alias("mae")).select(
            F.lit(report["model"]).alias("model"), F.lit(report["split"]).alias("split"), "n_rows",
            (F.abs(F.col("mae") - report["mae"]) < 1e-6).alias("mae_as_reported"),
            F.lit(report["n_rows"]).cast("long").alias("n_reported")))
    return reduce(DataFrame.unionByName, parts)


@query
def linear_model(spark, sf_dir):
    return _recomputed(spark, sf_dir, _trained(spark, sf_dir, PERSISTENCE, LINEAR))


@query
def random_forest(spark, sf_dir):
    return _recomputed(spark, sf_dir, _trained(spark, sf_dir, PERSISTENCE, FOREST))


@query
def boosted_trees(spark, sf_dir):
    return _recomputed(spark, sf_dir, _trained(spark, sf_dir, PERSISTENCE, BOOSTED))


@query
def valid_errors(spark, sf_dir):
    """Error of the linear model on the valid rows beside that of persistence."""
    trained = _trained(spark, sf_dir, PERSISTENCE, LINEAR)
    mae = {c["model"]: c["mae"] for c in trained.comparison if c["split"] == "valid"}
    rows = modeling_rows(spark, sf_dir).filter("split = 'valid'")
    miss = F.abs(F.col(SPEC.target) - F.col(PREDICTION))
    own = trained.forecasters[LINEAR].predict(rows, into=PREDICTION).agg(
        F.count("*").alias("n_rows"), F.avg(miss).alias("mae"))
    return own.select("n_rows", F.round(F.lit(mae[PERSISTENCE]), 6).alias("persistence_mae"),
                      (F.col("mae") < mae[PERSISTENCE]).alias("model_is_better"))


@query
def test_winner(spark, sf_dir):
    """All four candidates; that the winner has the smallest valid error and that its test
    error is that of its predictions."""
    trained = _trained(spark, sf_dir, *MODEL_ORDER)
    valid = {c["model"]: c["mae"] for c in trained.comparison if c["split"] == "valid"}
    scored = training.batch_score(_test_rows(spark, sf_dir), trained.best, SPEC)
    return scored.agg(F.count("*").alias("n_rows"), F.avg(F.abs("residual")).alias("mae")).select(
        F.lit(len(valid)).cast("long").alias("n_models"),
        F.lit(valid[trained.selected] == min(valid.values())).alias("smallest_valid_error"),
        "n_rows", (F.abs(F.col("mae") - trained.test["mae"]) < 1e-6).alias("mae_as_reported"))


def _test_rows(spark, sf_dir) -> DataFrame:
    return modeling_rows(spark, sf_dir).filter(F.col("split") == "test")


@query
def batch_score(spark, sf_dir):
    model = _trained(spark, sf_dir, LINEAR).best
    scored = training.batch_score(_test_rows(spark, sf_dir), model, SPEC)
    return scored.select(*KEYS, SPEC.target, (F.abs(
        F.col(SPEC.target) - F.col(PREDICTION) - F.col("residual")) < 1e-9).alias("residual_fits"))


@query
def tree_attribution(spark, sf_dir):
    model = _trained(spark, sf_dir, FOREST).best
    shares = attr.attribute(_test_rows(spark, sf_dir), model, kept=[*KEYS, SPEC.target])
    return _adds_up(shares)


def _adds_up(shares: DataFrame) -> DataFrame:
    """Per row: how many features have a share, and whether base and shares make the
    prediction."""
    total = F.col("base") + F.aggregate("phi", F.lit(0.0), lambda a, b: a + b)
    return shares.select(*KEYS, SPEC.target, F.size("phi").cast("long").alias("n_features"),
                         (F.abs(total - F.col(PREDICTION)) < 1e-6).alias("adds_up"))


def _model_shares(spark, sf_dir) -> tuple[DataFrame, tuple[str, ...]]:
    """Attribution of the linear model over all features, for the test rows."""
    trained = _trained(spark, sf_dir, LINEAR)
    shares = attr.attribute(_test_rows(spark, sf_dir), trained.best,
                            trained.extra["training_means"], [*KEYS, SPEC.target])
    return shares, trained.best.features


@query
def model_attribution(spark, sf_dir):
    return _adds_up(_model_shares(spark, sf_dir)[0])


@query
def model_importance(spark, sf_dir):
    """All features: whether the mean of each is that of the shares row by row, and whether
    they come in order of that mean."""
    shares, names = _model_shares(spark, sf_dir)
    told = attr.global_importance(shares, names).collect()
    every = F.array(*[F.lit(f) for f in names])
    means = {r["feature"]: r["mean"] for r in shares.select(
        F.explode(F.arrays_zip(every.alias("feature"), F.col("phi"))).alias("e")
    ).groupBy("e.feature").agg(F.avg(F.abs("e.phi")).alias("mean")).collect()}
    ordered = sorted(told, key=lambda r: (-r["mean_abs_shap"], r["feature"])) == told
    rows = [(r["feature"], ordered and abs(means[r["feature"]] - r["mean_abs_shap"]) < 1e-9) for r in told]
    return spark.createDataFrame(rows, "feature string, has_share boolean")


@query
def model_top_contributions(spark, sf_dir):
    """Per row: that the five largest shares come in order, and differ in feature."""
    shares, names = _model_shares(spark, sf_dir)
    top = attr.explanation_records(shares, names, KEYS, SPEC.target)
    sizes = F.sort_array(F.collect_list(F.struct("rank", "abs_shap_value")))["abs_shap_value"]
    return top.groupBy(*KEYS).agg(
        F.count("*").alias("n_shares"), F.count_distinct("feature").alias("n_features"),
        (F.reverse(F.array_sort(sizes)) == sizes).alias("in_order"))


@query
def score_model(spark, sf_dir):
    """The newest reading of every station scored by a fitted model."""
    model = _trained(spark, sf_dir, LINEAR).best
    panel = joins.enrich(readings(spark, sf_dir), stations(spark, sf_dir), "station_id")
    return score_newest(panel, model, SPEC, fill=True).select(
        "station", "city", "current_pm25", "current_timestamp", "model",
        (F.col("predicted_pm25") >= 0).alias("not_negative"))


@query
def score_one_station(spark, sf_dir):
    medians = fitted_medians(modeling_rows(spark, sf_dir, ["pm2_5"]), ["pm2_5"])
    panel = joins.enrich(readings(spark, sf_dir), stations(spark, sf_dir), "station_id")
    model = Forecaster(PERSISTENCE, ("pm2_5",), medians)
    return rounded(score_station(panel, model, SPEC, recommended_ids(spark, sf_dir)[0], fill=True))


@query
def save_load_roundtrip(spark, sf_dir):
    """Predictions of a saved and reloaded model beside those of the original."""
    model = _trained(spark, sf_dir, LINEAR).best
    path = f"{shared_dir(spark)}/bundle-{uuid.uuid4().hex}"
    save_bundle(spark, model, path)
    both = load_bundle(spark, path).predict(
        model.predict(_test_rows(spark, sf_dir), into="before"), into="after")
    return both.select(*KEYS, (F.abs(F.col("before") - F.col("after")) < 1e-9).alias("same"))
