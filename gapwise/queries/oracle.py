"""SQL that computes each query's result independently, for checking."""

from __future__ import annotations

from gapwise.queries.adapters import (
    DEEP_GATES, GATES, LONG_HISTORY, QUANTITIES, SNAPSHOT_NAMES, SPEC, TRAIN_END,
    USERS_PER_STATION, VALID_END)

_Q = list(QUANTITIES)
_LAGGED = list(SPEC.lagged)
_EXPLAINED = ("pm2_5", "pm2_5_lag_1h", "pm2_5_roll_mean_3h")


def _r(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0"


def _list(items) -> str:
    return ",\n  ".join(items)


def _with(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def _hourly(name: str, entity: str, alias: str) -> str:
    peaks = _list(f"max(value) FILTER (WHERE event_type = '{kind}') AS {q}"
                  for q, kind in QUANTITIES.items())
    return (f"{name} AS (SELECT {entity} AS {alias}, date_trunc('hour', ts) AS datetime,\n"
            f"  {peaks}\n  FROM events GROUP BY 1, 2)")


PANEL = _hourly("panel", f"user_id // {USERS_PER_STATION}", "station_id")
USERS = _hourly("users", "user_id", "user_id")
RAW = f"""raw AS (SELECT event_id, user_id // {USERS_PER_STATION} AS station_id, ts, event_type,
  CASE WHEN event_type = 'error' THEN props
       ELSE strftime(ts, '%Y-%m-%d %H:00:00') END AS datetime FROM events)"""
STATIONS = """stations AS (SELECT CAST(n_nationkey AS BIGINT) AS station_id,
  n_name || '/' || r_name AS station_name, n_name AS city, r_name AS state
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""
FILLED = "filled AS (SELECT station_id, datetime,\n  " + _list(
    f"last_value({q} IGNORE NULLS) OVER f AS {q},\n"
    f"  {q} IS NULL AND last_value({q} IGNORE NULLS) OVER f IS NOT NULL AS {q}_was_filled"
    for q in _Q) + f"""
  FROM panel WINDOW f AS (PARTITION BY station_id ORDER BY datetime
    ROWS BETWEEN {SPEC.fill_limit} PRECEDING AND CURRENT ROW))"""

_LAG_COLUMNS = [(f"lag({q}, {k}) OVER s", f"{q}_lag_{k}h") for q in _LAGGED for k in SPEC.lags]
_ROLL_COLUMNS = [
    (f"CASE WHEN count({q}) OVER r{n} >= {max(1, n // 2)} THEN avg({q}) OVER r{n} END",
     f"{q}_roll_mean_{n}h") for q in _LAGGED for n in SPEC.windows]
_WINDOWS = ", ".join(
    ["s AS (PARTITION BY station_id ORDER BY datetime)"]
    + [f"r{n} AS (PARTITION BY station_id ORDER BY datetime "
       f"ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in SPEC.windows])
_TIME = [
    ("CAST(hour(datetime) AS INTEGER)", "hour"),
    ("CAST(isodow(datetime) - 1 AS INTEGER)", "day_of_week"),
    ("CAST(dayofyear(datetime) AS INTEGER)", "day_of_year"),
    ("CAST(month(datetime) AS INTEGER)", "month"),
    ("CAST(isodow(datetime) >= 6 AS INTEGER)", "is_weekend")]
_CYCLIC = [
    (f"{fn}(2 * pi() * {part}(datetime) / {period})", f"{part}_{fn}")
    for part, period in (("hour", 24), ("month", 12)) for fn in ("sin", "cos")]
_TARGET = [
    (f"coalesce(abs(epoch_us(lead(datetime, {SPEC.horizon}) OVER s) - epoch_us(datetime) "
     f"- {SPEC.horizon * 3_600_000_000}) <= 216036, false)", SPEC.target_valid),
    (f"CASE WHEN abs(epoch_us(lead(datetime, {SPEC.horizon}) OVER s) - epoch_us(datetime) "
     f"- {SPEC.horizon * 3_600_000_000}) <= 216036 "
     f"THEN lead(pm2_5, {SPEC.horizon}) OVER s END", SPEC.target)]


def _named(pairs, rounding: bool = False) -> str:
    return _list(f"{_r(e) if rounding else e} AS {n}" for e, n in pairs)


FEATURES = ("features AS (SELECT *,\n  "
            + _named(_TIME + _CYCLIC + _LAG_COLUMNS + _ROLL_COLUMNS + _TARGET)
            + f"\n  FROM filled WINDOW {_WINDOWS})")
FEATURE_NAMES = _Q + [n for _, n in _TIME + _CYCLIC + _LAG_COLUMNS + _ROLL_COLUMNS]

COVERAGE = """coverage AS (SELECT station_id,
  arg_min_null(station_name, datetime) AS station_name, arg_min_null(city, datetime) AS city,
  arg_min_null(state, datetime) AS state, min(datetime) AS first_reading,
  max(datetime) AS last_reading, count(*) AS n_records, count(pm2_5) AS n_present,
  CAST(floor((epoch_us(max(datetime)) - epoch_us(min(datetime))) / 86400000000) AS BIGINT)
    AS span_days,
  count(pm2_5) / count(*) AS coverage_exact, round(count(pm2_5) / count(*), 4) AS coverage
  FROM filled LEFT JOIN stations USING (station_id) GROUP BY station_id)"""
DEEP = f"""deep AS (SELECT station_id, count(*) AS n_observations,
  min(datetime) AS date_range_start, max(datetime) AS date_range_end,
  count_if({SPEC.target} IS NOT NULL AND {SPEC.target_valid}) AS usable_rows,
  CAST(floor((epoch_us(max(datetime)) - epoch_us(min(datetime))) / 3600000000) + 1 AS BIGINT)
    AS expected_slots,
  round(100 * (1 - count(pm2_5) / count(*)), 2) AS missing_pct,
  round(100 * count(*) / (floor((epoch_us(max(datetime)) - epoch_us(min(datetime)))
    / 3600000000) + 1), 2) AS continuity_pct
  FROM features GROUP BY station_id)"""
CHOSEN = f"""chosen AS (SELECT station_id, usable_rows FROM deep
  WHERE missing_pct <= {DEEP_GATES['max_missing']} AND continuity_pct >= {DEEP_GATES['min_continuity']}
  ORDER BY usable_rows DESC, station_id LIMIT {DEEP_GATES['size']})"""
SPLIT = f"""CASE WHEN datetime < TIMESTAMP '{TRAIN_END}' THEN 'train'
  WHEN datetime < TIMESTAMP '{VALID_END}' THEN 'valid' ELSE 'test' END AS split"""
MODELING = f"""modeling AS (SELECT *, {SPLIT} FROM features
  WHERE {SPEC.target} IS NOT NULL AND {SPEC.target_valid}
  AND station_id IN (SELECT station_id FROM chosen))"""
_TO_MODELING = (PANEL, FILLED, FEATURES, DEEP, CHOSEN, MODELING)


def _imputed(columns) -> str:
    """The modelling rows with the columns' nulls replaced by training medians."""
    return ("imputed AS (SELECT * REPLACE ("
            + ", ".join(f"coalesce({c}, (SELECT median({c}) FROM modeling "
                        f"WHERE split = 'train')) AS {c}" for c in columns)
            + ") FROM modeling)")


def _pairs(part: str) -> str:
    return (f"pairs AS (SELECT station_id, datetime, {SPEC.target} AS actual, "
            f"pm2_5 AS predicted FROM imputed WHERE split = '{part}')")


_METRICS = [
    ("avg(abs(actual - predicted))", "mae"),
    ("sqrt(avg((actual - predicted) * (actual - predicted)))", "rmse"),
    ("1 - sum((actual - predicted) * (actual - predicted)) / (var_pop(actual) * count(*))", "r2")]
_MEASURES = _named(_METRICS, True) + ", count(*) AS n_rows"
_TEST = (*_TO_MODELING, _imputed(["pm2_5"]), _pairs("test"))

BALANCES = """balances AS (SELECT c_custkey, c_acctbal, s_acctbal
  FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey)"""
NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"

_POLLUTANT = "CASE event_type " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in SNAPSHOT_NAMES.items()) + " END"
SNAPSHOT = f"""snap AS (SELECT 'IN' AS country, state, city,
  'S' || station_id AS station, hour AS timestamp, station_id + 5.0::DOUBLE AS latitude,
  station_id + 70.0::DOUBLE AS longitude, pollutant_id, pollutant_min, pollutant_max,
  pollutant_avg
  FROM (SELECT user_id // {USERS_PER_STATION} AS station_id, date_trunc('hour', ts) AS hour,
    {_POLLUTANT} AS pollutant_id, min(value) - 1.0::DOUBLE AS pollutant_min,
    max(value) AS pollutant_max, CASE WHEN count(*) > 1 THEN avg(value) END AS pollutant_avg
    FROM events GROUP BY 1, 2, 3) LEFT JOIN stations USING (station_id))"""
_BAD_GEO = "NOT coalesce(latitude BETWEEN 6 AND 38 AND longitude BETWEEN 68 AND 98, false)"
_IMPOSSIBLE = " OR ".join(
    f"coalesce({t}, false)" for t in (
        "pollutant_min < 0", "pollutant_max < 0", "pollutant_avg < 0",
        "pollutant_min > pollutant_max", "pollutant_avg < pollutant_min",
        "pollutant_avg > pollutant_max"))

ORACLES: dict[str, str] = {}

ORACLES["snake_columns"] = _with(PANEL, select="SELECT * FROM panel")
ORACLES["parse_drop_bad_time"] = _with(RAW, select="""
SELECT event_id, station_id, try_strptime(datetime, '%Y-%m-%d %H:%M:%S') AS datetime, event_type
FROM raw WHERE try_strptime(datetime, '%Y-%m-%d %H:%M:%S') IS NOT NULL""")
ORACLES["parse_snapshot_time"] = _with(RAW, select="""
SELECT event_id, try_strptime(CASE WHEN event_type = 'click' THEN datetime
  ELSE strftime(ts, '%d-%m-%Y %H:%M:%S') END, '%d-%m-%Y %H:%M:%S') AS timestamp FROM raw""")
ORACLES["coerce_numeric"] = f"""
WITH texts AS (SELECT event_id, CASE event_type WHEN 'error' THEN props
  WHEN 'click' THEN CAST(value AS VARCHAR) || 'd'
  WHEN 'signup' THEN ' ' || CAST(value AS VARCHAR) || 'e1 '
  WHEN 'purchase' THEN 'NaN' ELSE CAST(value AS VARCHAR) END AS reading FROM events)
SELECT event_id, CASE WHEN regexp_full_match(reading, '{NUMBER}')
  THEN {_r("TRY_CAST(trim(reading) AS DOUBLE)")} END AS reading FROM texts"""
ORACLES["negative_flag"] = _with(BALANCES, select="""
SELECT *, coalesce(c_acctbal < 0, false) OR coalesce(s_acctbal < 0, false)
  AS negative_value_flag FROM balances""")
ORACLES["geo_flag"] = f"""
SELECT *, {_BAD_GEO} AS lat_lon_flag_invalid FROM (
  SELECT event_id, user_id / 2.0::DOUBLE AS latitude, n_nationkey + 60.0::DOUBLE AS longitude
  FROM events LEFT JOIN nation ON user_id = n_nationkey)"""
ORACLES["impossible_flag"] = f"""
SELECT * REPLACE ({_r('pollutant_avg')} AS pollutant_avg),
  {_IMPOSSIBLE} AS pollutant_flag_impossible FROM (
  SELECT l_orderkey, l_linenumber, l_tax AS pollutant_min, l_discount AS pollutant_max,
    l_discount - l_tax AS pollutant_avg FROM lineitem)"""
ORACLES["aqi_category"] = _with(PANEL, select="""
SELECT station_id, datetime, pm2_5, CASE WHEN pm2_5 IS NULL THEN 'Unknown'
  WHEN pm2_5 <= 30 THEN 'Good' WHEN pm2_5 <= 60 THEN 'Satisfactory'
  WHEN pm2_5 <= 90 THEN 'Moderate' WHEN pm2_5 <= 120 THEN 'Poor'
  WHEN pm2_5 <= 250 THEN 'Very Poor' ELSE 'Severe' END AS category FROM panel""")
ORACLES["forecast_change"] = _with(PANEL, select=f"""
SELECT station_id, datetime, pm2_5 AS current_pm25, pm10 AS predicted_pm25,
  {_r('pm10 - pm2_5')} AS change, {_r('(pm10 - pm2_5) / nullif(pm2_5, 0) * 100')} AS change_pct,
  CASE WHEN pm10 > pm2_5 THEN 'increase' WHEN pm10 < pm2_5 THEN 'decrease'
    WHEN pm10 = pm2_5 THEN 'unchanged' END AS direction
FROM panel""")

_USERS_JOINED = "users LEFT JOIN stations ON user_id = stations.station_id"
ORACLES["enrich_left_join"] = _with(USERS, STATIONS, select=f"""
SELECT user_id, datetime, pm2_5, station_name, city, state FROM {_USERS_JOINED}""")
ORACLES["missing_metadata"] = _with(USERS, STATIONS, select=f"""
SELECT count(*) AS n_rows, count_if(station_name IS NULL)::BIGINT AS n_missing_metadata
FROM {_USERS_JOINED}""")

_GATES = (f"coverage >= {GATES['min_coverage']} AND span_days >= {GATES['min_span_days']} "
          f"AND n_records >= {GATES['min_records']}")
ORACLES["semi_join_selected"] = _with(PANEL, STATIONS, FILLED, COVERAGE, select=f"""
SELECT * FROM panel WHERE station_id IN (SELECT station_id FROM coverage WHERE {_GATES})""")

ORACLES["exact_dedup"] = "SELECT DISTINCT text, lang FROM documents"
ORACLES["exact_dup_count"] = """
SELECT (SELECT count(*) FROM documents) AS n_rows, count(*) AS n_distinct,
  (SELECT count(*) FROM documents) - count(*) AS duplicate_rows
FROM (SELECT DISTINCT text, lang FROM documents)"""
ORACLES["dup_key_rows"] = """
SELECT sum(n)::BIGINT AS rows_in_duplicated_keys, count(*) AS duplicated_keys
FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber) WHERE n > 1"""
ORACLES["dedup_keep_first"] = """
SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax,
    l_returnflag, l_linestatus) = 1"""

ORACLES["audit_missing"] = _with(PANEL, select="\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count(*) AS n_rows, "
    f"count_if({c} IS NULL)::BIGINT AS n_missing FROM panel"
    for c, t in [("station_id", "bigint"), ("datetime", "timestamp_ntz"),
                 *[(q, "double") for q in _Q]]))
ORACLES["audit_distinct"] = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM orders"
    for c in ("o_custkey", "o_orderstatus", "o_orderpriority"))
ORACLES["audit_time_range"] = _with(RAW, select="""
SELECT min(t) AS min_time, max(t) AS max_time, count_if(t IS NULL)::BIGINT AS unparseable
FROM (SELECT try_strptime(datetime, '%Y-%m-%d %H:%M:%S') AS t FROM raw)""")
ORACLES["audit_numeric_ranges"] = _with(PANEL, select="\nUNION ALL\n".join(
    f"SELECT '{q}' AS \"column\", min({q}) AS min, max({q}) AS max, {_r(f'avg({q})')} AS mean, "
    f"count_if({q} IS NULL)::BIGINT AS n_missing, "
    f"round(100 * avg(CASE WHEN {q} IS NULL THEN 1.0::DOUBLE ELSE 0 END), 2) AS missing_pct "
    f"FROM panel" for q in _Q))
ORACLES["audit_negatives"] = _with(BALANCES, select="\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", count_if({c} < 0)::BIGINT AS n_negative FROM balances"
    for c in ("c_acctbal", "s_acctbal")))
ORACLES["fill_report"] = _with(PANEL, FILLED, select="\nUNION ALL\n".join(
    f"SELECT '{q}' AS \"column\", count_if({q} IS NULL OR {q}_was_filled)::BIGINT "
    f"AS missing_before, count_if({q}_was_filled)::BIGINT AS filled, "
    f"count_if({q} IS NULL)::BIGINT AS missing_after FROM filled" for q in _Q))
ORACLES["stage_counts"] = _with(
    RAW, "step1 AS (SELECT DISTINCT station_id, datetime, event_type FROM raw)",
    "step2 AS (SELECT station_id, try_strptime(datetime, '%Y-%m-%d %H:%M:%S') AS t FROM step1)",
    select="""SELECT 'raw' AS stage, count(*) AS n_rows FROM raw
UNION ALL SELECT 'exact_dedup', count(*) FROM step1
UNION ALL SELECT 'parsed_time', count(*) FROM step2 WHERE t IS NOT NULL
UNION ALL SELECT 'known_entity', count(*) FROM step2 WHERE t IS NOT NULL AND station_id IS NOT NULL
UNION ALL SELECT 'first_of_key', count(*) FROM
  (SELECT DISTINCT station_id, t FROM step2 WHERE t IS NOT NULL AND station_id IS NOT NULL)""")

_TO_COVERAGE = (PANEL, STATIONS, FILLED, COVERAGE)
ORACLES["coverage_report"] = _with(*_TO_COVERAGE, select=f"""
SELECT * REPLACE ({_r('coverage_exact')} AS coverage_exact) FROM coverage""")
ORACLES["select_stations"] = _with(*_TO_COVERAGE, select=f"""
SELECT station_id, n_records, span_days FROM coverage WHERE {_GATES}""")
ORACLES["coverage_deep"] = _with(PANEL, FILLED, FEATURES, DEEP, select="""
SELECT * REPLACE (usable_rows::BIGINT AS usable_rows) FROM deep""")
ORACLES["recommend_subset"] = _with(PANEL, FILLED, FEATURES, DEEP, CHOSEN, select="""
SELECT station_id, usable_rows::BIGINT AS usable_rows FROM chosen""")

ORACLES["snapshot_is_single"] = _with(STATIONS, SNAPSHOT, select="""
SELECT count(DISTINCT timestamp) = 1 AS is_single, min(timestamp) AS timestamp_value FROM snap""")
ORACLES["snapshot_wide"] = _with(
    STATIONS, SNAPSHOT, f"""flagged AS (SELECT *, {_BAD_GEO} AS lat_lon_flag_invalid,
  {_IMPOSSIBLE} AS pollutant_flag_impossible FROM snap)""",
    select="""SELECT country, state, city, station, timestamp, latitude, longitude,
  """ + _list(f"""{_r(f"max(pollutant_avg) FILTER (WHERE pollutant_id = '{p}')")} AS "{p}\""""
              for p in ("CO", "NO2", "PM10", "PM2.5", "SO2")) + """,
  bool_or(lat_lon_flag_invalid) AS lat_lon_flag_invalid,
  bool_or(pollutant_flag_impossible) AS pollutant_flag_impossible
FROM flagged GROUP BY ALL""")

ORACLES["ffill_limited"] = _with(PANEL, FILLED, select="SELECT * FROM filled")
ORACLES["time_features"] = _with(PANEL, select=f"""
SELECT station_id, datetime, {_named(_TIME)} FROM panel""")
ORACLES["cyclic_features"] = _with(PANEL, select=f"""
SELECT station_id, datetime, {_named(_CYCLIC, True)} FROM panel""")
ORACLES["lag_features"] = _with(PANEL, select=f"""
SELECT *, {_named(_LAG_COLUMNS)} FROM panel WINDOW {_WINDOWS}""")
ORACLES["rolling_features"] = _with(PANEL, select=f"""
SELECT *, {_named(_ROLL_COLUMNS, True)} FROM panel WINDOW {_WINDOWS}""")
ORACLES["target_ahead"] = _with(PANEL, FILLED, select=f"""
SELECT station_id, datetime, pm2_5, {_named(_TARGET)} FROM filled WINDOW {_WINDOWS}""")
ORACLES["feature_table"] = _with(PANEL, FILLED, FEATURES, select="SELECT * REPLACE ("
    + ", ".join(f"{_r(n)} AS {n}" for _, n in _CYCLIC + _ROLL_COLUMNS) + ") FROM features")
ORACLES["latest_per_station"] = _with(PANEL, select="""
SELECT * FROM panel
QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY datetime DESC) = 1""")
ORACLES["insufficient_history"] = _with(USERS, select=f"""
SELECT user_id, count(*) AS n_rows, 'fewer than {LONG_HISTORY} rows of history' AS reason
FROM users GROUP BY user_id HAVING count(*) < {LONG_HISTORY}""")
ORACLES["recent_trend"] = _with(PANEL, select="""
SELECT station_id, datetime, pm2_5 FROM panel
QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY datetime DESC) <= 168""")
ORACLES["stations_list"] = _with(PANEL, select="""
SELECT DISTINCT CAST(station_id AS VARCHAR) AS station_id FROM panel ORDER BY 1""")

ORACLES["usable_rows"] = _with(PANEL, FILLED, FEATURES, select=f"""
SELECT station_id, datetime, pm2_5, {SPEC.target} FROM features
WHERE {SPEC.target} IS NOT NULL AND {SPEC.target_valid}""")
ORACLES["modeling_set"] = _with(*_TO_MODELING, select=f"""
SELECT station_id, datetime, pm2_5, {SPEC.target} FROM modeling""")
ORACLES["chrono_split"] = _with(PANEL, select=f"SELECT station_id, datetime, {SPLIT} FROM panel")
ORACLES["split_summary"] = _with(*_TO_MODELING, select="""
SELECT split, count(*) AS n_rows, min(datetime) AS min_time, max(datetime) AS max_time,
  count(DISTINCT station_id) AS n_stations FROM modeling GROUP BY split""")
ORACLES["median_fit"] = _with(*_TO_MODELING, select="\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, {_r(f'CAST(median({c}) AS DOUBLE)')} AS median FROM modeling "
    f"WHERE split = 'train'" for c in FEATURE_NAMES))
ORACLES["median_impute"] = _with(*_TO_MODELING, _imputed(_Q), select=f"""
SELECT station_id, datetime, split, {_named([(q, q) for q in _Q], True)} FROM imputed""")

ORACLES["persistence_metrics"] = _with(
    *_TO_MODELING, _imputed(["pm2_5"]), _pairs("valid"), select=f"SELECT {_MEASURES} FROM pairs")
ORACLES["metrics_overall"] = _with(*_TEST, select=f"SELECT {_MEASURES} FROM pairs")
ORACLES["metrics_by_station"] = _with(*_TEST, STATIONS, select=f"""
SELECT station_id, any_value(station_name) AS station_name, {_MEASURES}
FROM pairs LEFT JOIN stations USING (station_id) GROUP BY station_id""")
ORACLES["metrics_by_stratum"] = _with(*_TEST, select=f"""
SELECT CASE WHEN actual >= 91 THEN 'high' ELSE 'normal' END AS stratum, {_MEASURES}
FROM pairs GROUP BY 1""")
ORACLES["residual_histogram"] = _with(
    *_TEST, "errors AS (SELECT actual - predicted AS v FROM pairs)",
    "ends AS (SELECT min(v) AS low, (max(v) - min(v)) / 80 AS width FROM errors)",
    select=f"""SELECT bin, {_r('low + bin * width')} AS bin_start, count(*) AS n_rows
FROM (SELECT low, width, CAST(least(floor((v - low) / width), 79) AS INTEGER) AS bin
  FROM errors, ends) GROUP BY bin, low, width""")
ORACLES["ols_slope"] = _with(*_TO_MODELING, _imputed(["pm2_5"]), select=f"""
SELECT {_r(f'regr_slope({SPEC.target}, pm2_5)')} AS slope,
  {_r(f'regr_intercept({SPEC.target}, pm2_5)')} AS intercept, count(*) AS n_rows
FROM imputed WHERE split = 'train'""")
ORACLES["select_model"] = _with(
    *_TO_MODELING, _imputed(["pm2_5", "pm2_5_roll_mean_3h"]),
    f"""line AS (SELECT regr_slope({SPEC.target}, pm2_5) AS slope,
  regr_intercept({SPEC.target}, pm2_5) AS intercept FROM imputed WHERE split = 'train')""",
    f"""scores AS (
  SELECT 0 AS position, 'persistence' AS model, avg(abs({SPEC.target} - pm2_5)) AS mae
    FROM imputed WHERE split = 'valid'
  UNION ALL SELECT 1, 'recent_mean', avg(abs({SPEC.target} - pm2_5_roll_mean_3h))
    FROM imputed WHERE split = 'valid'
  UNION ALL SELECT 2, 'line', avg(abs({SPEC.target} - (slope * pm2_5 + intercept)))
    FROM imputed, line WHERE split = 'valid')""",
    select=f"""SELECT model AS selected_model, {_r('mae')} AS mae FROM scores
ORDER BY scores.mae, position LIMIT 1""")
ORACLES["score_latest"] = _with(*_TO_MODELING, STATIONS, select=f"""
SELECT CAST(station_id AS VARCHAR) AS station, coalesce(city, 'Unknown') AS city,
  pm2_5 AS current_pm25, {_r('''greatest(0, coalesce(pm2_5, (SELECT median(pm2_5)
    FROM modeling WHERE split = 'train')))''')} AS predicted_pm25,
  {SPEC.horizon} AS prediction_horizon_hours, datetime AS current_timestamp,
  datetime + INTERVAL {SPEC.horizon} HOUR AS prediction_timestamp,
  'persistence_baseline' AS model
FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY datetime DESC) AS newest,
    count(*) OVER (PARTITION BY station_id) AS history FROM filled)
  LEFT JOIN stations USING (station_id)
WHERE newest = 1 AND history >= 30""")

_SLOPES = "slopes AS (SELECT " + ", ".join(
    f"regr_slope({SPEC.target}, {f}) AS w{i}, avg({f}) AS m{i}"
    for i, f in enumerate(_EXPLAINED)) + " FROM imputed WHERE split = 'train')"
_PHI = [f"({f} - m{i}) * w{i}" for i, f in enumerate(_EXPLAINED)]
_SHARES = "shares AS (SELECT station_id, datetime, " + ", ".join(
    f"{f} AS x{i}, {p} AS phi{i}" for i, (f, p) in enumerate(zip(_EXPLAINED, _PHI))) + ", " \
    + " + ".join(f"w{i} * m{i}" for i in range(len(_EXPLAINED))) \
    + " AS base FROM imputed, slopes WHERE split = 'test')"
_TO_SHARES = (*_TO_MODELING, _imputed(_EXPLAINED), _SLOPES, _SHARES)
ORACLES["linear_attribution"] = _with(*_TO_SHARES, select=f"""
SELECT station_id, datetime, {_r('base')} AS base,
  {_list(f"{_r(f'phi{i}')} AS phi_{f}" for i, f in enumerate(_EXPLAINED))} FROM shares""")
ORACLES["global_importance"] = _with(*_TO_SHARES, select="\nUNION ALL\n".join(
    f"SELECT '{f}' AS feature, {_r(f'avg(abs(phi{i}))')} AS mean_abs_shap FROM shares"
    for i, f in enumerate(_EXPLAINED)))
_LONG = "long AS (" + "\nUNION ALL\n".join(
    f"SELECT station_id, datetime, '{f}' AS feature, phi{i} AS phi, x{i} AS x FROM shares"
    for i, f in enumerate(_EXPLAINED)) + ")"
ORACLES["topk_contributions"] = _with(*_TO_SHARES, _LONG, select=f"""
SELECT station_id, datetime, CAST(rank AS INTEGER) AS rank, feature, {_r('phi')} AS shap_value,
  {_r('x')} AS feature_value, {_r('abs(phi)')} AS abs_shap_value,
  CASE WHEN phi > 0 THEN 'increases' WHEN phi < 0 THEN 'decreases' ELSE 'neutral' END AS direction
FROM (SELECT *, row_number() OVER (PARTITION BY station_id, datetime
  ORDER BY abs(phi) DESC, feature) AS rank FROM long) WHERE rank <= 2""")

_IDS = "country, state, city, station, timestamp, latitude, longitude"
ORACLES["snapshot_repeated_rows"] = f"""
WITH snap AS (SELECT 'IN' AS country, CAST(NULL AS VARCHAR) AS state,
    CASE WHEN user_id % 2 = 0 THEN 'even' END AS city, 'U' || user_id % 50 AS station,
    CAST(date_trunc('day', ts) AS TIMESTAMP) AS timestamp, 20.0::DOUBLE AS latitude,
    80.0::DOUBLE AS longitude, {_POLLUTANT} AS pollutant_id, value - 1.0::DOUBLE AS pollutant_min,
    value AS pollutant_max, CASE WHEN event_id % 3 > 0 THEN value END AS pollutant_avg FROM events),
once AS (SELECT {_IDS}, pollutant_id, pollutant_avg, {_IMPOSSIBLE} AS bad FROM snap
  QUALIFY row_number() OVER (PARTITION BY {_IDS}, pollutant_id
    ORDER BY pollutant_avg NULLS LAST, pollutant_min, pollutant_max) = 1)
SELECT {_IDS}, """ + _list(
    f"""{_r(f"max(pollutant_avg) FILTER (WHERE pollutant_id = '{p}')")} AS "{p}\""""
    for p in sorted(SNAPSHOT_NAMES.values())) + """,
  bool_or(bad) AS pollutant_flag_impossible FROM once GROUP BY ALL"""
ORACLES["snapshot_is_one_time"] = """
SELECT true AS is_single, TIMESTAMP '2024-01-05 00:00:00' AS timestamp_value"""

_READINGS = f"""readings AS (SELECT
  CASE WHEN user_id % 7 > 0 THEN user_id // {USERS_PER_STATION} END AS station_id,
  CASE event_type WHEN 'error' THEN props WHEN 'signup' THEN '2024-01'
    ELSE strftime(ts, '%Y-%m-%d %H:00:00') END AS datetime,
  CASE WHEN event_type != 'click' THEN value - 20.0::DOUBLE END AS pm2_5 FROM events)"""
_TIME_READ = "try_strptime(datetime, '%Y-%m-%d %H:%M:%S')"
ORACLES["clean_panel"] = _with(
    _READINGS, STATIONS, f"""first AS (SELECT station_id, {_TIME_READ} AS datetime, pm2_5
  FROM readings WHERE station_id IS NOT NULL AND {_TIME_READ} IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY station_id, {_TIME_READ}
    ORDER BY pm2_5 NULLS LAST) = 1)""",
    select=f"""SELECT station_id, datetime, {_r('last_value(pm2_5 IGNORE NULLS) OVER f')} AS pm2_5,
  coalesce(pm2_5 < 0, false) AS negative_value_flag, station_name, city, state,
  pm2_5 IS NULL AND last_value(pm2_5 IGNORE NULLS) OVER f IS NOT NULL AS pm2_5_was_filled
FROM first LEFT JOIN stations USING (station_id)
WINDOW f AS (PARTITION BY station_id ORDER BY datetime
  ROWS BETWEEN {SPEC.fill_limit} PRECEDING AND CURRENT ROW)""")
ORACLES["rejected_rows"] = _with(_READINGS, select=f"""
SELECT CAST(station_id AS VARCHAR) AS station_id, datetime, pm2_5,
  CASE WHEN {_TIME_READ} IS NULL THEN 'unreadable_time'
  ELSE 'null_entity' END AS reason
FROM readings WHERE station_id IS NULL OR {_TIME_READ} IS NULL""")

ORACLES["seeded_sample"] = """
SELECT * FROM orders ORDER BY md5('42|' || o_orderkey), o_orderkey LIMIT 1000"""


def _reports(*models: str) -> str:
    return _with(*_TO_MODELING, select="\nUNION ALL\n".join(
        f"SELECT '{m}' AS model, split, count(*) AS n_rows, true AS mae_as_reported, "
        f"count(*) AS n_reported FROM modeling WHERE split != 'test' GROUP BY split"
        for m in models))


ORACLES["linear_model"] = _reports("persistence_baseline", "linear_regression")
ORACLES["random_forest"] = _reports("persistence_baseline", "random_forest")
ORACLES["boosted_trees"] = _reports("persistence_baseline", "boosted_trees")
ORACLES["test_winner"] = _with(*_TO_MODELING, select="""
SELECT 4::BIGINT AS n_models, true AS smallest_valid_error, count(*) AS n_rows,
  true AS mae_as_reported FROM modeling WHERE split = 'test'""")
_TEST_KEYS = f"station_id, datetime, {SPEC.target}"
ORACLES["batch_score"] = _with(*_TO_MODELING, select=f"""
SELECT {_TEST_KEYS}, true AS residual_fits FROM modeling WHERE split = 'test'""")
ORACLES["save_load_roundtrip"] = _with(*_TO_MODELING, select="""
SELECT station_id, datetime, true AS same FROM modeling WHERE split = 'test'""")
ORACLES["tree_attribution"] = ORACLES["model_attribution"] = _with(*_TO_MODELING, select=f"""
SELECT {_TEST_KEYS}, {len(FEATURE_NAMES)}::BIGINT AS n_features, true AS adds_up
FROM modeling WHERE split = 'test'""")
ORACLES["model_importance"] = "\nUNION ALL\n".join(
    f"SELECT '{f}' AS feature, true AS has_share" for f in FEATURE_NAMES)
ORACLES["model_top_contributions"] = _with(*_TO_MODELING, select="""
SELECT station_id, datetime, 5::BIGINT AS n_shares, 5::BIGINT AS n_features, true AS in_order
FROM modeling WHERE split = 'test'""")
ORACLES["score_model"] = _with(PANEL, FILLED, STATIONS, select="""
SELECT CAST(station_id AS VARCHAR) AS station, coalesce(city, 'Unknown') AS city,
  pm2_5 AS current_pm25, datetime AS current_timestamp, 'linear_regression' AS model,
  true AS not_negative
FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY datetime DESC) AS newest,
    count(*) OVER (PARTITION BY station_id) AS history FROM filled)
  LEFT JOIN stations USING (station_id)
WHERE newest = 1 AND history >= 30""")
ORACLES["score_one_station"] = f"""
SELECT * FROM ({ORACLES['score_latest']})
WHERE station = (SELECT CAST(station_id AS VARCHAR) FROM ({ORACLES['recommend_subset']})
  ORDER BY usable_rows DESC, station_id LIMIT 1)"""

# The same results by other ways.
ORACLES["coverage_deep_incremental"] = ORACLES["coverage_deep"]
ORACLES["coverage_of_states"] = ORACLES["coverage_report"]
ORACLES["newest_days"] = _with(PANEL, select="""
SELECT DISTINCT station_id, CAST(strftime(datetime, '%Y%m%d') AS INTEGER) AS part_period
FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY datetime DESC) AS newest FROM panel)
WHERE newest <= 30""")
ORACLES["audit_distinct_sketch"] = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct, true AS estimate_is_close FROM events"
    for c in ("event_id", "user_id", "ts"))
ORACLES["exact_dedup_rows"] = _with(RAW, select="""
SELECT DISTINCT station_id, datetime, event_type FROM raw""")
ORACLES["exact_dup_count_rows"] = _with(RAW, select="""
SELECT (SELECT count(*) FROM raw) AS n_rows, count(*) AS n_distinct,
  (SELECT count(*) FROM raw) - count(*) AS duplicate_rows
FROM (SELECT DISTINCT station_id, datetime, event_type FROM raw)""")
_SORTED = sorted(FEATURE_NAMES)
ORACLES["median_impute_all"] = _with(*_TO_MODELING, _imputed(_SORTED), select=f"""
SELECT i.station_id, i.datetime, i.split, {" + ".join(f"(m.{c} IS NULL)::BIGINT" for c in _SORTED)} AS n_missing,
  round({" + ".join(f"i.{c}::DOUBLE" for c in _SORTED)}, 3) + 0.0 AS total
FROM imputed i JOIN modeling m ON m.station_id = i.station_id AND m.datetime = i.datetime""")
ORACLES["valid_errors"] = _with(*_TO_MODELING, _imputed(["pm2_5"]), _pairs("valid"), select=f"""
SELECT count(*) AS n_rows, {_r("avg(abs(actual - predicted))")} AS persistence_mae,
  true AS model_is_better FROM pairs""")
