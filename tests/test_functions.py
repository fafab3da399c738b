import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F, types as T

from gapwise.functions.aqi import add_forecast_change, aqi_category
from gapwise.functions.calendar import add_cyclic_features, add_time_features
from gapwise.functions.coerce import coerce_numeric, parse_time, parse_time_or_drop
from gapwise.functions.flags import add_geo_flag, add_impossible_flag, add_negative_flag
from gapwise.functions.names import require_columns, snake_columns, snake_name
from gapwise.functions import quantile
from gapwise.functions.quantile import exact_medians
from gapwise.operators.impute import fit_medians, impute


def column(df, name):
    return [r[name] for r in df.collect()]


@pytest.mark.parametrize("raw, clean, flat", [
    ("StationId", "station_id", "stationid"), ("PM2.5", "pm2_5", "pm2_5"),
    ("NOx", "nox", "nox"), ("AQI_Bucket", "aqi_bucket", "aqi_bucket"),
    ("  last update ", "last_update", "last_update"), ("pollutantAvg!", "pollutant_avg", "pollutantavg")])
def test_snake_names(raw, clean, flat):
    assert snake_name(raw) == clean and snake_name(raw, split_camel=False) == flat


def test_snake_columns_and_required(spark):
    df = snake_columns(spark.createDataFrame([(1, 2)], "`StationId` int, `PM2.5` int"))
    assert df.columns == ["station_id", "pm2_5"]
    with pytest.raises(ValueError, match="datetime, city"):
        require_columns(df, ["station_id", "datetime", "city"])


def test_numbers(spark):
    texts = ["5d", "NaN", "", " 5 ", "1e3", "-.5", "inf", None, "{}", "7."]
    df = coerce_numeric(spark.createDataFrame([(t,) for t in texts], "v string"), ["v", "absent"])
    assert column(df, "v") == [None, None, None, 5.0, 1000.0, -0.5, float("inf"), None, None, 7.0]
    nan = spark.createDataFrame([(float("nan"),), (1.0,)], "v double")
    assert column(coerce_numeric(nan, ["v"]), "v") == [None, 1.0]
    ints = spark.createDataFrame([(3,)], "v int")
    assert column(coerce_numeric(ints, ["v"]), "v") == [3.0]


def test_times(spark):
    texts = ["2020-01-02 03:00:00", "nonsense", None, "2020-13-01 00:00:00"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert column(parse_time_or_drop(df, "t"), "t") == [dt.datetime(2020, 1, 2, 3)]
    fixed = spark.createDataFrame([("31-01-2020 05:00:00",), ("2020-01-31 05:00:00",)], "t string")
    parsed = parse_time(fixed, "t", "dd-MM-yyyy HH:mm:ss", into="timestamp")
    assert column(parsed, "timestamp") == [dt.datetime(2020, 1, 31, 5), None]


def test_flags(spark):
    df = spark.createDataFrame([(1.0, None), (-1.0, 2.0), (None, -0.1), (None, None)],
                               "a double, b double")
    assert column(add_negative_flag(df, ["a", "b", "c"]), "negative_value_flag") == \
        [False, True, True, False]
    geo = spark.createDataFrame([(20.0, 80.0), (5.9, 80.0), (20.0, 98.1), (None, 80.0), (6.0, 98.0)],
                                "latitude double, longitude double")
    assert column(add_geo_flag(geo), "lat_lon_flag_invalid") == [False, True, True, True, False]
    snap = spark.createDataFrame(
        [(1.0, 3.0, 2.0), (4.0, 3.0, 3.5), (1.0, 3.0, 3.1), (1.0, 3.0, 0.5), (-1.0, 3.0, 2.0),
         (None, None, None), (None, 3.0, 4.0)],
        "pollutant_min double, pollutant_max double, pollutant_avg double")
    assert column(add_impossible_flag(snap), "pollutant_flag_impossible") == \
        [False, True, True, True, True, False, True]


def test_categories(spark):
    values = [30.0, 30.5, 60.0, 90.0, 90.5, 120.0, 250.0, 251.0, None, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert column(df.select(aqi_category(F.col("v")).alias("k")), "k") == [
        "Good", "Satisfactory", "Satisfactory", "Moderate", "Poor", "Poor", "Very Poor",
        "Severe", "Unknown", "Unknown"]


def test_forecast_change(spark):
    df = spark.createDataFrame([(10.0, 15.0), (0.0, 5.0), (4.0, 3.0), (2.0, 2.0), (None, 1.0)],
                               "current_pm25 double, predicted_pm25 double")
    out = add_forecast_change(df)
    assert column(out, "change") == [5.0, 5.0, -1.0, 0.0, None]
    assert column(out, "change_pct") == [50.0, None, -25.0, 0.0, None]
    assert column(out, "direction") == ["increase", "increase", "decrease", "unchanged", None]


def test_calendar_equals_pandas(spark):
    times = pd.date_range("2019-12-27 05:00", periods=40, freq="17h")
    df = spark.createDataFrame([(t.to_pydatetime(),) for t in times], "datetime timestamp_ntz")
    got = add_cyclic_features(add_time_features(df)).toPandas()
    assert list(got["day_of_week"]) == list(times.dayofweek)
    assert list(got["day_of_year"]) == list(times.dayofyear)
    assert list(got["is_weekend"]) == [int(d >= 5) for d in times.dayofweek]
    np.testing.assert_allclose(got["hour_sin"], np.sin(2 * np.pi * times.hour / 24), atol=1e-12)
    np.testing.assert_allclose(got["month_cos"], np.cos(2 * np.pi * times.month / 12), atol=1e-12)


def _doubles(spark, pdf):
    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in pdf.columns])
    rows = [tuple(None if np.isnan(x) else float(x) for x in r) for r in pdf.to_numpy()]
    return spark.createDataFrame(rows, schema).repartition(4).cache()


@pytest.mark.parametrize("n", [1, 2, 7, 500, 501])
def test_medians_are_exact(spark, n):
    rng = np.random.default_rng(n)
    pdf = pd.DataFrame({
        "normal": rng.normal(size=n), "constant": np.full(n, 3.5),
        "two_values": np.r_[np.zeros(n // 2), np.ones(n - n // 2)],
        "third_equal": np.where(rng.random(n) < 0.34, 7.0, rng.normal(size=n) * 10),
        "wide": np.exp(rng.normal(size=n) * 20), "negative": -np.exp(rng.normal(size=n) * 200),
        "powers": 2.0 ** rng.integers(-1074, 1024, n) * rng.choice([-1, 1], n),
        "subnormal": rng.integers(-10**9, 10**9, n) * 5e-324, "close": 1 + rng.integers(0, 99, n) * 2.0**-52,
        "largest": rng.choice([-1.0, 1.0, 1.0], n) * 1.7e308,
        "with_nulls": np.where(rng.random(n) < 0.5, np.nan, rng.normal(size=n))})
    got = exact_medians(_doubles(spark, pdf), list(pdf.columns))
    for c in pdf.columns:
        want = pdf[c].median() if c != "largest" else np.median(pdf[c] / 4) * 4
        assert got[c] == want or (got[c] is None and np.isnan(want)), c


def test_median_imputation(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (4.0, None), (10.0, None), (None, None)],
                               "a double, b double")
    medians = fit_medians(df, ["a"])
    assert medians == {"a": 3.0}
    assert column(impute(df, medians), "a") == [1.0, 2.0, 4.0, 10.0, 3.0]
    with pytest.raises(ValueError, match="b"):
        fit_medians(df, ["a", "b"])


def test_medians_of_infinities(spark):
    inf = float("inf")
    columns = {"split": [-inf, inf] * 500, "odd": [-inf] * 499 + [2.0] * 2 + [inf] * 499,
               "low": [-inf] * 600 + [inf] * 400, "tiny": [5e-324, -5e-324] * 500}
    df = spark.createDataFrame(list(zip(*columns.values())), list(columns))
    got = exact_medians(df, list(columns))
    assert got == {"split": None, "odd": 2.0, "low": -inf, "tiny": 0.0}


def test_medians_of_many_columns_take_few_passes(spark, monkeypatch):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({f"c{i}": np.round(rng.gamma(2, 30 + i, 900), 2) for i in range(103)})
    pdf.loc[rng.random(900) < 0.2, "c7"] = np.nan
    passes, counts = [], quantile._counts
    monkeypatch.setattr(quantile, "_counts", lambda *a: passes.append(1) or counts(*a))
    assert exact_medians(_doubles(spark, pdf), list(pdf.columns)) == pdf.median().to_dict()
    assert len(passes) <= 4
