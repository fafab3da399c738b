import datetime as dt
import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from panels import SPEC, assert_same, expected_features, random_panel, to_pandas, to_spark

from gapwise.operators.series import (
    add_rolling_means, add_target, entity_list, forward_fill, latest_rows, recent_trend,
    short_histories, split_null_entities)
from gapwise.plans.build import feature_table
from gapwise.plans.chunks import over_series


def hours(values, start=dt.datetime(2020, 1, 1), station="a", skip=()):
    rows, t = [], start
    for i, v in enumerate(values):
        rows.append((station, t, v, None))
        t += dt.timedelta(hours=2 if i in skip else 1)
    return rows


def panel(spark, rows):
    from panels import SCHEMA
    return spark.createDataFrame(rows, SCHEMA)


def column(df, name):
    return [r[name] for r in df.orderBy("station_id", "datetime").collect()]


@pytest.mark.parametrize("seed", range(4))
def test_features_equal_pandas(spark, seed):
    pdf = random_panel(seed)
    got = to_pandas(feature_table(to_spark(spark, pdf), SPEC, fill=True))
    assert_same(got, expected_features(pdf))


@pytest.mark.parametrize("chunk_rows, stretch", [(33, 4096), (40, 3), (64, 1), (101, 7)])
def test_chunked_windows_equal_whole_series(spark, chunk_rows, stretch, monkeypatch):
    """One station holds most rows; chunks must change nothing."""
    monkeypatch.setattr("gapwise.plans.chunks.STRETCH_SLOTS", stretch)
    pdf = random_panel(chunk_rows, stations=("a", "b", "c"), hours=60)
    hot = random_panel(7, stations=("hot",), hours=900)
    import pandas as pd
    pdf = pd.concat([pdf, hot], ignore_index=True)
    got = to_pandas(feature_table(to_spark(spark, pdf), SPEC, fill=True, chunk_rows=chunk_rows))
    assert_same(got, expected_features(pdf))


def test_chunks_with_dense_slots(spark):
    """Readings a few seconds apart: a day alone overfills a chunk, so slots shrink."""
    import pandas as pd
    times = pd.Timestamp("2020-01-01") + pd.to_timedelta([7 * i for i in range(2000)], unit="s")
    pdf = pd.DataFrame({"station_id": "a", "datetime": times,
                        "pm2_5": [None if i % 5 == 0 else float(i % 17) for i in range(2000)],
                        "pm10": 1.0})
    got = to_pandas(feature_table(to_spark(spark, pdf), SPEC, fill=True, chunk_rows=100))
    assert_same(got, expected_features(pdf))


def test_chunked_windows_stay_small(spark):
    """No window partition of a long series exceeds the chunk plus its margins."""
    from pyspark.sql import functions as F
    pdf = random_panel(1, stations=("hot",), hours=2000)
    sizes = []

    def measure(df, by):
        sizes.extend(r["count"] for r in df.groupBy(*by).count().collect())
        return df

    out = over_series(to_spark(spark, pdf), SPEC, measure, history=26, lookahead=6, chunk_rows=200)
    assert out.count() == len(pdf) and len(sizes) > 5
    assert max(sizes) <= 200 + 26 + 6 + 3 * 24
    assert out.groupBy("datetime").count().filter(F.col("count") > 1).count() == 0


@given(st.lists(st.one_of(st.none(), st.integers(0, 99).map(float)), min_size=1, max_size=40),
       st.integers(1, 4))
@settings(max_examples=8, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_fill_never_looks_ahead(spark, values, limit):
    got = column(forward_fill(panel(spark, hours(values)), SPEC, ["pm2_5"], limit), "pm2_5")
    for i, v in enumerate(values):
        past = [x for x in values[max(0, i - limit):i + 1] if x is not None]
        assert got[i] == (past[-1] if past else None)


def test_fill_fills_first_rows_of_every_gap(spark):
    df = forward_fill(panel(spark, hours([None, 1.0, None, None, None, None, 2.0, None])), SPEC)
    assert column(df, "pm2_5") == [None, 1.0, 1.0, 1.0, None, None, 2.0, 2.0]
    assert column(df, "pm2_5_was_filled") == [False, False, True, True, False, False, False, True]


def test_whole_gap_only_leaves_long_gaps(spark):
    values = [1.0, None, None, 2.0, None, None, None, 3.0, None, 4.0, None, None]
    df = forward_fill(panel(spark, hours(values)), SPEC, whole_gap_only=True)
    assert column(df, "pm2_5") == [1.0, 1.0, 1.0, 2.0, None, None, None, 3.0, 3.0, 4.0, 4.0, 4.0]


def test_target_needs_exact_clock_distance(spark):
    df = add_target(panel(spark, hours([float(i) for i in range(14)], skip={3})), SPEC)
    valid = column(df, SPEC.target_valid)
    assert valid == [False] * 4 + [True] * 4 + [False] * 6
    assert column(df, SPEC.target)[4:8] == [10.0, 11.0, 12.0, 13.0]
    assert column(df, SPEC.target)[0] is None


def test_rolling_needs_half_of_the_window(spark):
    df = add_rolling_means(
        panel(spark, hours([1.0, None, 3.0, None, 2.0, None, None, None, 5.0])), SPEC)
    six, three = column(df, "pm2_5_roll_mean_6h"), column(df, "pm2_5_roll_mean_3h")
    assert six[5:8] == [2.0, 2.0, None]
    assert three[:9] == [None, 1.0, 1.0, 2.0, 3.0, 2.5, 2.0, 2.0, None]


def test_rolling_with_other_windows(spark):
    pdf = random_panel(3, stations=("a",))
    df = add_rolling_means(to_spark(spark, pdf), SPEC, windows=(5, 7))
    s = pdf["pm2_5"].shift(1)
    got = to_pandas(df)
    for n in (5, 7):
        want = s.rolling(n, min_periods=n // 2).mean()
        assert ((got[f"pm2_5_roll_mean_{n}h"] - want).abs().max() < 1e-9)
        assert list(got[f"pm2_5_roll_mean_{n}h"].isna()) == list(want.isna())


def test_later_values_change_no_earlier_feature(spark):
    pdf = random_panel(11, stations=("a",), hours=80)
    cut = pdf["datetime"].iloc[50]
    changed = pdf.copy()
    changed.loc[changed["datetime"] > cut, "pm2_5"] = 9999.0
    drop = [SPEC.target, SPEC.target_valid]
    a, b = (to_pandas(feature_table(to_spark(spark, p), SPEC, fill=True).drop(*drop))
            for p in (pdf, changed))
    assert_same(b[b["datetime"] <= cut], a[a["datetime"] <= cut])


def test_null_entities_are_rejected(spark):
    df = panel(spark, hours([1.0, 2.0]) + [(None, dt.datetime(2020, 1, 1), 3.0, None)])
    kept, rejected = split_null_entities(df, SPEC)
    assert kept.count() == 2 and column(rejected, "pm2_5") == [3.0]


def test_newest_rows_and_histories(spark):
    df = panel(spark, hours(range_of(29), station="a") + hours(range_of(30), station="b"))
    assert sorted(column(latest_rows(df, SPEC), "pm2_5")) == [28.0, 29.0]
    assert [r["station_id"] for r in short_histories(df, SPEC).collect()] == ["a"]
    trend = recent_trend(df, SPEC, entity="b", rows=3)
    assert column(trend, "pm2_5") == [27.0, 28.0, 29.0]
    assert [r[0] for r in entity_list(df, SPEC).collect()] == ["a", "b"]


def range_of(n):
    return [float(i) for i in range(n)]


def test_rank_filter_runs_before_the_shuffle(spark):
    df = panel(spark, hours(range_of(5)))
    plan = latest_rows(df, SPEC)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_feature_table_shuffles_once(spark, tmp_path):
    path = str(tmp_path / "panel")
    to_spark(spark, random_panel(2)).write.parquet(path)
    table = feature_table(spark.read.parquet(path), SPEC, fill=True)
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort ") == 1


def test_chunked_windows_read_the_source_once(spark, tmp_path):
    from gapwise.operators.series import add_lags
    from gapwise.plans.chunks import over_series
    from gapwise.spec import PanelSpec

    spec = PanelSpec(values=("pm2_5",), lagged=("pm2_5",))
    spark.range(400).selectExpr(
        "id % 2 as station_id", "timestampadd(HOUR, id, timestamp_ntz'2020-01-01') as datetime",
        "cast(id as double) as pm2_5").write.parquet(str(tmp_path / "source"))
    df = spark.read.parquet(str(tmp_path / "source"))

    def lags(d, by):
        return add_lags(d, spec, by=by)

    whole = over_series(df, spec, lags, spec.feature_history)
    cut = over_series(df, spec, lags, spec.feature_history, chunk_rows=60)
    assert sorted(cut.collect()) == sorted(whole.select(*cut.columns).collect())
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation \[station_id#\d+L,datetime#", plan)) == 1
