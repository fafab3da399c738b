import datetime as dt
import json
import math

import numpy as np
import pandas as pd
import pytest
from panels import SPEC, random_panel, to_pandas, to_spark

from pyspark.sql import functions as F

from gapwise.functions.coerce import parse_time
from gapwise.operators import audit, coverage, dedup, joins, metrics, series, snapshot, split
from gapwise.plans.build import clean_panel, clean_snapshot, split_readings
from gapwise.plans.sizing import broadcast_if_small
from gapwise.sources import sinks, tables
from gapwise.spec import PanelSpec

T0 = dt.datetime(2020, 1, 1)


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


# Duplicates and joins

def test_duplicates(spark):
    df = spark.createDataFrame(
        [(1, "a", None), (1, "a", None), (1, "b", 2.0), (2, "c", 3.0), (None, "d", 1.0),
         (None, "e", 1.0)], "k int, s string, v double")
    assert dedup.drop_exact_duplicates(df).count() == 5
    assert rows(dedup.exact_duplicate_count(df)) == [(6, 5, 1)]
    assert rows(dedup.rows_in_duplicated_keys(df, ["k"])) == [(5, 2)]
    assert rows(dedup.keep_first(df, ["k"], ["s"]).select("k", "s"), "k") == [
        (None, "d"), (1, "a"), (2, "c")]
    empty = df.filter("k > 5")
    assert rows(dedup.exact_duplicate_count(empty)) == [(0, 0, 0)]


def test_enrich_keeps_rows_and_matches_nulls(spark):
    panel = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "id string, v int")
    dim = spark.createDataFrame([("a", "x"), (None, "none")], "id string, name string")
    out = joins.enrich(panel, dim, "id")
    assert rows(out.select("v", "name"), "v") == [(1, "x"), (2, None), (3, "none")]
    assert rows(joins.missing_metadata(out, "name")) == [(3, 1)]
    assert rows(joins.keep_selected(panel, dim, "id")) == [("a", 1)]


def test_large_sides_are_not_broadcast(spark):
    small, large = spark.range(10), spark.range(1000)
    def hint(df):
        return "broadcast" in df._jdf.queryExecution().logical().toString()
    assert hint(broadcast_if_small(small, 100)) and not hint(broadcast_if_small(large, 100))


# Audit

def test_audit(spark):
    df = spark.createDataFrame([("a", "1.5"), ("a", "x"), ("b", "-2"), (None, None)],
                               "`Station.Id` string, v string")
    assert rows(audit.missing_values(df)) == [("Station.Id", "string", 4, 1), ("v", "string", 4, 1)]
    assert rows(audit.table_shape(df, "t")) == [("t", 4, 2)]
    assert rows(audit.distinct_counts(df, ["Station.Id"])) == [("Station.Id", 2)]
    assert rows(audit.numeric_ranges(df, ["v", "w"])) == [("v", -2.0, 1.5, -0.25, 2, 50.0)]
    assert rows(audit.negative_counts(df, ["v"])) == [("v", 1)]
    times = spark.createDataFrame([("2020-01-01",), ("bad",), (None,)], "t string")
    assert rows(audit.time_range(times, "t")) == [(T0, T0, 2)]


def test_stage_counts_follow_the_cleaning(spark):
    raw = spark.createDataFrame(
        [("a", "2020-01-01 00:00:00", 1.0)] * 3 + [("a", "2020-01-01 00:00:00", 2.0),
         ("a", "bad", 1.0), ("b", "2020-01-01 00:00:00", None),
         (None, "2020-01-01 00:00:00", 1.0), (None, "2020-01-01 00:00:00", 2.0)],
        "station_id string, datetime string, pm2_5 double")
    assert dict(rows(audit.stage_counts(raw, SPEC))) == {
        "raw": 8, "exact_dedup": 6, "parsed_time": 5, "known_entity": 3, "first_of_key": 2}
    places = spark.createDataFrame([("a", "A")], "station_id string, city string")
    assert clean_panel(raw, places, SPEC, fill=False).count() == 2
    good, rejected = split_readings(raw, SPEC)
    assert good.count() == 5
    assert sorted(r["reason"] for r in rejected.collect()) == [
        "null_entity", "null_entity", "unreadable_time"]


# Cleaning from raw files

def test_raw_files_to_clean_panel(spark, tmp_path):
    readings = ["StationId,Datetime,PM2.5,PM10,NO,NO2,NOx,NH3,CO,SO2,O3,Benzene,Toluene,Xylene,AQI,AQI_Bucket"]
    for h, v in enumerate(["5", "", "NA", "", "-1", "8d"]):
        readings.append(f"S1,2020-01-01 0{h}:00:00,{v},1,,,,,,,,,,,,Good")
    readings += [readings[1], "S1,no time,1,,,,,,,,,,,,,", "S2,2020-01-01 00:00:00,7,,,,,,,,,,,,,",
                 ",2020-01-01 00:00:00,9,,,,,,,,,,,,,", "S2,2020-01-01 00:00:00,6,,,,,,,,,,,,,"]
    stations = ["StationId,StationName,City,State,Status", "S1,One,X,Y,", "S1,One,X,Y,"]
    for name, lines in (("r.csv", readings), ("s.csv", stations)):
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    spec = PanelSpec()
    tables.verify_inputs(spark, [str(tmp_path / "r.csv")])
    with pytest.raises(FileNotFoundError, match="x.csv.*y.csv"):
        tables.verify_inputs(spark, [str(tmp_path / n) for n in ("x.csv", "r.csv", "y.csv")])
    clean = clean_panel(tables.read_readings(spark, str(tmp_path / "r.csv")),
                        tables.read_stations(spark, str(tmp_path / "s.csv")), spec)
    assert len(clean.columns) == 16 + 1 + 4 + 13
    got = to_pandas(clean)
    one = got[got["station_id"] == "S1"]
    assert [None if math.isnan(v) else v for v in one["pm2_5"]] == [5, 5, 5, None, -1, -1]
    assert list(one["pm2_5_was_filled"]) == [False, True, True, False, False, True]
    assert list(one["negative_value_flag"]) == [False] * 4 + [True, False]
    assert list(got["station_name"]) == ["One"] * 6 + [None]
    assert list(got[got["station_id"] == "S2"]["pm2_5"]) == [6.0]

    for path, write in (("p", sinks.write_table), ("c.csv", sinks.write_csv)):
        write(clean, str(tmp_path / path))
        back = tables.read_panel(spark, str(tmp_path / path), spec)
        assert dict(back.dtypes)["pm2_5_was_filled"] == "boolean"
        assert back.filter("pm2_5_was_filled").count() == 3
    with pytest.raises(ValueError, match="datetime"):
        sinks.write_table(clean.drop("datetime"), str(tmp_path / "bad"))
        tables.read_panel(spark, str(tmp_path / "bad"), spec)


def test_sinks(spark, tmp_path):
    report = spark.createDataFrame([("a", None)], "k string, v int")
    sinks.write_json(report, str(tmp_path / "j"))
    part = next((tmp_path / "j").glob("part-*.json"))
    assert json.loads(part.read_text()) == {"k": "a", "v": None}
    sinks.write_document(spark, {"a": [1, 2], "t": T0}, str(tmp_path / "d"))
    assert sinks.read_document(spark, str(tmp_path / "d")) == {"a": [1, 2], "t": str(T0)}


# Snapshot

SNAP = ("country string, state string, city string, station string, last_update string, "
        "latitude string, longitude string, pollutant_id string, pollutant_min string, "
        "pollutant_max string, pollutant_avg string")


def snapshot_rows(spark):
    def row(station, pollutant, low, high, mean, lat="20", time="01-02-2020 05:00:00"):
        return ("IN", "S", "C", station, time, lat, "80", pollutant, low, high, mean)
    return spark.createDataFrame([
        row("a", "PM2.5", "1", "9", "5"), row("a", "PM2.5", "1", "9", "5"),
        row("a", "CO", "9", "1", "5"), row("b", "CO", "1", "9", "NA"),
        row("c", "CO", "1", "3", "2", lat=None), row("d", "CO", "1", "3", "2", time="oops"),
    ], SNAP)


def test_snapshot_keeps_flagged_places(spark):
    wide = clean_snapshot(snapshot_rows(spark), ["PM2.5", "CO"])
    assert wide.columns == ["country", "state", "city", "station", "timestamp", "latitude",
                            "longitude", "CO", "PM2.5", *snapshot.FLAGS]
    got = {r["station"]: r for r in wide.collect()}
    assert set(got) == set("abcd")
    assert (got["a"]["CO"], got["a"]["PM2.5"]) == (5.0, 5.0)
    assert got["a"]["pollutant_flag_impossible"] and not got["b"]["pollutant_flag_impossible"]
    assert got["c"]["lat_lon_flag_invalid"] and got["d"]["timestamp"] is None


def test_snapshot_without_null_keys(spark):
    wide = clean_snapshot(snapshot_rows(spark), ["PM2.5", "CO"], drop_null_keys=True)
    assert [r["station"] for r in wide.orderBy("station").collect()] == ["a"]


def test_snapshot_shapes(spark):
    wide = spark.createDataFrame([("a", 1.0)], "station string, `PM2.5` double")
    assert snapshot.snapshot_wide(wide) is wide
    with pytest.raises(ValueError, match="country"):
        snapshot.snapshot_wide(spark.createDataFrame(
            [("a", "CO", 1.0)], "station string, pollutant_id string, pollutant_avg double"))
    times = spark.createDataFrame([(T0,), (None,), (T0,)], "timestamp timestamp_ntz")
    assert rows(snapshot.single_timestamp(times)) == [(True, T0)]


# Coverage. Values published for the original panel.

PUBLISHED = [
    ("UP014", 17.14, 100.0, 39931), ("UP012", 17.21, 100.0, 39896), ("TN001", 17.94, 100.0, 39548),
    ("KA009", 20.5, 100.0, 38314), ("DL031", 17.31, 100.0, 37992), ("TG004", 9.06, 100.0, 30517),
    ("DL034", 9.71, 100.0, 28933), ("TG003", 4.55, 100.0, 28209), ("RJ005", 8.11, 100.0, 24540),
    ("TG002", 8.53, 100.0, 24437), ("RJ004", 0.95, 100.0, 23560), ("UP016", 3.0, 100.0, 23466),
    ("KL008", 12.16, 100.0, 23406), ("RJ006", 1.52, 100.0, 23170), ("DL012", 9.07, 100.0, 22588),
    ("DL017", 9.65, 100.0, 22276), ("DL004", 9.77, 100.0, 22245), ("DL030", 11.54, 100.0, 21831),
]
CHOSEN = ["TG004", "DL034", "TG003", "RJ005", "TG002", "RJ004", "UP016", "KL008", "RJ006", "DL012"]


def test_published_subset(spark):
    report = spark.createDataFrame(
        PUBLISHED, "station_id string, missing_pct double, continuity_pct double, usable_rows long")
    assert [r[0] for r in coverage.recommend_subset(report.repartition(3), SPEC).collect()] == CHOSEN


def test_published_first_gate(spark):
    report = spark.createDataFrame(
        [("DL013", 2007, 48192, 0.6172), ("DL007", 2007, 48192, 0.5806), ("short", 364, 9000, 0.9),
         ("few", 400, 4999, 0.9)], "station_id string, span_days int, n_records int, coverage double")
    assert [r[0] for r in coverage.select_entities(report).collect()] == ["DL013"]


def test_coverage_numbers(spark):
    t = [T0 + dt.timedelta(hours=h) for h in (0, 1, 2, 30)]
    df = spark.createDataFrame(
        [("a", t[0], None, None, False, None), ("a", t[1], 1.0, "A", True, 5.0),
         ("a", t[2], 2.0, "A", True, None), ("a", t[3], 3.0, "A", None, 7.0)],
        "station_id string, datetime timestamp_ntz, pm2_5 double, city string, "
        "target_horizon_valid boolean, target_pm25_6h double")
    first = coverage.coverage_report(df, SPEC).first()
    assert (first["span_days"], first["n_records"], first["coverage"], first["city"]) == (1, 4, 0.75, None)
    deep = coverage.deep_coverage(df, SPEC).first()
    assert (deep["expected_slots"], deep["continuity_pct"], deep["missing_pct"],
            deep["usable_rows"]) == (31, 12.9, 25.0, 1)


# Split and samples

def test_split_is_half_open(spark):
    days = [dt.datetime(2018, 12, 31, 23), dt.datetime(2019, 1, 1), dt.datetime(2019, 8, 31, 23),
            dt.datetime(2019, 9, 1)]
    df = spark.createDataFrame([("a", d) for d in days], "station_id string, datetime timestamp_ntz")
    labelled = split.with_split(df, SPEC)
    assert [r["split"] for r in labelled.orderBy("datetime").collect()] == \
        ["train", "valid", "valid", "test"]
    assert split.require_all_splits(labelled) == {"train": 1, "valid": 2, "test": 1}
    with pytest.raises(ValueError, match="test"):
        split.require_all_splits(labelled.filter("split != 'test'"))


def test_feature_columns():
    spec = PanelSpec()
    columns = ["station_id", "datetime", "pm2_5", "aqi_bucket", "negative_value_flag", "city",
               "pm2_5_was_filled", "hour", "pm2_5_lag_1h", "target_pm25_6h",
               "target_horizon_valid", "split"]
    assert split.feature_columns(columns, spec) == ["pm2_5", "hour", "pm2_5_lag_1h"]


def test_sample_is_repeatable(spark):
    df = spark.range(20_000).withColumnRenamed("id", "k")
    a = rows(split.seeded_sample(df.repartition(3), ["k"], 300), "k")
    b = rows(split.seeded_sample(df.repartition(7), ["k"], 300), "k")
    whole = split.seeded_sample(df, ["k"], 15_000).count()
    assert a == b and len(a) == 300 and whole == 15_000
    assert split.seeded_sample(df.limit(10), ["k"], 300).count() == 10
    assert rows(split.seeded_sample(df, ["k"], 300, seed=1), "k") != a


# Metrics

def test_metrics_equal_numpy(spark):
    rng = np.random.default_rng(0)
    y = rng.gamma(2, 50, 400)
    p = y + rng.normal(size=400) * 20
    df = spark.createDataFrame(pd.DataFrame({"g": np.arange(400) % 3, "y": y, "p": p})).repartition(5)
    got = metrics.regression_metrics(df, "y", "p").first()
    assert got["mae"] == pytest.approx(np.abs(y - p).mean())
    assert got["rmse"] == pytest.approx(np.sqrt(((y - p) ** 2).mean()))
    assert got["r2"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    by = metrics.metrics_by_entity(df, "y", "p", "g").collect()
    assert [r["mae"] for r in by] == sorted(r["mae"] for r in by)
    strata = {r["stratum"]: r["n_rows"] for r in metrics.metrics_by_stratum(df, "y", "p").collect()}
    assert strata == {"high": int((y >= 91).sum()), "normal": int((y < 91).sum())}
    counts = {r["bin"]: r["n_rows"] for r in metrics.histogram(
        metrics.add_residual(df, "y", "p"), "residual").collect()}
    want, _ = np.histogram(y - p, bins=80)
    assert counts == {i: n for i, n in enumerate(want) if n}


@pytest.mark.parametrize("y, p, r2", [
    ([5.0, 5.0], [5.0, 5.0], 1.0), ([5.0, 5.0], [5.0, 6.0], 0.0), ([5.0], [5.0], None)])
def test_r2_edges(spark, y, p, r2):
    df = spark.createDataFrame(list(zip(y, p)), "y double, p double")
    assert metrics.regression_metrics(df, "y", "p").first()["r2"] == r2


def test_empty_stratum_gives_no_row(spark):
    df = spark.createDataFrame([(5.0, 4.0)], "y double, p double")
    assert [r["stratum"] for r in metrics.metrics_by_stratum(df, "y", "p").collect()] == ["normal"]
    assert metrics.regression_metrics(df.filter("y > 9"), "y", "p").count() == 0


def test_first_model_wins_a_tie(spark):
    df = spark.createDataFrame(
        [("b", 1, "valid", 2.0), ("a", 0, "valid", 2.0), ("c", 2, "valid", 3.0), ("c", 2, "train", 1.0)],
        "model string, position int, split string, mae double")
    assert rows(metrics.select_model(df)) == [("a", 2.0)]


def test_shuffled_rows_change_nothing(spark):
    pdf = random_panel(5)
    df = to_spark(spark, pdf)
    a = coverage.coverage_report(df, SPEC).collect()
    assert a == coverage.coverage_report(to_spark(spark, pdf.sample(frac=1, random_state=1)), SPEC).collect()


# Nothing is lost without a word

def test_files_are_read_by_header(spark, tmp_path):
    for name, lines in (
            ("few", ["PM2.5,StationId,Datetime,Extra", "5,S1,13-01-2019 02:00,x", "n/a,S1,2019,y"]),
            ("swapped", ["Datetime,StationId,PM10,PM2.5", "2020-01-01 00:00:00,S1,7,#N/A"])):
        (tmp_path / f"{name}.csv").write_text("\n".join(lines) + "\n")
    few = tables.read_readings(spark, str(tmp_path / "few.csv"))
    assert few.columns == ["StationId", "Datetime", "PM2.5", "Extra"]
    assert rows(few) == [("S1", "13-01-2019 02:00", "5", "x"), ("S1", "2019", None, "y")]
    swapped = tables.read_readings(spark, str(tmp_path / "swapped.csv"))
    assert rows(swapped) == [("S1", "2020-01-01 00:00:00", None, "7")]
    places = spark.createDataFrame([("S1", "X")], "station_id string, city string")
    clean = clean_panel(few, places, PanelSpec(), pattern="dd-MM-yyyy HH:mm")
    assert [str(r["datetime"]) for r in clean.collect()] == ["2019-01-13 02:00:00"]


@pytest.mark.parametrize("text", ["2019", "2019-05", "05", "2019-05-01 7", "", "10:00"])
def test_part_of_a_time_is_no_time(spark, text):
    df = spark.createDataFrame([(text,), ("2019-05-01T07:30",)], "t string")
    assert [str(r[0]) for r in parse_time(df, "t").collect()] == ["None", "2019-05-01 07:30:00"]


def test_every_pollutant_is_pivoted(spark):
    long = snapshot_rows(spark).withColumn("pollutant_id", F.when(
        F.col("station") == "b", "Lead").otherwise(F.col("pollutant_id")))
    wide = clean_snapshot(long)
    assert wide.columns[7:10] == ["CO", "Lead", "PM2.5"]
    with pytest.raises(ValueError, match="Lead"):
        clean_snapshot(long, ["CO", "PM2.5"])


def test_table_report_scans_three_times(spark, tmp_path):
    sinks.write_table(spark.range(20).selectExpr("id as k", "cast(id as string) as v", "'x' as t"),
                      str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    report = audit.table_report(df, "t", ["k"], "t", None, ["v"], ["k"])
    found = {(r["column"], r["measure"]): r["value"] for r in report.collect()}
    assert found["v", "max"] == "19.0" and found["k", "n_distinct"] == "20"
    assert found["t", "unparseable"] == "20" and found[None, "duplicate_rows"] == "0"
    plan = report._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert plan.count("Scan parquet") <= 3


def test_one_entity_reaches_the_scan(spark, tmp_path):
    sinks.write_table(spark.range(50).selectExpr(
        "id % 5 as station_id", "timestamp_ntz'2020-01-01 00:00:00' as datetime",
        "cast(id as double) as pm2_5"), str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    one = series.recent_trend(df, PanelSpec(), entity="3")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(station_id,3)" in plan and one.count() == 10
    assert series.recent_trend(df, PanelSpec(), entity="x").count() == 0


# Raw files ------------------------------------------------------------------------

def write_lines(path, *lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_csv_cells_and_rows_that_do_not_fit(spark, tmp_path):
    path = write_lines(
        tmp_path / "a.csv", "StationId,Datetime,PM2.5",
        '"A ""x"", y",2020-01-01 00:00:00,1', "B,2020-01-01 00:00:00", "C,2020-01-01 00:00:00,3,4",
        '"D,2020-01-01 00:00:00,3', "E,,NA", "", '5" pipe,1,2', '"F,1","2,3",""')
    good = tables.read_csv(spark, path, ["Datetime"])
    assert good.columns == ["Datetime", "StationId", "PM2.5"]
    assert sorted(map(tuple, good.collect()), key=str) == sorted([
        ("2020-01-01 00:00:00", 'A "x", y', "1"), ("2020-01-01 00:00:00", "B", None),
        (None, "E", None), ("1", '5" pipe', "2"), ("2,3", "F,1", None)], key=str)
    assert good.count() == 5 and good.select("`PM2.5`").count() == 5
    marked = tables.marked_csv(spark, path)
    lines = {r["reason"]: r["line"] for r in tables.misfit_lines(marked).collect()}
    assert lines == {"surplus_cells": "C,2020-01-01 00:00:00,3,4",
                     "unclosed_quote": '"D,2020-01-01 00:00:00,3'}
    assert tables.misfit_lines(marked).first()["file"].endswith("a.csv")
    strict = tables.misfit_lines(tables.marked_csv(spark, path, short_rows=False))
    assert [r["line"] for r in strict.filter("reason = 'missing_cells'").collect()] == [
        "B,2020-01-01 00:00:00"]


def test_csv_with_line_ends_in_cells(spark, tmp_path):
    path = write_lines(tmp_path / "a.csv", "a,b", '"x', 'y",1', "z,2,3")
    rows = tables.read_csv(spark, path, multi_line=True).collect()
    assert [tuple(r) for r in rows] == [("x\ny", "1")]
    assert tables.misfit_lines(tables.marked_csv(spark, path, multi_line=True)).count() == 1


def test_csv_without_rows(spark, tmp_path):
    path = write_lines(tmp_path / "a.csv", "a,b")
    assert tables.read_csv(spark, path).collect() == []
    assert tables.misfit_lines(tables.marked_csv(spark, path)).collect() == []


def test_first_in_file_order_stays(spark, tmp_path):
    """The first row of a key is the first in the files, not the one of the smallest values."""
    for name, rows in (("a", [("k", 9), ("k", 1), ("m", 5)]), ("b", [("k", 0), ("m", 1), ("n", 2)])):
        spark.createDataFrame(rows, "key string, v long").coalesce(1).write.parquet(str(tmp_path / name))
    paths = [str(next((tmp_path / n).glob("*.parquet"))) for n in ("a", "b")]
    ordered = tables.in_file_order(spark.read.parquet(*paths))
    by_file = {p: i for i, p in enumerate(paths)}
    assert len(by_file) == ordered.select("source_file").distinct().count() == 2
    got = dedup.keep_first(ordered, ["key"], tables.FILE_ORDER).select("key", "v").collect()
    first = sorted(paths, key=lambda p: p)[0]
    want = {"k": 9, "m": 5, "n": 2} if first == paths[0] else {"k": 0, "m": 1, "n": 2}
    assert {r["key"]: r["v"] for r in got} == want

    spec = PanelSpec(values=("pm2_5",), lagged=("pm2_5",))
    path = write_lines(tmp_path / "r.csv", "StationId,Datetime,PM2.5",
                       "S,2020-01-01 00:00:00,7", "S,2020-01-01 00:00:00,3")
    places = spark.createDataFrame([("S", "One")], "station_id string, station_name string")
    rows = tables.fitting_rows(tables.marked_csv(spark, path), keep_order=True)
    assert clean_panel(rows, places, spec, order=tables.FILE_ORDER).first()["pm2_5"] == 7.0
    assert clean_panel(tables.read_csv(spark, path), places, spec).first()["pm2_5"] == 3.0


def test_states_merge_to_the_whole(spark):
    from gapwise.operators import states


    features = series.add_target(to_spark(spark, random_panel(2, hours=900)), SPEC).withColumn(
        "city", F.concat(F.lit("c"), F.month("datetime").cast("string")))
    for kind in ("month", "day"):
        known = states.period_states(features, SPEC, kind)
        got = states.deep_coverage_of_states(known, SPEC)
        assert got.exceptAll(coverage.deep_coverage(features, SPEC).select(*got.columns)).count() == 0
        got = states.coverage_of_states(known, SPEC)
        assert got.exceptAll(coverage.coverage_report(features, SPEC).select(*got.columns)).count() == 0
        newest = states.newest_periods(known, SPEC, 30)
        want = states.with_period(series.newest_rows(features, SPEC, 30), SPEC, kind).select(
            "station_id", states.PERIOD).distinct()
        assert sorted(map(tuple, newest.collect())) == sorted(map(tuple, want.collect()))
    assert states.short_entities(known, SPEC, 10_000).count() == 3
    with pytest.raises(ValueError):
        states.period_of(F.col("datetime"), "year")


def test_reached_periods(spark):
    from gapwise.operators import states

    spec = PanelSpec()
    rows = [("a", 1, 5), ("a", 2, 1), ("a", 3, 4), ("a", 5, 9), ("b", 1, 3), ("b", 4, 2)]
    known = spark.createDataFrame(rows, f"station_id string, {states.PERIOD} int, n_rows long")
    reach = lambda *p, **k: states.reached_periods(known, spec, p, **k)
    assert reach(3) == [3] and reach(3, back=1) == [1, 2, 3] and reach(3, ahead=1) == [3, 4, 5]
    assert reach(5, back=2) == [3, 4, 5] and reach(5, back=5) == [1, 2, 3, 4, 5]
    assert reach(2, 2, back=1, ahead=5) == [1, 2, 3, 4, 5] and reach() == []


def test_sketches_of_nothing(spark):
    from gapwise.operators import states

    none = spark.createDataFrame([], "g string, a long")
    sketches = states.distinct_sketches(none, ["a"], ["g"])
    assert [tuple(r) for r in states.distinct_estimates(sketches, ["a"]).collect()] == [("a", 0)]
