import json

import numpy as np
import pandas as pd
import pytest

from gapwise.operators import score
from gapwise.operators.models import LINEAR, PERSISTENCE, Forecaster
from gapwise.plans import course
from gapwise.sources import bundle, tables
from gapwise.sources.sinks import read_document
from gapwise.spec import PanelSpec


def write_raw(folder):
    rng = np.random.default_rng(0)
    parts = []
    for i, s in enumerate(["S1", "S2", "S3"]):
        n = 700 if s != "S3" else 20
        hours = np.arange(n)
        part = pd.DataFrame({"StationId": s, "Datetime": pd.date_range("2019-01-01", periods=n, freq="h")})
        rhythm = 100 + 50 * np.sin(2 * np.pi * hours / 24 + i)
        for j, c in enumerate(course.RAW_VALUES):
            part[c] = np.round(rhythm + j + rng.normal(size=n) * 5, 2)
        part.loc[rng.random(n) < 0.1, "PM2.5"] = np.nan
        part["AQI_Bucket"] = "Poor"
        parts.append(part)
    readings = pd.concat(parts)
    readings.to_csv(folder / "readings.csv", index=False)
    with open(folder / "readings.csv", "a") as file:
        file.write("S1,2019-01-01 00:00:00" + "," * 14 + "Poor,extra\n")
        file.write("S2,no time\n")
        file.write(",2019-01-01 00:00:00\n")
    pd.DataFrame({"StationId": ["S1", "S2"], "StationName": ["One", "Two"], "City": ["X", None],
                  "State": "Y", "Status": None}).to_csv(folder / "stations.csv", index=False)
    pd.DataFrame({"country": "IN", "state": "Y", "city": "X", "station": "One",
                  "last_update": "01-02-2019 05:00:00", "latitude": 20, "longitude": 80,
                  "pollutant_id": ["PM2.5", "CO"], "pollutant_min": 1, "pollutant_max": [9, 8],
                  "pollutant_avg": [5, np.nan]}).to_csv(folder / "snapshot.csv", index=False)


def test_course_from_raw_files(spark, tmp_path):
    write_raw(tmp_path)
    out, spec = str(tmp_path / "out"), PanelSpec()
    paths = [str(tmp_path / f"{n}.csv") for n in ("readings", "stations", "snapshot")]
    course.build(spark, *paths, out, spec, {"min_span_days": 20, "min_records": 500})

    audit = {(r["table"], r["column"], r["measure"]): r["value"]
             for r in spark.read.json(f"{out}/audit").collect()}
    assert audit["readings", None, "n_rows"] == "1422"
    assert audit["readings", "StationId", "n_distinct"] == "3"
    assert audit["stations", "Status", "n_missing"] == "2"
    assert audit["snapshot", "last_update", "min_time"] == "2019-02-01 05:00:00"
    assert audit["readings", None, "rows_in_duplicated_keys"] == "0"
    log = {r["reason"]: r["n_rows"] for r in spark.read.json(f"{out}/cleaning/rejected").collect()}
    assert log == {"surplus_cells": 1, "unreadable_time": 1, "null_entity": 1}
    assert spark.read.json(f"{out}/cleaning/rows").first().asDict() == {
        "rows_read": 1423, "rows_cleaned": 1420}
    stages = {r["stage"]: r["n_rows"] for r in spark.read.json(f"{out}/cleaning/stages").collect()}
    assert stages["raw"] == 1422 and stages["first_of_key"] == 1420
    fills = {r["column"]: r for r in spark.read.json(f"{out}/cleaning/fills").collect()}
    assert len(fills) == 13 and fills["pm2_5"]["filled"] > 0
    assert spark.read.parquet(f"{out}/snapshot").count() == 1
    rejected = spark.read.parquet(f"{out}/rejected")
    assert rejected.filter("row_line LIKE '%extra'").count() == 1 and rejected.count() == 3
    log = spark.read.json(f"{out}/snapshot_log/rows").first().asDict()
    assert log == {"rows_read": 2, "rows_distinct": 2, "unreadable_times": 0, "rows_outside": 0,
                   "rows_impossible": 0, "missing_averages": 1, "n_stations": 1, "n_cities": 1,
                   "rows_wide": 1}
    assert spark.read.json(f"{out}/snapshot_log/time").first()["is_single"]
    assert spark.read.json(f"{out}/cleaning/duplicated_keys").first()["duplicated_keys"] == 0

    done = course.learn(spark, out, spec, "2019-01-15", "2019-01-22", (PERSISTENCE, LINEAR))
    assert done.selected == LINEAR
    meta = read_document(spark, f"{out}/model/metadata")
    assert set(meta["stations_used"]) == {"S1", "S2"} and meta["n_features"] == 103

    course.judge(spark, out, spec, sample_rows=40)
    overall = spark.read.option("header", True).csv(f"{out}/evaluation/overall").first()
    assert float(overall["mae"]) == pytest.approx(done.test["mae"])
    by_station = spark.read.option("header", True).csv(f"{out}/evaluation/by_station").collect()
    assert {r["station_name"] for r in by_station} == {"One", "Two"}
    assert spark.read.option("header", True).csv(f"{out}/explanation/importance").count() == 103
    example = [json.loads(l) for p in (tmp_path / "out/explanation/example").glob("*.json")
               for l in p.read_text().splitlines()]
    assert [e["rank"] for e in sorted(example, key=lambda e: e["rank"])] == [1, 2, 3, 4, 5]

    got = {r["station"]: r for r in course.forecast(spark, out, spec).collect()}
    assert set(got) == {"S1", "S2"} and got["S2"]["city"] == "Unknown" and got["S1"]["in_training"]
    assert [r["station_id"] for r in course.without_forecast(spark, out, spec).collect()] == ["S3"]
    one = course.forecast(spark, out, spec, station="S1").first()
    assert one["predicted_pm25"] == pytest.approx(got["S1"]["predicted_pm25"])


def months_of(folder):
    """Folder of a month to its files and their times of change."""
    return {m.name: {(f.name, f.stat().st_mtime_ns) for f in m.glob("*.parquet")}
            for m in folder.glob("part_period=*")}


def write_months(folder, months, late=None):
    """Readings of one station up to the end of 2019, another that stops early; ``late`` leaves
    the rows of one month to a second file."""
    hours = pd.date_range(end="2019-12-31 23:00", periods=months * 104, freq="7h")
    parts = []
    for s, n in (("S1", len(hours)), ("S2", 200)):
        part = pd.DataFrame({"StationId": s, "Datetime": hours[:n]})
        part["PM2.5"] = np.where(np.arange(n) % 5 == 0, np.nan, np.arange(n) % 97)
        part["PM10"] = np.arange(n) % 89
        parts.append(part)
    rows = pd.concat(parts).sample(frac=1, random_state=1)
    rows["Datetime"] = rows["Datetime"].dt.strftime("%Y-%m-%d %H:%M:%S")
    held = rows["Datetime"].str.startswith(late) if late else np.zeros(len(rows), bool)
    rows[~held].to_csv(folder / "readings.csv", index=False)
    rows[held].to_csv(folder / "late.csv", index=False)
    pd.DataFrame({"StationId": ["S1", "S2"], "StationName": ["One", "Two"]}).to_csv(
        folder / "stations.csv", index=False)
    pd.DataFrame({"country": "IN", "state": "Y", "city": "X", "station": "One",
                  "last_update": "01-02-2019 05:00:00", "latitude": 20, "longitude": 80,
                  "pollutant_id": ["PM2.5"], "pollutant_min": 1, "pollutant_max": [9],
                  "pollutant_avg": [5]}).to_csv(folder / "snapshot.csv", index=False)
    return [str(folder / f"{n}.csv") for n in ("readings", "stations", "snapshot")]


def test_late_month_replaces_only_what_it_reaches(spark, tmp_path):
    spec = PanelSpec(values=("pm2_5", "pm10"), lagged=("pm2_5", "pm10"), step_seconds=7 * 3600)
    gates = {"min_span_days": 20, "min_records": 100, "min_coverage": 0.5}
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    whole, split = str(tmp_path / "a/out"), str(tmp_path / "b/out")
    course.build(spark, *write_months(tmp_path / "a", 9), whole, spec, gates)
    paths = write_months(tmp_path / "b", 9, late="2019-08")
    course.build(spark, *paths, split, spec, gates)
    before = {t: months_of(tmp_path / "b/out" / t) for t in ("clean", "features")}
    assert course.rebuild_months(spark, str(tmp_path / "b/late.csv"), paths[1], split, spec) == [201908]
    touched = {"clean": {201908, 201909}, "features": {201907, 201908, 201909}}
    for name, months in touched.items():
        after = months_of(tmp_path / "b/out" / name)
        changed = {m for m in after if after[m] != before[name].get(m)}
        assert changed == {f"part_period={m}" for m in months}
        got, want = (spark.read.parquet(f"{o}/{name}") for o in (split, whole))
        assert got.exceptAll(want.select(*got.columns)).count() == 0 and got.count() == want.count()
    for name in ("clean_states", "feature_states"):
        got, want = (spark.read.parquet(f"{o}/{name}") for o in (split, whole))
        assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_forecasts_read_the_newest_months(spark, tmp_path):
    spec = PanelSpec(values=("pm2_5", "pm10"), lagged=("pm2_5", "pm10"), step_seconds=7 * 3600)
    out = str(tmp_path / "out")
    course.build(spark, *write_months(tmp_path, 24), out, spec,
                 {"min_span_days": 20, "min_records": 100, "min_coverage": 0.5})
    bundle.save_bundle(spark, Forecaster(PERSISTENCE, ("pm2_5",), {"pm2_5": 7.0}), f"{out}/model",
                       {"stations_used": ["S1"]})
    assert len(months_of(tmp_path / "out/clean")) >= 24
    one = course.newest_months(spark, out, spec, 30, station="S1")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "201912" in plan and "201911" not in plan
    assert one.count() == one.filter("year(datetime) = 2019 AND month(datetime) = 12").count() > 0
    clean = tables.read_panel(spark, f"{out}/clean", spec)
    got, want = course.forecast(spark, out, spec), score.score_latest(
        clean, bundle.load_bundle(spark, f"{out}/model"), spec, trained_on=["S1"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.count() == 2
    assert course.without_forecast(spark, out, spec, 300).first()["station_id"] == "S2"
