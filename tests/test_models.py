import datetime as dt
from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest
from panels import SPEC, expected_features, random_panel, to_pandas, to_spark
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from gapwise.operators import attribution as attr
from gapwise.operators.models import (
    BOOSTED, FOREST, LABEL, LINEAR, PERSISTENCE, Forecaster, best_prefix, fit_boosted,
    fit_forest, fit_linear, training_vectors)
from gapwise.operators.score import newest_features, score_latest, score_station
from gapwise.operators.trees import node_table
from gapwise.plans import train as training
from gapwise.plans.build import feature_table
from gapwise.sources import bundle

FEATURES = ("a", "b", "c")
MEDIANS = {"a": 0.5, "b": 0.5, "c": 0.5}


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    x = rng.random((400, 3))
    y = 10 * x[:, 0] + 5 * (x[:, 1] > 0.4) * x[:, 2] + rng.normal(size=400) * 0.1
    pdf = pd.DataFrame({"id": range(400), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y})
    return spark.createDataFrame(pdf)


def vectors(points):
    return training_vectors(points, FEATURES, MEDIANS, "y").cache()


def shapley(nodes, weight, x):
    """Shapley values by enumerating all feature sets of a tree."""
    nodes = nodes.set_index("id")

    def expected(known, at=0):
        n = nodes.loc[at]
        if n["left"] < 0:
            return n["value"]
        if n["feature"] in known:
            return expected(known, n["left"] if x[int(n["feature"])] <= n["threshold"] else n["right"])
        return sum(expected(known, n[side]) * nodes.loc[n[side]]["rows"] / n["rows"]
                   for side in ("left", "right"))

    m = len(x)
    phi = np.zeros(m)
    for i in range(m):
        others = [j for j in range(m) if j != i]
        for k in range(m):
            for group in combinations(others, k):
                share = factorial(k) * factorial(m - k - 1) / factorial(m)
                phi[i] += share * (expected({*group, i}) - expected(set(group)))
    return weight * phi, weight * expected(set())


@pytest.mark.parametrize("kind", ["forest", "boosted", "tiny_groups"])
def test_tree_attribution_is_exact(spark, points, kind, monkeypatch):
    train = vectors(points)
    if kind == "boosted":
        model, _ = fit_boosted(train, train, maxIter=5, maxDepth=3)
    else:
        model = fit_forest(train, numTrees=4, maxDepth=5)
    if kind == "tiny_groups":
        monkeypatch.setattr(attr, "LEAVES_PER_FILE", 20)
    forecaster = Forecaster(kind, FEATURES, MEDIANS, model)
    got = attr.attribute(points.limit(30), forecaster).collect()
    nodes, weights = node_table(model).orderBy("tree", "id").toPandas(), np.array(model.treeWeights)
    if kind != "boosted":
        weights = weights / weights.sum()
    for r in got:
        assert r["base"] + sum(r["phi"]) == pytest.approx(r["prediction"], abs=1e-6)
    for r in got[:5]:
        parts = [shapley(t, weights[i], r["x"]) for i, t in nodes.groupby("tree")]
        np.testing.assert_allclose(r["phi"], sum(p for p, _ in parts), atol=1e-9)
        assert r["base"] == pytest.approx(sum(b for _, b in parts))


def test_trees_without_splits_add_to_the_base(spark, points):
    flat = points.withColumn("y", F.lit(3.0))
    forecaster = Forecaster("flat", FEATURES, MEDIANS, fit_forest(vectors(flat), numTrees=2, maxDepth=3))
    r = attr.attribute(points.limit(1), forecaster).first()
    assert (r["base"], list(r["phi"])) == (3.0, [0.0, 0.0, 0.0])


def test_linear_attribution_and_reports(spark, points):
    model = fit_linear(vectors(points))
    forecaster = Forecaster(LINEAR, FEATURES, MEDIANS, model)
    means = points.agg(*[F.avg(f).alias(f) for f in FEATURES]).first().asDict()
    shares = attr.attribute(points, forecaster, means).cache()
    for r in shares.limit(20).collect():
        assert r["base"] + sum(r["phi"]) == pytest.approx(r["prediction"], abs=1e-8)
    importance = attr.global_importance(shares, FEATURES).collect()
    assert importance[0]["feature"] == "a" and len(importance) == 3
    example = attr.highest_prediction(shares, ["id"])
    records = attr.explanation_records(example, FEATURES, ["id"], "y", top=2).collect()
    best = max(shares.collect(), key=lambda r: r["prediction"])
    order = np.argsort(-np.abs(best["phi"]))[:2]
    assert [r["feature"] for r in records] == [FEATURES[i] for i in order]
    assert [r["rank"] for r in records] == [1, 2]
    assert all(r["direction"] == ("increases" if r["shap_value"] > 0 else "decreases") for r in records)
    assert records[0]["difference_from_base"] == pytest.approx(best["prediction"] - best["base"])
    with pytest.raises(attr.NotExplainable, match="means"):
        attr.attribute(points, forecaster)
    with pytest.raises(attr.NotExplainable, match="persistence"):
        attr.attribute(points, Forecaster(PERSISTENCE, ("a",), MEDIANS))


def test_neutral_direction(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0], [1.0, 2.0])], "id int, phi array<double>, x array<double>")
    got = attr.top_contributions(df, ["q", "p"], ["id"], top=1).first()
    assert (got["feature"], got["direction"], got["feature_value"]) == ("p", "neutral", 2.0)


def test_least_squares_with_redundant_features(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 2))
    pdf = pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 0] * 2, "d": 1.0})
    pdf["y"] = 3 * pdf["a"] - pdf["b"] + 4 + rng.normal(size=200)
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame(pdf)
    train = training_vectors(df, names, dict.fromkeys(names, 0.0), "y")
    got = [r["prediction"] for r in fit_linear(train).transform(train).collect()]
    design = np.c_[pdf[names].to_numpy(), np.ones(200)]
    want = design @ np.linalg.lstsq(design, pdf["y"], rcond=None)[0]
    np.testing.assert_allclose(got, want, atol=1e-6)


def test_best_prefix():
    assert best_prefix([5, 4, 3, 4, 4, 2], patience=2) == 3
    assert best_prefix([5, 4, 3, 4, 4, 2], patience=20) == 6
    assert best_prefix([1.0]) == 1


def test_boosting_stops_at_the_best_round(spark, points):
    train = vectors(points.filter("id < 200"))
    noise = vectors(points.filter("id >= 200").withColumn("y", F.col("y") + 8 * F.sin(F.col("id") * 7.0)))
    model, rounds = fit_boosted(train, noise, patience=3, maxIter=25, maxDepth=5, stepSize=0.8)
    assert rounds == model.getNumTrees < 25


def test_bundle_round_trip(spark, points, tmp_path):
    forecaster = Forecaster(FOREST, FEATURES, MEDIANS, fit_forest(vectors(points), numTrees=3, maxDepth=4))
    path = str(tmp_path / "bundle")
    bundle.save_bundle(spark, forecaster, path, {"selected_model": FOREST})
    loaded = bundle.load_bundle(spark, path)
    assert (loaded.name, loaded.features, dict(loaded.medians)) == (FOREST, FEATURES, MEDIANS)
    assert bundle.load_metadata(spark, path)["selected_model"] == FOREST
    def score(f):
        return [r["prediction"] for r in f.predict(points).orderBy("id").collect()]
    assert score(loaded) == score(forecaster)
    bare = bundle.load_bare_model(spark, path + "/model", {"features": list(FEATURES)})
    assert bare.name == "RandomForestRegressionModel" and score(bare) == score(forecaster)
    nothing = Forecaster(PERSISTENCE, ("a",), MEDIANS, None, "a")
    bundle.save_bundle(spark, nothing, path + "2")
    assert bundle.load_bundle(spark, path + "2") == nothing


def test_broken_bundles_are_refused(spark, tmp_path):
    from gapwise.sources.sinks import write_document
    with pytest.raises(FileNotFoundError):
        bundle.load_bundle(spark, str(tmp_path / "none"))
    write_document(spark, {"model_name": "x"}, str(tmp_path / "b/metadata"))
    with pytest.raises(ValueError, match="feature_columns, medians"):
        bundle.load_bundle(spark, str(tmp_path / "b"))
    write_document(spark, {"model_name": "x", "feature_columns": ["a"], "medians": {}},
                   str(tmp_path / "c/metadata"))
    with pytest.raises(FileNotFoundError, match="not there"):
        bundle.load_bundle(spark, str(tmp_path / "c"))
    for bad, error in (("a", TypeError), ([], ValueError), ({"x": 1}, TypeError)):
        with pytest.raises(error):
            bundle.feature_list(bad)


def test_model_input_is_checked(spark, points):
    with pytest.raises(ValueError, match="b, c"):
        Forecaster("x", FEATURES, MEDIANS).predict(points.select("a"))
    texts = spark.createDataFrame([("1.5",), ("junk",), (None,)], "a string")
    out = Forecaster(PERSISTENCE, ("a",), {"a": 9.0}, None, "a").predict(texts)
    assert [r["prediction"] for r in out.collect()] == [1.5, 9.0, 9.0]


# Scoring

def test_newest_features_equal_whole_table(spark):
    pdf = random_panel(9, hours=200)
    clean = expected_features(pdf)[["station_id", "datetime", "pm2_5", "pm10"]]
    df = to_spark(spark, clean)
    got = to_pandas(newest_features(df, SPEC))
    whole = to_pandas(feature_table(df, SPEC).drop(SPEC.target, SPEC.target_valid))
    want = whole.groupby("station_id").tail(1).reset_index(drop=True)
    pd.testing.assert_frame_equal(got[want.columns], want, check_dtype=False)


def test_scores(spark):
    t = dt.datetime(2020, 1, 1)
    rows = [(s, t + dt.timedelta(hours=h), v(h), 1.0) for s, n, v in (
        ("a", 30, lambda h: -1.0), ("b", 29, lambda h: 1.0), ("c", 31, lambda h: None)) for h in range(n)]
    from panels import SCHEMA
    df = spark.createDataFrame(rows + [(None, t, 1.0, 1.0)], SCHEMA).withColumn(
        "city", F.when(F.col("station_id") == "a", "X"))
    model = Forecaster(PERSISTENCE, ("pm2_5",), {"pm2_5": 7.0})
    got = {r["station"]: r for r in score_latest(df, model, SPEC, trained_on=["c"]).collect()}
    assert set(got) == {"a", "c"}
    a, c = got["a"], got["c"]
    assert (a["current_pm25"], a["predicted_pm25"], a["city"], a["in_training"]) == (-1.0, 0.0, "X", False)
    assert (c["current_pm25"], c["predicted_pm25"], c["city"], c["in_training"]) == (None, 7.0, "Unknown", True)
    assert a["prediction_timestamp"] - a["current_timestamp"] == dt.timedelta(hours=6)
    assert score_station(df, model, SPEC, "a").count() == 1
    with pytest.raises(ValueError, match="fewer than 30"):
        score_station(df, model, SPEC, "b")
    with pytest.raises(ValueError, match="no rows"):
        score_station(df, model, SPEC, "zzz")


# The whole course

def test_training_course(spark):
    """On a panel with a daily rhythm a fitted model beats persistence, and the
    held-out rows are scored, evaluated and explained."""
    rng = np.random.default_rng(3)
    parts = []
    for s in ("a", "b"):
        times = pd.date_range("2019-01-01", periods=900, freq="h")
        base = 100 + 60 * np.sin(2 * np.pi * np.arange(900) / 24)
        parts.append(pd.DataFrame({"station_id": s, "datetime": times,
                                   "pm2_5": base + rng.normal(size=900) * 5,
                                   "pm10": rng.random(900)}))
    features = feature_table(to_spark(spark, pd.concat(parts)), SPEC).cache()
    chosen = spark.createDataFrame([("a",), ("b",)], "station_id string")
    dates = ("2019-01-20", "2019-01-30")
    done = training.train(features, chosen, SPEC, *dates, (PERSISTENCE, LINEAR, FOREST, BOOSTED),
                          {"numTrees": 5, "maxDepth": 4}, {"maxIter": 5, "maxDepth": 3})
    assert done.selected != PERSISTENCE and done.test["mae"] < 20
    assert sum(done.row_counts.values()) == 2 * (900 - 6)
    valid = {c["model"]: c["mae"] for c in done.comparison if c["split"] == "valid"}
    assert list(valid) == [PERSISTENCE, LINEAR, FOREST, BOOSTED]
    assert min(valid, key=valid.get) == done.selected
    meta = done.metadata(SPEC, ["a", "b"], *dates)
    assert meta["n_features"] == 2 + 9 + 2 * 9 and meta["best_rounds"] <= 5

    held_out = training.test_rows(features, chosen, SPEC, *dates)
    assert held_out.count() == done.row_counts["test"]
    reports = training.evaluate(held_out, done.best, SPEC)
    assert reports["overall"].first()["mae"] == pytest.approx(done.test["mae"])
    assert reports["by_station"].count() == 2
    assert sum(r["n_rows"] for r in reports["error_histogram"].collect()) == done.row_counts["test"]

    told = training.explain(held_out, done.forecasters[FOREST], SPEC, sample_rows=50)
    assert told["attributions"].count() == 50
    assert told["importance"].count() == meta["n_features"]
    assert told["example"].count() == 5


def test_fits_have_tasks_by_rows(spark, monkeypatch):
    features = feature_table(to_spark(spark, random_panel(5, stations=("a",), hours=400)), SPEC)
    chosen = spark.createDataFrame([("a",)], "station_id string")
    tasks, real = [], training.fit_linear

    def fit(train):
        tasks.append(train.rdd.getNumPartitions())
        return real(train)

    monkeypatch.setattr(training, "fit_linear", fit)
    for rows in (10_000, 100):
        monkeypatch.setattr(training, "ROWS_PER_TASK", rows, raising=False)
        done = training.train(features.repartition(8), chosen, SPEC, "2020-01-08", "2020-01-12",
                              (PERSISTENCE, LINEAR))
        assert tasks.pop() == min(8, -(-sum(done.row_counts.values()) // rows))


def test_medians_ignore_later_rows(spark):
    pdf = random_panel(4, stations=("a",), hours=300)
    cut = "2020-01-08"
    changed = pdf.copy()
    changed.loc[changed["datetime"] >= cut, "pm2_5"] = 5000.0
    from gapwise.operators.impute import fit_medians
    from gapwise.operators.split import with_split
    def medians(p):
        rows = with_split(to_spark(spark, p), SPEC, cut, "2020-01-10")
        return fit_medians(rows.filter("split = 'train'"), ["pm2_5"])
    assert medians(pdf) == medians(changed)
