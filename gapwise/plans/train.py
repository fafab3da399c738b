"""Split, impute, fit, compare, choose, test once; then evaluate and explain."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from gapwise.operators import attribution, metrics
from gapwise.operators.impute import fit_medians
from gapwise.operators.models import (
    BOOSTED, FOREST, LABEL, LINEAR, MODEL_ORDER, PERSISTENCE, PREDICTION, VECTOR, Forecaster,
    fit_boosted, fit_forest, fit_linear, training_vectors)
from gapwise.operators.split import (
    feature_columns, modeling_set, require_all_splits, seeded_sample, with_split)
from gapwise.plans.sizing import written
from gapwise.spec import SEED, TRAIN_END, VALID_END, PanelSpec


# Rows a task of the fits has at least: each task of a tree fit holds and sends histograms of all
# nodes of a pass, however few rows it has.
ROWS_PER_TASK = 10_000


@dataclass
class Training:
    forecasters: dict[str, Forecaster]
    comparison: list[dict]
    selected: str
    test: dict
    row_counts: dict[str, int]
    extra: dict = field(default_factory=dict)

    @property
    def best(self) -> Forecaster:
        return self.forecasters[self.selected]

    def metadata(self, spec: PanelSpec, stations, train_end: str, valid_end: str) -> dict:
        # Fixed document layout: the names of the fields.
        return {
            "target_column": spec.target, "target_horizon_hours": spec.horizon,
            "stations_used": list(stations), "n_stations": len(list(stations)),
            "split_boundaries": {"train_end_date": train_end, "valid_end_date": valid_end},
            "row_counts": self.row_counts, "n_features": len(self.best.features),
            "missing_value_handling": "nulls take the median of the training rows",
            "random_seed": SEED, "model_comparison": self.comparison,
            "selected_model": self.selected, "selection_criterion": "smallest MAE on valid rows",
            "test_metrics_selected_model_only": self.test, **self.extra,
        }


def train(features: DataFrame, selected: DataFrame, spec: PanelSpec,
          train_end: str = TRAIN_END, valid_end: str = VALID_END, models=MODEL_ORDER,
          forest: dict | None = None, boosted: dict | None = None) -> Training:
    """Fit the candidates on the training rows, choose by validation MAE and test the
    winner. Medians come from training rows alone."""
    rows = with_split(modeling_set(features, selected, spec), spec, train_end, valid_end)
    names = feature_columns(rows.columns, spec)
    rows = rows.select(*spec.keys, "split", spec.target, *names)
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    counts = require_all_splits(rows)
    medians = fit_medians(rows.filter(F.col("split") == "train"), names)
    vectors = training_vectors(
        rows, names, medians, spec.target, keep=[*spec.keys, "split", spec.target_of]
    ).coalesce(-(-sum(counts.values()) // ROWS_PER_TASK)).persist(StorageLevel.MEMORY_AND_DISK)
    part = {s: vectors.filter(F.col("split") == s) for s in counts}

    fitted, extra = {}, {}
    for name in models:
        if name == PERSISTENCE:
            model = None
        elif name == LINEAR:
            model = fit_linear(part["train"])
        elif name == FOREST:
            model = fit_forest(part["train"], **(forest or {}))
        elif name == BOOSTED:
            model, extra["best_rounds"] = fit_boosted(part["train"], part["valid"], **(boosted or {}))
        else:
            raise ValueError(f"unknown model {name}")
        fitted[name] = Forecaster(name, tuple(names), medians, model, spec.target_of)

    compared = None
    for position, name in enumerate(models):
        scores = metrics.regression_metrics(
            _scored(fitted[name], vectors.filter(F.col("split") != "test")),
            LABEL, PREDICTION, ["split"],
        ).select(F.lit(name).alias("model"), F.lit(position).alias("position"), "*")
        compared = scores if compared is None else compared.unionByName(scores)
    comparison = [r.asDict() for r in compared.orderBy("position", "split").collect()]
    spark = features.sparkSession
    chosen = metrics.select_model(
        spark.createDataFrame(comparison, compared.schema)).first()["selected_model"]
    test = metrics.regression_metrics(
        _scored(fitted[chosen], part["test"]), LABEL, PREDICTION).first().asDict()
    center = part["train"].select(Summarizer.mean(F.col(VECTOR))).first()[0]
    extra["training_means"] = dict(zip(names, map(float, center)))
    vectors.unpersist()
    rows.unpersist()
    return Training(fitted, comparison, chosen, test, counts, extra)


def _scored(forecaster: Forecaster, vectors: DataFrame) -> DataFrame:
    """Predictions for rows that are imputed and assembled already."""
    if forecaster.model is None:
        at = forecaster.features.index(forecaster.current)
        return vectors.withColumn(PREDICTION, vector_to_array(VECTOR)[at])
    return forecaster.model.transform(vectors)


def test_rows(features: DataFrame, selected: DataFrame, spec: PanelSpec,
              train_end: str = TRAIN_END, valid_end: str = VALID_END) -> DataFrame:
    """The held-out rows, rebuilt as in training."""
    rows = with_split(modeling_set(features, selected, spec), spec, train_end, valid_end)
    return rows.filter(F.col("split") == "test")


def batch_score(rows: DataFrame, forecaster: Forecaster, spec: PanelSpec) -> DataFrame:
    """Predictions and residuals beside keys and target."""
    scored = metrics.add_residual(forecaster.predict(rows), spec.target, PREDICTION)
    return scored.select(*spec.keys, spec.target, PREDICTION, "residual")


def evaluate(rows: DataFrame, forecaster: Forecaster, spec: PanelSpec,
             names: DataFrame | None = None) -> dict[str, DataFrame]:
    """All test reports of a trained forecaster; nothing is fitted. The scores are written, so
    that the reports share them and nothing stays in memory."""
    scored = written(batch_score(rows, forecaster, spec), "scores")
    pair = (spec.target, PREDICTION)
    return {
        "overall": metrics.regression_metrics(scored, *pair),
        "by_station": metrics.metrics_by_entity(scored, *pair, spec.entity, names),
        "by_stratum": metrics.metrics_by_stratum(scored, *pair),
        "error_histogram": metrics.histogram(scored, "residual"),
    }


def explain(rows: DataFrame, forecaster: Forecaster, spec: PanelSpec, means=None,
            sample_rows: int | None = None) -> dict[str, DataFrame]:
    """Attribution of all rows, or of a seeded sample of ``sample_rows``: importance of all
    features, and the example with the largest prediction in detail. ``attributions`` is a
    written table."""
    if sample_rows is not None:
        tasks = rows.sparkSession.sparkContext.defaultParallelism
        rows = seeded_sample(rows, spec.keys, sample_rows).repartition(tasks, *spec.keys)
    shares = attribution.attribute(rows, forecaster, means, [*spec.keys, spec.target])
    shares = written(shares.select(*spec.keys, spec.target, PREDICTION, "base", "phi", "x"), "shares")
    example = attribution.highest_prediction(shares, spec.keys)
    return {
        "attributions": shares,
        "importance": attribution.global_importance(shares, forecaster.features),
        "example": attribution.explanation_records(
            example, forecaster.features, spec.keys, spec.target),
    }
