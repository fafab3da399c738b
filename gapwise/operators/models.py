"""Forecasters: a fitted regressor with the imputation it was trained with."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark import SparkContext
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import (
    GBTRegressionModel, GBTRegressor, LinearRegression, RandomForestRegressor)
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from gapwise.functions.coerce import to_number
from gapwise.functions.names import require_columns
from gapwise.operators.impute import impute
from gapwise.session import shared_dir
from gapwise.spec import SEED

VECTOR, LABEL, PREDICTION = "features", "label", "prediction"

PERSISTENCE = "persistence_baseline"
LINEAR = "linear_regression"
FOREST = "random_forest"
BOOSTED = "boosted_trees"
MODEL_ORDER = (PERSISTENCE, LINEAR, FOREST, BOOSTED)

# Settings of the three learners.
FOREST_SETTINGS = {"numTrees": 200, "maxDepth": 15, "minInstancesPerNode": 5}
BOOSTED_SETTINGS = {"maxIter": 500, "maxDepth": 6, "stepSize": 0.05,
                    "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"}
PATIENCE = 20
# Rounds of the first, shorter fit of boosted trees.
FIRST_ROUNDS = 50
RIDGE = 1e-8


@dataclass(frozen=True)
class Forecaster:
    """``model`` is None for persistence: the prediction is the imputed current value
    of ``current``."""

    name: str
    features: tuple[str, ...]
    medians: Mapping[str, float] = field(default_factory=dict)
    model: Model | None = None
    current: str = "pm2_5"

    def inputs(self, df: DataFrame) -> list[Column]:
        """The features in training order, as numbers, imputed."""
        require_columns(df, self.features, "model input")
        out = []
        for name in self.features:
            value = to_number(name, df.schema[name].dataType)
            if name in self.medians:
                value = F.coalesce(value, F.lit(self.medians[name]))
            out.append(value)
        return out

    def with_vector(self, df: DataFrame) -> DataFrame:
        return df.withColumn(VECTOR, array_to_vector(F.array(*self.inputs(df))))

    def predict(self, df: DataFrame, into: str = PREDICTION) -> DataFrame:
        """Add the prediction; the feature columns stay as they were."""
        if self.model is None:
            value = dict(zip(self.features, self.inputs(df)))[self.current]
            return df.withColumn(into, value)
        scored = self.model.transform(self.with_vector(df)).drop(VECTOR)
        return scored.withColumnRenamed(PREDICTION, into)


def training_vectors(df: DataFrame, features, medians: Mapping[str, float], label: str,
                     keep=()) -> DataFrame:
    """Narrow table to fit on: the kept columns, the label and one feature vector."""
    ready = impute(df, {c: medians[c] for c in features})
    vector = array_to_vector(F.array(*[F.col(c) for c in features]))
    return ready.select(*keep, F.col(label).cast("double").alias(LABEL), vector.alias(VECTOR))


def fit_linear(train: DataFrame) -> Model:
    """Ordinary least squares.

    Collinear features make the normal equations singular; the ridge is just large
    enough to pick the least-norm solution among the equally good ones. Features that
    are constant in training are set to 0 and get the weight 0: scaled by a spread
    that is only rounding error they would spoil the rest.
    """
    ends = train.select(Summarizer.metrics("min", "max").summary(F.col(VECTOR)).alias("s")).first()[0]
    varies = [float(high > low) for low, high in zip(ends["min"], ends["max"])]
    if not all(varies):
        kept = F.zip_with(vector_to_array(VECTOR), F.array(*[F.lit(v) for v in varies]),
                          lambda x, v: x * v)
        train = train.withColumn(VECTOR, array_to_vector(kept))
    return LinearRegression(labelCol=LABEL, regParam=RIDGE, solver="normal").fit(train)


def fit_forest(train: DataFrame, seed: int = SEED, **settings) -> Model:
    """Random forest that considers every feature at every split."""
    return RandomForestRegressor(labelCol=LABEL, featureSubsetStrategy="all", seed=seed,
                                 **(FOREST_SETTINGS | settings)).fit(train)


def best_prefix(errors, patience: int = PATIENCE) -> int:
    """Number of rounds to keep: the best round before the first stretch of
    ``patience`` rounds without improvement."""
    best = 0
    for i, error in enumerate(errors):
        if error < errors[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def fit_boosted(train: DataFrame, valid: DataFrame, seed: int = SEED,
                patience: int = PATIENCE, **settings) -> tuple[Model, int]:
    """Boosted trees cut back to the best number of rounds by validation MAE; returns
    the model and that number.

    Rounds are repeatable for a seed, so a fit of few rounds tells as much as the first
    rounds of a full one: the number of rounds doubles until ``patience`` runs out or
    ``maxIter`` is reached. The model returned is made of the first trees of the last fit. Long
    fits need a checkpoint folder, so that the lineage of the rounds stays short.
    """
    context = train.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(train.sparkSession))
    learner = GBTRegressor(labelCol=LABEL, seed=seed, cacheNodeIds=True,
                           **(BOOSTED_SETTINGS | settings))
    tried, most = 0, learner.getMaxIter()
    while tried < most:
        tried = min(most, 2 * tried or FIRST_ROUNDS)
        full = learner.copy({learner.maxIter: tried}).fit(train)
        errors = full.evaluateEachIteration(valid, "absolute")
        rounds = best_prefix(errors, patience)
        if len(errors) - rounds >= patience:
            break
    if rounds == full.getNumTrees:
        return full, rounds
    return first_rounds(full, rounds), rounds


def first_rounds(model: GBTRegressionModel, rounds: int) -> GBTRegressionModel:
    """The boosted model of the first ``rounds`` trees."""
    context = SparkContext._active_spark_context
    old, jvm = model._java_obj, context._jvm
    trees = context._gateway.new_array(
        jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, rounds)
    weights = context._gateway.new_array(jvm.double, rounds)
    for i, weight in enumerate(model.treeWeights[:rounds]):
        trees[i], weights[i] = old.trees()[i], float(weight)
    made = jvm.org.apache.spark.ml.regression.GBTRegressionModel(
        old.uid(), trees, weights, old.numFeatures())
    return GBTRegressionModel(old.copyValues(made, old.extractParamMap()))
