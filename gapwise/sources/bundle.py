"""A trained forecaster on disk: the Spark model beside a metadata document."""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import SparkSession

from gapwise.operators.models import Forecaster
from gapwise.sources.sinks import read_document, write_document
from gapwise.sources.tables import path_exists

_REQUIRED = ("model_name", "feature_columns", "medians")


def save_bundle(spark: SparkSession, forecaster: Forecaster, path: str,
                metadata: dict | None = None) -> None:
    document = dict(metadata or {})
    document.update(
        model_name=forecaster.name, feature_columns=list(forecaster.features),
        medians=dict(forecaster.medians), current=forecaster.current,
        fitted=forecaster.model is not None)
    if forecaster.model is not None:
        forecaster.model.write().overwrite().save(f"{path}/model")
    write_document(spark, document, f"{path}/metadata")


def load_metadata(spark: SparkSession, path: str) -> dict:
    if not path_exists(spark, f"{path}/metadata"):
        raise FileNotFoundError(f"no trained model at {path}; train one first")
    document = read_document(spark, f"{path}/metadata")
    missing = [k for k in _REQUIRED if k not in document]
    if missing:
        raise ValueError(f"model metadata at {path} lacks: {', '.join(missing)}")
    return document


def load_bundle(spark: SparkSession, path: str) -> Forecaster:
    """The saved forecaster; refuses a bundle without model, features or medians."""
    document = load_metadata(spark, path)
    model = None
    if document.get("fitted", True):
        if not path_exists(spark, f"{path}/model"):
            raise FileNotFoundError(f"metadata at {path} names a model that is not there")
        model = load_estimator(spark, f"{path}/model")
    return Forecaster(document["model_name"], tuple(feature_list(document)),
                      document["medians"], model, document.get("current", "pm2_5"))


def load_bare_model(spark: SparkSession, path: str, features) -> Forecaster:
    """A model saved on its own: no imputation, named after its class."""
    model = load_estimator(spark, path)
    return Forecaster(type(model).__name__, tuple(feature_list(features)), {}, model)


def load_estimator(spark: SparkSession, path: str) -> Model:
    """Any saved Spark model; its metadata names the class."""
    return DefaultParamsReader.loadParamsInstance(path, spark)


def feature_list(found) -> list[str]:
    """Feature names from a list, or from a document that holds one."""
    if isinstance(found, dict):
        found = found.get("feature_columns", found.get("features"))
    if not isinstance(found, (list, tuple)):
        raise TypeError("feature columns must be a list of names")
    if not found:
        raise ValueError("no feature columns")
    return list(found)
