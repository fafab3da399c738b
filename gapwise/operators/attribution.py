"""How much every feature moved a prediction away from the base value.

An attribution table has the columns of its input plus ``base``, ``phi`` (one share
per feature, in feature order) and ``x`` (the imputed feature values); base plus the
sum of phi is the prediction. Shares describe the model, not causes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.sql import DataFrame, functions as F, types as T

from gapwise.operators.models import PREDICTION, Forecaster
from gapwise.operators.trees import leaf_files, read_leaves
from gapwise.spec import TOP_FEATURES

# Leaves a task holds at a time (one larger tree stands alone).
LEAVES_PER_FILE = 100_000
# Cells (rows x leaves x path features) worked on at a time.
CELLS_PER_BLOCK = 2_000_000


class NotExplainable(ValueError):
    """The forecaster has no fitted function to explain."""


def attribute(df: DataFrame, forecaster: Forecaster, means=None, kept=None) -> DataFrame:
    """Attribution by kind of model: exact path-dependent Shapley values for trees,
    the closed form for linear models (which needs the training means). ``kept`` names the
    columns of ``df`` the result carries (default: all)."""
    if forecaster.model is None:
        raise NotExplainable("persistence has no learned function to explain")
    if hasattr(forecaster.model, "trees"):
        return tree_attribution(df, forecaster, kept)
    if hasattr(forecaster.model, "coefficients"):
        if means is None:
            raise NotExplainable("a linear model needs the training means of its features")
        weights = [float(w) for w in forecaster.model.coefficients]
        shares = linear_attribution(
            forecaster.predict(df), forecaster.features, forecaster.inputs(df), weights,
            means, forecaster.model.intercept)
        return shares if kept is None else shares.select(*kept, PREDICTION, "base", "phi", "x")
    raise NotExplainable(f"no explanation for {type(forecaster.model).__name__}")


def linear_attribution(df: DataFrame, features, inputs, weights, means,
                       intercept: float = 0.0) -> DataFrame:
    """Share of a feature: its weight times the distance from its mean."""
    base = intercept + sum(w * means[f] for f, w in zip(features, weights))
    shares = [(x - F.lit(float(means[f]))) * F.lit(float(w))
              for f, x, w in zip(features, inputs, weights)]
    return df.withColumns({"base": F.lit(float(base)), "phi": F.array(*shares),
                           "x": F.array(*inputs)})


def tree_attribution(df: DataFrame, forecaster: Forecaster, kept=None) -> DataFrame:
    """Shapley values of a tree ensemble, with the training counts of the nodes as
    the weights of absent features (arXiv:1802.03888).

    Rows are independent, so this is one narrow pass, in which tasks read the leaves of the
    ensemble from the shared folder, a bounded number at a time.
    """
    base, files = leaf_files(forecaster.model, LEAVES_PER_FILE)
    n = len(forecaster.features)
    scored = forecaster.predict(df).withColumns({
        "base": F.lit(base), "x": F.array(*forecaster.inputs(df))})
    if kept is not None:
        # Only these columns travel through Python.
        scored = scored.select(*kept, PREDICTION, "base", "x")

    def add_shares(batches):
        for rows in batches:
            x = np.array(rows["x"].tolist(), dtype=float).reshape(len(rows), n)
            phi = np.zeros_like(x)
            for file in files:
                for leaves in read_leaves(file):
                    _add_leaf_shares(phi, x, *leaves)
            rows["phi"] = pd.Series(list(phi), index=rows.index)
            yield rows

    schema = T.StructType([*scored.schema.fields, T.StructField("phi", T.ArrayType(T.DoubleType()))])
    return scored.mapInPandas(add_shares, _nullable(schema))


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def _add_leaf_shares(phi, x, feature, low, high, weight, value) -> None:
    """Add the shares of one tree to ``phi``.

    A leaf is a product game: a present feature contributes 1 if the row passes its
    splits on the path and 0 if not, an absent one the share of training rows that
    pass. With both probabilities mixed by t, a feature's Shapley value is the
    integral over t of the product over the other features, times its own difference;
    the integrand is a polynomial, so a Gauss rule gives it exactly.
    """
    leaves, depth = feature.shape
    nodes, steps = np.polynomial.legendre.leggauss(depth // 2 + 1)
    nodes, steps = (nodes + 1) / 2, steps / 2
    order = np.argsort(feature, axis=None, kind="stable")
    owners, starts = np.unique(feature.ravel()[order], return_index=True)
    block = max(1, CELLS_PER_BLOCK // (leaves * depth))
    for at in range(0, len(x), block):
        seen = x[at:at + block][:, feature]
        passes = (((seen > low) | np.isneginf(low)) & (seen <= high)).astype(float)
        total = np.zeros_like(passes)
        for t, step in zip(nodes, steps):
            mixed = passes * t + weight * (1 - t)
            total += step * np.prod(mixed, axis=2, keepdims=True) / mixed
        shares = (total * (passes - weight) * value[:, None]).reshape(len(seen), -1)
        phi[at:at + block, owners] += np.add.reduceat(shares[:, order], starts, axis=1)


def global_importance(attributions: DataFrame, features) -> DataFrame:
    """Mean absolute share of every feature, largest first. One aggregate with a
    column per feature, turned on its side."""
    one_row = attributions.agg(*[
        F.avg(F.abs(F.col("phi")[i])).alias(f"p{i}") for i in range(len(features))])
    entries = [F.struct(F.lit(f).alias("feature"), F.col(f"p{i}").alias("mean_abs_shap"))
               for i, f in enumerate(features)]
    return (one_row.select(F.inline(F.array(*entries)))
            .orderBy(F.desc("mean_abs_shap"), "feature"))


def top_contributions(attributions: DataFrame, features, keys,
                      top: int = TOP_FEATURES) -> DataFrame:
    """The ``top`` features of every row by absolute share, ranked inside the row
    (no shuffle); features of equal share by name."""
    names = F.array(*[F.lit(f) for f in features])
    zipped = F.arrays_zip(names.alias("feature"), F.col("phi").alias("shap_value"),
                          F.col("x").alias("feature_value"))
    sortable = F.transform(zipped, lambda e: F.struct(
        (-F.abs(e["shap_value"])).alias("by_size"), e["feature"].alias("feature"),
        e["shap_value"].alias("shap_value"), e["feature_value"].alias("feature_value")))
    best = F.slice(F.array_sort(sortable), 1, top)
    share = F.col("shap_value")
    direction = F.when(share > 0, "increases").when(share < 0, "decreases").otherwise("neutral")
    return (
        attributions.select(*keys, F.posexplode(best).alias("position", "e"))
        .select(*keys, (F.col("position") + 1).alias("rank"), "e.feature", "e.shap_value",
                "e.feature_value")
        .withColumns({"abs_shap_value": F.abs(share), "direction": direction})
    )


def highest_prediction(attributions: DataFrame, keys) -> DataFrame:
    """The row with the largest prediction, as an example worth explaining."""
    return attributions.orderBy(F.desc(PREDICTION), *keys).limit(1)


def explanation_records(attributions: DataFrame, features, keys, actual: str | None = None,
                        top: int = TOP_FEATURES) -> DataFrame:
    """Top contributions with the prediction, the base value, their difference and,
    if known, the actual value."""
    extra = [PREDICTION, "base", *([actual] if actual else [])]
    return top_contributions(attributions, features, [*keys, *extra], top).withColumn(
        "difference_from_base", F.col(PREDICTION) - F.col("base"))
