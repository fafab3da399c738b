"""Leaves of a fitted tree ensemble as arrays, built by tasks from its saved node table.

The ensemble is saved to the shared folder; every tree is turned into its leaves by one
task, and the leaves are written in files of bounded size, which tasks read one at a time.
The driver only sees the sum of the trees' base values and the names of the files.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.ml import Model
from pyspark.sql import DataFrame, SparkSession, functions as F

from gapwise.session import shared_dir

_LEAVES = ("tree int, base double, n_leaves long, depth long, feature binary, low binary, "
           "high binary, share binary, value binary")
_ARRAYS = ("feature", "low", "high", "share", "value")


def node_table(model: Model) -> DataFrame:
    """One row per node of the ensemble."""
    spark = SparkSession.getActiveSession()
    path = f"{shared_dir(spark)}/trees-{uuid.uuid4().hex}"
    model.write().save(path)
    node = F.col("nodeData")
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), node.id.alias("id"), node.prediction.alias("value"),
        node.rawCount.alias("rows"), node.leftChild.alias("left"),
        node.rightChild.alias("right"), node.split.featureIndex.alias("feature"),
        F.get(node.split.leftCategoriesOrThreshold, F.lit(0)).alias("threshold"))


def leaf_files(model: Model, leaves_per_file: int) -> tuple[float, list[str]]:
    """The base value and the files of the leaves.

    Of every tree: per leaf and path feature the feature's index, the interval that leads to
    the leaf and the share of training rows that pass it; and per leaf its weighted value.
    """
    weights = list(model.treeWeights)
    if type(model).__name__.startswith("RandomForest"):
        weights = [w / sum(weights) for w in weights]
    # The leaves of a tree are half its nodes.
    nodes = node_table(model)
    largest = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] // 2 + 1

    def leaves(tree: pd.DataFrame) -> pd.DataFrame:
        number = int(tree["tree"].iloc[0])
        return _leaf_row(number, tree, weights[number])

    spark = nodes.sparkSession
    path = f"{shared_dir(spark)}/leaves-{uuid.uuid4().hex}"
    nodes.groupBy("tree").applyInPandas(leaves, _LEAVES).write.option(
        "maxRecordsPerFile", max(1, leaves_per_file // largest)).parquet(path)
    found = spark.read.schema(_LEAVES).parquet(path)
    return found.agg(F.sum("base")).first()[0], sorted(found.inputFiles())


def read_leaves(uri: str) -> Iterator[tuple[np.ndarray, ...]]:
    """The trees of one file: feature, low, high and share (leaves x depth), value (leaves)."""
    files, path = pafs.FileSystem.from_uri(uri)
    with files.open_input_file(path) as source:
        for row in pq.read_table(source, columns=["n_leaves", "depth", *_ARRAYS]).to_pylist():
            shape = (row["n_leaves"], row["depth"])
            if not row["n_leaves"]:
                continue
            yield (np.frombuffer(row["feature"], np.int32).reshape(shape),
                   *[np.frombuffer(row[c], float).reshape(shape) for c in ("low", "high", "share")],
                   np.frombuffer(row["value"], float))


def _leaf_row(number: int, nodes: pd.DataFrame, weight: float) -> pd.DataFrame:
    found = _leaves(nodes, weight)
    if found is None:
        base = weight * float(nodes["value"].iloc[0])
        row = {"base": base, "n_leaves": 0, "depth": 0, **{c: b"" for c in _ARRAYS}}
    else:
        share, value = found[3], found[4]
        row = {"base": float((value * share.prod(axis=1)).sum()), "n_leaves": share.shape[0],
               "depth": share.shape[1], **{c: a.tobytes() for c, a in zip(_ARRAYS, found)}}
    return pd.DataFrame([{"tree": number, **row}])


def _leaves(nodes: pd.DataFrame, weight: float):
    """Walk from the root, narrowing the interval of every feature on the way."""
    table = nodes.set_index("id").to_dict("index")
    if table[0]["left"] < 0:
        return None
    paths, open_nodes = [], [(0, {})]
    while open_nodes:
        at, path = open_nodes.pop()
        node = table[at]
        if node["left"] < 0:
            paths.append((path, node["value"] * weight))
            continue
        f, cut = node["feature"], node["threshold"]
        low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
        for child, bounds in ((node["left"], (low, min(high, cut))),
                              (node["right"], (max(low, cut), high))):
            passing = share * table[child]["rows"] / node["rows"]
            open_nodes.append((child, {**path, f: (*bounds, passing)}))
    depth = max(len(p) for p, _ in paths)
    shape = (len(paths), depth)
    # Slots a short path leaves unused pass every row with share 1: no effect.
    feature = np.zeros(shape, dtype=np.int32)
    low, high = np.full(shape, -np.inf), np.full(shape, np.inf)
    share = np.ones(shape)
    for i, (path, _) in enumerate(paths):
        for j, (f, (lo, hi, s)) in enumerate(path.items()):
            feature[i, j], low[i, j], high[i, j], share[i, j] = f, lo, hi, s
    return feature, low, high, share, np.array([v for _, v in paths])
