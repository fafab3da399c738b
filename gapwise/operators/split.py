"""Modelling rows, the calendar split and repeatable samples."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from gapwise.operators.coverage import usable
from gapwise.operators.joins import keep_selected
from gapwise.spec import FILLED_SUFFIX, SEED, TRAIN_END, VALID_END, PanelSpec

SPLITS = ("train", "valid", "test")


def usable_rows(features: DataFrame, spec: PanelSpec) -> DataFrame:
    return features.filter(usable(features, spec))


def modeling_set(features: DataFrame, selected: DataFrame, spec: PanelSpec) -> DataFrame:
    """Usable rows of the selected entities."""
    return keep_selected(usable_rows(features, spec), selected, spec.entity)


def with_split(df: DataFrame, spec: PanelSpec, train_end: str = TRAIN_END,
               valid_end: str = VALID_END) -> DataFrame:
    """Label rows by the same calendar bounds for every entity: train before
    ``train_end``, valid before ``valid_end``, test from then on."""
    time = F.col(spec.time)
    return df.withColumn(
        "split",
        F.when(time < F.lit(train_end).cast("timestamp_ntz"), "train")
        .when(time < F.lit(valid_end).cast("timestamp_ntz"), "valid")
        .when(time.isNotNull(), "test"))


def split_summary(df: DataFrame, spec: PanelSpec) -> DataFrame:
    return df.groupBy("split").agg(
        F.count("*").alias("n_rows"), F.min(spec.time).alias("min_time"),
        F.max(spec.time).alias("max_time"),
        F.count_distinct(spec.entity).alias("n_stations"))


def require_all_splits(df: DataFrame) -> dict[str, int]:
    """Row counts per split; raises if one of them is empty."""
    found = {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}
    empty = [s for s in SPLITS if not found.get(s)]
    if empty:
        raise ValueError(f"empty split: {', '.join(empty)}; check the split dates")
    return {s: found[s] for s in SPLITS}


def feature_columns(columns, spec: PanelSpec) -> list[str]:
    """Everything that is not a key, label, description or fill mark."""
    apart = {*spec.keys, spec.target, spec.target_valid, "split", *spec.non_features}
    return [c for c in columns if c not in apart and not c.endswith(FILLED_SUFFIX)]


def seeded_sample(df: DataFrame, keys, rows: int, seed: int = SEED) -> DataFrame:
    """Exactly ``rows`` rows (or all, if there are fewer) in the order of the MD5 of seed and
    keys as text, so neither partitioning nor retries change the choice.

    A cutoff on the hash, derived from a count, lets only about ``rows`` rows through
    to the final sort; it is dropped if it let too few pass.
    """
    mark = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    marked = df.withColumn("__mark", mark)
    total = df.count()
    if total > 4 * rows:
        share = (rows + 8 * math.sqrt(rows) + 16) / total
        below = f"{min(int(share * 16 ** 8), 16 ** 8 - 1):08x}"
        few = marked.filter(F.substring("__mark", 1, 8) <= F.lit(below))
        if few.count() >= rows:
            marked = few
    return marked.orderBy("__mark", *keys).limit(rows).drop("__mark")
