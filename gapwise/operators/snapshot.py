"""Long snapshot (one row per place and pollutant) to one row per place."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gapwise.functions.names import require_columns
from gapwise.operators.dedup import rows_in_duplicated_keys
from gapwise.spec import SNAPSHOT_ID_COLUMNS

# Columns of average, in the order by which the first of several rows is chosen.
ORDER = ("pollutant_avg", "pollutant_min", "pollutant_max")
# A snapshot names a few pollutants; more names than this are no pollutants.
MAX_POLLUTANTS = 500
FLAGS = ("lat_lon_flag_invalid", "pollutant_flag_impossible")


def is_long(df: DataFrame) -> bool:
    return {"pollutant_id", "pollutant_avg"} <= set(df.columns)


def pollutant_names(df: DataFrame) -> list[str]:
    """The pollutants of a long snapshot, sorted."""
    found = df.filter(F.col("pollutant_id").isNotNull()).select("pollutant_id").distinct().limit(
        MAX_POLLUTANTS + 1).collect()
    if len(found) > MAX_POLLUTANTS:
        raise ValueError(f"more than {MAX_POLLUTANTS} pollutants: not a long snapshot")
    return sorted(r["pollutant_id"] for r in found)


def snapshot_wide(df: DataFrame, pollutants=None, order=ORDER,
                  id_columns=SNAPSHOT_ID_COLUMNS, drop_null_keys: bool = False) -> DataFrame:
    """A column per pollutant with its average, and the flags joined by OR.

    Of several rows of a (place, pollutant) the first in ``order`` counts, nulls last.
    A table that is wide already passes through. The output has a column per pollutant
    found; ``pollutants`` names them instead, and then any other one raises, so that no
    value is lost. ``drop_null_keys`` leaves out places with a null in an id column and
    places without any value; by default they stay.
    """
    if not is_long(df):
        return df
    require_columns(df, id_columns, "snapshot")
    if drop_null_keys:
        df = df.dropna(subset=list(id_columns))
    order = [c for c in order if c in df.columns]
    found = pollutant_names(df)
    if pollutants is not None and (unlisted := sorted(set(found) - set(pollutants))):
        raise ValueError(f"pollutants that are not listed: {', '.join(unlisted)}")
    flags = [f for f in FLAGS if f in df.columns]
    rank = F.struct(*[p for c in order for p in (F.col(c).isNull(), F.col(c))])
    once = df.groupBy(*id_columns, "pollutant_id").agg(
        *[F.min_by(c, rank).alias(c) for c in ("pollutant_avg", *flags)])
    names = found if pollutants is None else sorted(pollutants)
    wide = once.groupBy(*id_columns).agg(
        *[F.max(F.when(F.col("pollutant_id") == p, F.col("pollutant_avg"))).alias(p)
          for p in names],
        *[F.bool_or(f).alias(f) for f in flags])
    if drop_null_keys:
        wide = wide.dropna(how="all", subset=[f"`{p}`" for p in names])
    return wide


def duplicate_combinations(df: DataFrame, id_columns=SNAPSHOT_ID_COLUMNS) -> DataFrame:
    return rows_in_duplicated_keys(df, [*id_columns, "pollutant_id"])


def single_timestamp(df: DataFrame, column: str = "timestamp") -> DataFrame:
    """Whether all rows share one time (nulls ignored), and the earliest time."""
    return df.agg((F.count_distinct(column) == 1).alias("is_single"),
                  F.min(column).alias("timestamp_value"))
