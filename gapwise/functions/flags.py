"""Quality flags. A flag marks a row; it never removes it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gapwise.spec import LATITUDE_RANGE, LONGITUDE_RANGE


def _any(terms) -> Column:
    """OR over conditions in which an unknown condition counts as false."""
    known = [F.coalesce(t, F.lit(False)) for t in terms]
    return reduce(lambda a, b: a | b, known, F.lit(False))


def add_negative_flag(df: DataFrame, columns, flag: str = "negative_value_flag") -> DataFrame:
    """True where any of the columns is below zero."""
    return df.withColumn(flag, _any(F.col(c) < 0 for c in columns if c in df.columns))


def add_geo_flag(df: DataFrame, latitude: str = "latitude", longitude: str = "longitude",
                 lat_range=LATITUDE_RANGE, lon_range=LONGITUDE_RANGE,
                 flag: str = "lat_lon_flag_invalid") -> DataFrame:
    """True where a coordinate is missing or out of the box."""
    inside = (F.col(latitude).between(*map(F.lit, lat_range))
              & F.col(longitude).between(*map(F.lit, lon_range)))
    return df.withColumn(flag, ~F.coalesce(inside, F.lit(False)))


def add_impossible_flag(df: DataFrame, low: str = "pollutant_min", high: str = "pollutant_max",
                        mean: str = "pollutant_avg",
                        flag: str = "pollutant_flag_impossible") -> DataFrame:
    """True where a value is negative or the three values are out of order."""
    lo, hi, avg = F.col(low), F.col(high), F.col(mean)
    return df.withColumn(
        flag, _any([lo < 0, hi < 0, avg < 0, lo > hi, avg < lo, avg > hi]))
