"""Time-of-day and calendar features."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

TIME_FEATURES = ("hour", "day_of_week", "day_of_year", "month", "is_weekend")
CYCLIC_FEATURES = ("hour_sin", "hour_cos", "month_sin", "month_cos")


def add_time_features(df: DataFrame, time: str = "datetime") -> DataFrame:
    """Hour, weekday (Monday is 0), day of year, month and weekend mark."""
    day = F.weekday(time)
    return df.withColumns({
        "hour": F.hour(time),
        "day_of_week": day,
        "day_of_year": F.dayofyear(time),
        "month": F.month(time),
        "is_weekend": (day >= 5).cast("int"),
    })


def add_cyclic_features(df: DataFrame, time: str = "datetime") -> DataFrame:
    """Hour and month as points on a circle."""
    def turn(part, period):
        return part * F.lit(2 * math.pi) / F.lit(float(period))

    hour, month = turn(F.hour(time), 24), turn(F.month(time), 12)
    return df.withColumns({
        "hour_sin": F.sin(hour), "hour_cos": F.cos(hour),
        "month_sin": F.sin(month), "month_cos": F.cos(month),
    })
