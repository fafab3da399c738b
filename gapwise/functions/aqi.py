"""PM2.5 categories and the change a forecast implies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gapwise.spec import AQI_CATEGORIES, AQI_NO_VALUE, AQI_TOP_CATEGORY


def aqi_category(value: Column) -> Column:
    """Category name of a PM2.5 value; null gives ``Unknown``."""
    missing = value.isNull() | F.isnan(value)
    names = F.when(missing, F.lit(AQI_NO_VALUE))
    for upper, name in AQI_CATEGORIES:
        names = names.when(value <= upper, F.lit(name))
    return names.otherwise(F.lit(AQI_TOP_CATEGORY))


def add_forecast_change(df: DataFrame, current: str = "current_pm25",
                        predicted: str = "predicted_pm25") -> DataFrame:
    """Absolute and relative change with its direction. The percentage is null
    where the current value is 0, all three are null where a value is missing."""
    change = F.col(predicted) - F.col(current)
    return df.withColumns({
        "change": change,
        "change_pct": change / F.nullif(F.col(current), F.lit(0.0)) * 100,
        "direction": F.when(change > 0, "increase").when(change < 0, "decrease")
                      .when(change == 0, "unchanged"),
    })
