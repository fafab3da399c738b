"""Column-name cleaning (driver side, no job)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

# Where a camel-case boundary lies and what counts as a separator.
_CAMEL_BOUNDARY = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_SEPARATORS = re.compile(r"[^a-z0-9]+")


def named(column: str) -> Column:
    """The column of exactly this name, which may hold dots."""
    return F.col(f"`{column}`")


def snake_name(name: str, split_camel: bool = True) -> str:
    """``PM2.5`` -> ``pm2_5``; ``StationId`` -> ``station_id``, or ``stationid``
    without the camel split."""
    text = name.strip()
    if split_camel:
        text = _CAMEL_BOUNDARY.sub("_", text)
    return _SEPARATORS.sub("_", text.lower()).strip("_")


def snake_columns(df: DataFrame, split_camel: bool = True) -> DataFrame:
    return df.toDF(*[snake_name(c, split_camel) for c in df.columns])


def require_columns(df: DataFrame, needed, what: str = "table") -> None:
    """Raise one error that lists every missing column."""
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks required columns: {', '.join(missing)}")
