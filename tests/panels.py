"""Random gappy panels and the pandas way to compute the same things."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import types as T

from gapwise.spec import PanelSpec

SPEC = PanelSpec(values=("pm2_5", "pm10"), lagged=("pm2_5", "pm10"))
SCHEMA = T.StructType([
    T.StructField("station_id", T.StringType()), T.StructField("datetime", T.TimestampNTZType()),
    T.StructField("pm2_5", T.DoubleType()), T.StructField("pm10", T.DoubleType())])


def random_panel(seed: int, stations=("a", "b", "c"), hours: int = 150) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    parts = []
    for s in stations:
        times = pd.date_range("2020-01-01", periods=hours, freq="h")
        times = times[rng.random(hours) > rng.choice([0.0, 0.05, 0.3])]
        part = pd.DataFrame({"station_id": s, "datetime": times})
        for c in SPEC.values:
            values = np.round(rng.gamma(2, 30, len(times)), 2)
            part[c] = np.where(rng.random(len(times)) < rng.choice([0.1, 0.4]), np.nan, values)
        parts.append(part)
    return pd.concat(parts, ignore_index=True)


def to_spark(spark, pdf: pd.DataFrame, schema=SCHEMA):
    rows = [tuple(None if pd.isna(v) else (v.to_pydatetime() if isinstance(v, pd.Timestamp) else v)
                  for v in r) for r in pdf.itertuples(index=False, name=None)]
    return spark.createDataFrame(rows, schema).repartition(5)


def to_pandas(df, keys=("station_id", "datetime")) -> pd.DataFrame:
    return df.toPandas().sort_values(list(keys)).reset_index(drop=True)


def expected_features(pdf: pd.DataFrame, spec: PanelSpec = SPEC) -> pd.DataFrame:
    """Fill, lags, rolling means and target with pandas."""
    out = pdf.sort_values(["station_id", "datetime"]).reset_index(drop=True)
    for c in spec.values:
        filled = out.groupby("station_id")[c].ffill(limit=spec.fill_limit)
        out[c + "_was_filled"] = out[c].isna() & filled.notna()
        out[c] = filled
    series = out.groupby("station_id")
    for c in spec.lagged:
        for k in spec.lags:
            out[f"{c}_lag_{k}h"] = series[c].shift(k)
        for n in spec.windows:
            out[f"{c}_roll_mean_{n}h"] = series[c].transform(
                lambda s, n=n: s.shift(1).rolling(n, min_periods=max(1, n // 2)).mean())
    ahead = series["datetime"].shift(-spec.horizon) - out["datetime"]
    valid = np.isclose(ahead.dt.total_seconds() / 3600, spec.horizon)
    out[spec.target_valid] = valid
    out[spec.target] = series[spec.target_of].shift(-spec.horizon).where(valid)
    return out


def assert_same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert len(got) == len(want)
    for c in want.columns:
        a, b = got[c], want[c]
        if pd.api.types.is_float_dtype(b):
            np.testing.assert_allclose(a.astype(float), b, rtol=0, atol=1e-9, err_msg=c)
        else:
            assert list(a) == list(b), c
