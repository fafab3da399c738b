"""Ordered operators over the series of each entity.

Fill limits, lags and rolling windows count rows; only the target checks clock
time. Rows need a unique (entity, time). Rows with a null entity belong to no
series: take them out first with ``split_null_entities``.

The functions with a ``by`` argument add window columns and are meant to be
combined inside ``plans.chunks.over_series``, so that all of them share a single
shuffle and sort; ``by`` defaults to the entity.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from gapwise.functions.coerce import epoch_micros
from gapwise.spec import FILLED_SUFFIX, MIN_HISTORY_ROWS, TREND_ROWS, PanelSpec


def split_null_entities(df: DataFrame, spec: PanelSpec) -> tuple[DataFrame, DataFrame]:
    """Rows of real entities, and the rejected rows with a null entity."""
    known = F.col(spec.entity).isNotNull()
    return df.filter(known), df.filter(~known)


def is_entity(df: DataFrame, spec: PanelSpec, entity) -> Column:
    """Rows of one entity, given in any type: the value takes the column's type, so that the
    filter reaches the scan. A value that type cannot hold matches nothing."""
    kind = df.schema[spec.entity].dataType
    return F.col(spec.entity) == F.lit(str(entity)).try_cast(kind)


def _series(spec: PanelSpec, by):
    return Window.partitionBy(*(by or [spec.entity])).orderBy(spec.time)


def forward_fill(df: DataFrame, spec: PanelSpec, columns=None, limit: int | None = None,
                 whole_gap_only: bool = False, by=None) -> DataFrame:
    """Carry the last value into at most ``limit`` rows after it and mark them.

    The first ``limit`` rows of every gap are filled. With ``whole_gap_only`` a gap
    longer than ``limit`` rows stays empty altogether. Frames reach ``limit`` rows
    back, and as many ahead with ``whole_gap_only``.
    """
    limit = spec.fill_limit if limit is None else limit
    w = _series(spec, by)
    present = spec.present(df.columns, columns or spec.values)
    known = {"__known_" + c: F.last(c, ignorenulls=True).over(w.rowsBetween(-limit, 0))
             for c in present}
    if whole_gap_only:
        known |= {"__fits_" + c: _gap_fits(c, w, limit) for c in present}
    ready = df.withColumns(known)
    out = {}
    for c in present:
        filled = F.col("__known_" + c)
        if whole_gap_only:
            filled = F.when(F.col(c).isNotNull() | F.col("__fits_" + c), filled)
        out[c] = filled
        out[c + FILLED_SUFFIX] = F.col(c).isNull() & filled.isNotNull()
    return ready.withColumns(out).drop(*known)


def _gap_fits(column: str, w, limit: int) -> Column:
    """True in a gap of at most ``limit`` rows: some frame of ``limit`` + 1 rows
    reaches from the value before the gap to the value (or series end) after it."""
    def ends_within(behind: int) -> Column:
        ahead = limit - behind + 1
        seen = F.count(column).over(w.rowsBetween(-behind, -1)) > 0
        value_after = F.count(column).over(w.rowsBetween(1, ahead)) > 0
        series_end = F.count(F.lit(1)).over(w.rowsBetween(1, ahead)) < ahead
        return seen & (value_after | series_end)

    fits = ends_within(1)
    for behind in range(2, limit + 1):
        fits = fits | ends_within(behind)
    return fits


def add_lags(df: DataFrame, spec: PanelSpec, columns=None, lags=None, by=None) -> DataFrame:
    """The value ``k`` rows earlier in the series, for every column and lag."""
    w = _series(spec, by)
    return df.withColumns({
        f"{c}_lag_{k}h": F.lag(c, k).over(w)
        for c in spec.present(df.columns, columns or spec.lagged)
        for k in (lags or spec.lags)
    })


def add_rolling_means(df: DataFrame, spec: PanelSpec, columns=None, windows=None,
                      by=None) -> DataFrame:
    """Mean of the ``n`` rows before the current one, null unless at least half of
    them (and at least one) have a value.

    Sum and count of a short block of rows are computed once per row; a window is a
    chain of earlier blocks. That costs a few look-ups per row, where a sliding frame
    would add up all ``n`` rows again.
    """
    w = _series(spec, by)
    windows = sorted(windows or spec.windows)
    present = spec.present(df.columns, columns or spec.lagged)
    block = math.gcd(*windows)
    frame = w.rowsBetween(-block, -1)
    parts = {}
    for c in present:
        parts[f"__sum_{c}"] = F.coalesce(F.sum(c).over(frame), F.lit(0.0))
        parts[f"__n_{c}"] = F.count(c).over(frame).cast("int")
    earlier = {f"{p}_{back}": F.lag(p, back, 0.0 if p.startswith("__sum_") else 0).over(w)
               for p in parts for back in range(block, windows[-1], block)}
    means = {}
    for c in present:
        total, n, reach = F.col(f"__sum_{c}"), F.col(f"__n_{c}"), block
        for size in windows:
            while reach < size:
                total = total + F.col(f"__sum_{c}_{reach}")
                n = n + F.col(f"__n_{c}_{reach}")
                reach += block
            means[f"{c}_roll_mean_{size}h"] = F.when(n >= max(1, size // 2), total / n)
    return df.withColumns(parts).withColumns(earlier).withColumns(means).drop(*parts, *earlier)


def add_target(df: DataFrame, spec: PanelSpec, by=None) -> DataFrame:
    """The value ``horizon`` rows ahead, valid only if that row is exactly
    ``horizon`` steps ahead on the clock.

    The tolerance is that of a relative closeness test: 1e-8 + 1e-5 * horizon steps.
    """
    w = _series(spec, by)
    h, step = spec.horizon, spec.step_seconds * 1_000_000
    ready = df.withColumns({"__then": F.lead(spec.time, h).over(w),
                            "__value": F.lead(spec.target_of, h).over(w)})
    ahead = epoch_micros(ready, "__then") - epoch_micros(ready, spec.time)
    close = F.abs(ahead - F.lit(h * step)) <= F.lit(int((1e-8 + 1e-5 * h) * step))
    valid = F.coalesce(close, F.lit(False))
    return ready.withColumns({
        spec.target_valid: valid, spec.target: F.when(valid, F.col("__value")),
    }).drop("__then", "__value")


def newest_rows(df: DataFrame, spec: PanelSpec, rows: int, rank: str | None = None) -> DataFrame:
    """The last ``rows`` rows of every entity. The rank filter is pushed below the
    shuffle, so a task sends at most ``rows`` rows per entity."""
    newest_first = Window.partitionBy(spec.entity).orderBy(F.col(spec.time).desc())
    name = rank or "__rank"
    out = df.withColumn(name, F.row_number().over(newest_first)).filter(F.col(name) <= rows)
    return out if rank else out.drop(name)


def latest_rows(df: DataFrame, spec: PanelSpec) -> DataFrame:
    return newest_rows(df, spec, 1)


def recent_trend(df: DataFrame, spec: PanelSpec, entity=None, rows: int = TREND_ROWS,
                 columns=None) -> DataFrame:
    """Time and value of the last ``rows`` rows, of one entity or of all."""
    if entity is not None:
        df = df.filter(is_entity(df, spec, entity))
    kept = df.select(*spec.keys, *(columns or [spec.target_of]))
    return newest_rows(kept.filter(F.col(spec.time).isNotNull()), spec, rows)


def short_histories(df: DataFrame, spec: PanelSpec, min_rows: int = MIN_HISTORY_ROWS) -> DataFrame:
    """Entities with too few rows to score, with the reason."""
    counts = df.groupBy(spec.entity).agg(F.count("*").alias("n_rows"))
    return counts.filter(F.col("n_rows") < min_rows).withColumn(
        "reason", F.lit(f"fewer than {min_rows} rows of history"))


def entity_list(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Distinct entities as text, sorted, nulls left out."""
    return (df.filter(F.col(spec.entity).isNotNull())
            .select(F.col(spec.entity).cast("string").alias(spec.entity))
            .distinct().orderBy(spec.entity))
