"""Windows over long series without one task per entity.

``Window.partitionBy(entity)`` puts the whole series of an entity into one task.
All frames of this library reach a fixed number of rows back and ahead, so a long
series can be cut into chunks if each chunk also receives copies of the rows just
before and after it. ``over_series`` does that, exactly and only where needed:

1. Rows are counted per entity and time slot, a two-column scan with map-side aggregation
   whose small result is written and serves all that follows. If no entity has more than
   ``chunk_rows`` rows, windows run per entity: one shuffle, nothing copied.
2. Otherwise running counts over the slots of the long entities give every slot its row
   positions, hence its chunk and the chunks that need copies of it. The rows of other
   entities get the constant chunk 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from gapwise.functions.coerce import epoch_micros
from gapwise.plans.sizing import BROADCAST_ROWS, broadcast_if_small, written
from gapwise.spec import PanelSpec

CHUNK_ROWS = 50_000
SLOT_STEPS = 24
STRETCH_SLOTS = 4096

_SLOT, _STRETCH, _CHUNK, _OWN, _PLACES = (
    "__slot", "__stretch", "__chunk", "__own", "__places")

SeriesFn = Callable[[DataFrame, list[str]], DataFrame]


def over_series(df: DataFrame, spec: PanelSpec, fn: SeriesFn, history: int,
                lookahead: int = 0, chunk_rows: int = CHUNK_ROWS,
                bound: DataFrame | None = None) -> DataFrame:
    """Apply ``fn(df, by)``, whose windows partition by the columns ``by`` and
    order by ``spec.time``, with frames of at most ``history`` rows back and
    ``lookahead`` rows ahead.

    Runs the count per entity and slot when called, which evaluates ``df`` once.
    ``bound`` may name a cheaper table that has at least as many rows per entity, such as
    the raw table behind ``df``; ``df`` is counted only if that one holds a long entity.
    """
    places = None
    if bound is None or _longest(bound, spec) > chunk_rows:
        places = _chunk_places(df, spec, history, lookahead, chunk_rows)
    if places is None:
        return fn(df, [spec.entity])
    slot, table = places
    home = F.struct(F.lit(0).cast("long").alias("chunk"), F.lit(True).alias("own"))
    placed = (
        df.withColumn(_SLOT, slot)
        .join(table, [spec.entity, _SLOT], "left")
        .withColumn(_PLACES, F.explode(F.coalesce(_PLACES, F.array(home))))
        .withColumns({_CHUNK: F.col(f"{_PLACES}.chunk"), _OWN: F.col(f"{_PLACES}.own")})
        .drop(_PLACES, _SLOT)
    )
    done = fn(placed, [spec.entity, _CHUNK]).filter(_OWN).drop(_CHUNK, _OWN)
    new = [c for c in done.columns if c not in df.columns]
    return done.select(*[c for c in df.columns if c in done.columns], *new)


def _chunk_places(df: DataFrame, spec: PanelSpec, history: int, lookahead: int,
                  chunk_rows: int) -> tuple[Column, DataFrame] | None:
    """The slot expression and a table (entity, slot, places) for the entities with
    more than ``chunk_rows`` rows, or None if there are none."""
    if chunk_rows <= history + lookahead:
        raise ValueError("chunk_rows must exceed the rows a frame can reach")
    long_entities = None
    for micros in _slot_widths(spec.step_seconds):
        slot = F.floor(epoch_micros(df, spec.time) / F.lit(micros)).cast("long")
        known = df.filter(F.col(spec.entity).isNotNull())
        counts = known.groupBy(spec.entity, slot.alias(_SLOT)).agg(F.count("*").alias("n"))
        if long_entities is not None:
            counts = counts.join(long_entities, spec.entity, "left_semi")
        counts = written(counts, "slots")
        if long_entities is None:
            sizes = counts.groupBy(spec.entity).agg(F.sum("n").alias("n"))
            long_entities = sizes.filter(F.col("n") > chunk_rows).select(spec.entity)
            if long_entities.isEmpty():
                return None
            long_entities = broadcast_if_small(written(long_entities, "long-series"))
            counts = counts.join(long_entities, spec.entity, "left_semi")
        counts = counts.filter(F.col(_SLOT).isNotNull())
        found = counts.agg(F.count("*").alias("slots"), F.max("n").alias("fullest")).first()
        if (found["fullest"] or 0) <= max(1, chunk_rows // 4):
            break
    table = _place_slots(counts, spec, history, lookahead, chunk_rows)
    if found["slots"] <= BROADCAST_ROWS:
        table = F.broadcast(table)
    return slot, table


def _sizes(df: DataFrame, spec: PanelSpec) -> DataFrame:
    known = df.filter(F.col(spec.entity).isNotNull())
    return known.groupBy(spec.entity).agg(F.count("*").alias("n"))


def _longest(df: DataFrame, spec: PanelSpec) -> int:
    return _sizes(df, spec).agg(F.max("n")).first()[0] or 0


def _slot_widths(step_seconds: int) -> list[int]:
    """Slot widths in microseconds, from a day of steps down to one microsecond;
    narrower slots are tried while a slot alone could overfill a chunk."""
    step = step_seconds * 1_000_000
    return sorted({SLOT_STEPS * step, step, 1_000_000, 1_000, 1}, reverse=True)


def _before(column: str, window) -> Column:
    """Running sum of the rows before the current one."""
    frame = window.rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(frame), F.lit(0).cast("long"))


def _place_slots(counts: DataFrame, spec: PanelSpec, history: int, lookahead: int,
                 chunk_rows: int) -> DataFrame:
    """Which chunks each slot belongs to, from row positions alone.

    A slot covers the positions [start, start + n) of its series and its home is
    chunk ``start // chunk_rows``. The rows at home in chunk k begin at or after
    ``k * chunk_rows`` and end before ``(k + 1) * chunk_rows + fullest``, so a slot
    is copied to every chunk whose bounds, widened by the reach of the frames,
    touch it. A copy too many only lengthens the margin.

    Positions are running counts in two levels, over stretches of ``STRETCH_SLOTS``
    slots and over the slots of a stretch, so that no task sees all slots of an entity.
    """
    counts = counts.withColumn(_STRETCH, F.floor(F.col(_SLOT) / F.lit(STRETCH_SLOTS)))
    series = Window.partitionBy(spec.entity)
    stretches = (
        counts.groupBy(spec.entity, _STRETCH)
        .agg(F.sum("n").alias("rows"), F.max("n").alias("most"))
        .select(spec.entity, _STRETCH, F.max("most").over(series).alias("fullest"),
                _before("rows", series.orderBy(_STRETCH)).alias("base")))
    inside = Window.partitionBy(spec.entity, _STRETCH).orderBy(_SLOT)
    start, end = F.col("start"), F.col("start") + F.col("n")
    size = F.lit(chunk_rows).cast("long")
    home = F.floor(start / size)
    first = F.greatest(
        F.floor((start - F.col("fullest") - F.lit(lookahead)) / size), F.lit(0).cast("long"))
    last = F.floor((end + F.lit(history) - 1) / size)
    return (
        counts.withColumn("inside", _before("n", inside))
        .join(stretches, [spec.entity, _STRETCH])
        .withColumn("start", F.col("base") + F.col("inside"))
        .withColumns({"home": home, "first": first, "last": last})
        .select(
            spec.entity, _SLOT,
            F.transform(
                F.sequence("first", F.greatest("last", "home")),
                lambda k: F.struct(k.alias("chunk"), (k == F.col("home")).alias("own")),
            ).alias(_PLACES),
        )
    )
