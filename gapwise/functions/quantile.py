"""Exact medians of many columns by radix selection.

A pass counts, for every column, how many values fall into each bucket of the range that
is still open: first by sign, power of two and the next five bits of a double, then by
eleven further bits a pass. The bucket that holds the middle rank is the next range, so six
passes at most settle every column, whatever its values; a bucket whose values are all
equal ends the search at once, and most data need two or three passes. Counts are merged
inside each task before they are shuffled, and a pass brings at most some thousand of them
per column together.

Buckets are told apart by arithmetic that is exact for doubles: values between two powers
of two are multiples of one step, so their distance from the lower end and its quotient by
a power of two have no rounding.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

# Parts of a power of two in the first pass, and of a range in each later one.
FIRST_PARTS, PARTS = 32, 2048
# Powers of two of normal doubles; smaller ones share one range.
_LEAST, _MOST = -1022, 1023
_INFINITE = (_MOST - _LEAST + 2) * FIRST_PARTS


@dataclass
class _Search:
    """The open range of a column: values from ``low`` to ``high``, ``below`` smaller ones,
    buckets of the size of ``width`` / PARTS."""

    ranks: tuple[int, int] = (0, 0)
    below: int = 0
    low: float = 0.0
    high: float = 0.0
    start: float = 0.0
    width: float = 0.0
    other: float | None = None
    median: float | None = None
    open: bool = True

    def take(self, buckets) -> tuple | None:
        """Go on with the bucket of the lower middle rank, if it has more than one value.
        ``buckets``: (number, rows, least, largest value) in order."""
        at = self.below
        for i, (bucket, n, least, most) in enumerate(buckets):
            if at + n > self.ranks[0]:
                break
            at += n
        if self.ranks[1] >= at + n:
            # The upper middle value is the next one there is.
            self.other = buckets[i + 1][2]
        self.below, self.low, self.high = at, least, most
        if least == most or self.other is not None:
            a = most
            b = a if self.other is None else self.other
            mean = a if a == b else a / 2 + b / 2 if abs(a) + abs(b) > 1e300 else (a + b) / 2
            self.median, self.open = (None if mean != mean else mean), False
        return bucket


def _first_bucket(v: Column) -> Column:
    """Sign, power of two and its part, in the order of the values."""
    size = F.abs(v)
    guess = F.floor(F.log2(size))
    power = F.greatest(F.least(guess, F.lit(_MOST)), F.lit(_LEAST)).cast("int")
    # The logarithm may be off by one next to a power of two.
    low = F.pow(F.lit(2.0), power)
    power = F.when(size < low, power - 1).when(
        (power < _MOST) & (size >= low * 2.0), power + 1).otherwise(power)
    low = F.pow(F.lit(2.0), power)
    part = F.floor((size / low - 1.0) * FIRST_PARTS)
    place = (power - _LEAST + 1) * FIRST_PARTS + part
    small = F.floor(size / F.lit(2.0 ** _LEAST) * FIRST_PARTS)
    place = F.when(size < 2.0 ** _LEAST, small).when(
        size == float("inf"), _INFINITE).otherwise(place).cast("long")
    return F.when(v < 0, -place - 1).otherwise(place)


def _first_range(bucket: int) -> tuple[float, float]:
    """(start, width) of a first bucket, from its end next to zero."""
    sign, place = (-1.0, -bucket - 1) if bucket < 0 else (1.0, bucket)
    power, part = divmod(place, FIRST_PARTS)
    if power == 0:
        step = 2.0 ** (_LEAST - 5)
        return sign * part * step, sign * step
    low = 2.0 ** (power - 1 + _LEAST)
    return sign * (low + part * (low / FIRST_PARTS)), sign * (low / FIRST_PARTS)


def _counts(df: DataFrame, columns, bucket, ranges=None):
    """Rows, least and largest value per column and bucket."""
    values = F.array(*[F.col(f"`{c}`").cast("double") for c in columns])
    rows = df.select(F.posexplode(values).alias("c", "v")).filter("v IS NOT NULL AND NOT isnan(v)")
    if ranges is not None:
        for name in ("low", "high", "start", "width"):
            bounds = F.array(*[F.lit(float(getattr(s, name))) for s in ranges])
            rows = rows.withColumn(name, F.element_at(bounds, F.col("c") + 1))
        rows = rows.filter("v >= low AND v <= high")
    found = rows.select("c", "v", bucket.alias("b")).groupBy("c", "b").agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
    buckets = [[] for _ in columns]
    for c, b, n, least, most in found.collect():
        buckets[c].append((b, n, least, most))
    return [sorted(some) for some in buckets]


def exact_medians(df: DataFrame, columns) -> dict[str, float | None]:
    """The median of every column as a double (nulls and NaN ignored; mean of the two middle
    values for an even count); None for a column without values, or whose middle values are the
    two infinities, which have no mean."""
    columns = list(columns)
    if not columns:
        return {}
    searches = [_Search() for _ in columns]
    for s, buckets in zip(searches, _counts(df, columns, _first_bucket(F.col("v")))):
        n = sum(b[1] for b in buckets)
        if not n:
            s.open = False
            continue
        s.ranks = ((n - 1) // 2, n // 2)
        bucket = s.take(buckets)
        if s.open:
            s.start, s.width = _first_range(bucket)
    # From the end next to zero, so that distances are exact on both sides of it.
    part = F.floor((F.col("v") - F.col("start")) / F.col("width") * PARTS)
    part = F.when(F.col("width") < 0, -part).otherwise(part).cast("long")
    while any(s.open for s in searches):
        going = [(c, s) for c, s in zip(columns, searches) if s.open]
        found = _counts(df, [c for c, _ in going], part, [s for _, s in going])
        for (_, s), buckets in zip(going, found):
            bucket = s.take(buckets)
            s.start, s.width = s.start + abs(bucket) * (s.width / PARTS), s.width / PARTS
    return {c: s.median for c, s in zip(columns, searches)}
