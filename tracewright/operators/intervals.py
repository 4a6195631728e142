"""Points that lie in intervals, by equal bins instead of all pairs of a key.

Both sides are cut into bins as wide as an interval is on average. An interval stands in every bin it touches, which are at
most three times as many rows as there are intervals; a point stands in its own bin alone, so each pair meets once. With
points at most ``d`` to a place, the pairs that meet are at most three times the summed lengths of the intervals times d,
however many points or intervals a key has, and a key is spread over as many tasks as it has bins.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BIN = "__bin"


def bin_width(points: DataFrame, intervals: DataFrame, point: str, low: str, high: str) -> tuple[float, float, float] | None:
    """(width, first, last): mean length of the intervals as far as there are points, and the ends of these; null for none."""
    ends = points.agg(F.min(point).alias("a"), F.max(point).alias("b")).head()
    if ends["a"] is None:
        return None
    cut = F.least(F.col(high), F.lit(ends["b"])) - F.greatest(F.col(low), F.lit(ends["a"]))
    mean = intervals.agg(F.avg(F.when(cut >= 0, cut + 1))).head()[0]
    return None if mean is None else (max(1.0, math.ceil(mean)), ends["a"], ends["b"])


def interval_join(points: DataFrame, intervals: DataFrame, keys: Sequence[str], point: str, low: str, high: str, width: float | None = None, short: bool = False) -> DataFrame:
    """Pairs of equal keys with low <= point <= high: the columns of ``points`` and those of ``intervals`` but the keys.

    Other column names must differ. Null ends or points match nothing; intervals that end before they begin hold none.
    ``points`` and ``intervals`` are read twice, once for two or three numbers about them; not so if the intervals are
    ``short``, that is, known to be at most a few ``width`` long.
    """
    kept, a, b, w = intervals.where(F.col(low) <= F.col(high)), F.col(low), F.col(high), width
    if not (short and width):
        found = bin_width(points, intervals, point, low, high)
        if found is None:
            return points.where("false").join(kept.where("false"), list(keys))
        w = width or found[0]
        a, b = F.greatest(a, F.lit(found[1])), F.least(b, F.lit(found[2]))
    bins = lambda c: F.floor(c / w).cast("long")
    dealt = kept.where(a <= b).withColumn(BIN, F.explode(F.sequence(bins(a), bins(b))))
    met = points.withColumn(BIN, bins(F.col(point))).join(dealt, [*keys, BIN])
    return met.where(F.col(point).between(F.col(low), F.col(high))).drop(BIN)
