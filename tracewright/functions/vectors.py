"""Column functions over numeric arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(xs: Column) -> Column:
    """Sum of an array of doubles, left to right; 0 for an empty array."""
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


def difference_norm(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays of equal length."""
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def as_doubles(xs: Column) -> Column:
    return F.transform(xs, lambda x: x.cast("double"))


def at(xs: Column, i: Column | int) -> Column:
    """0-based element, null out of range."""
    return F.get(xs, i if isinstance(i, Column) else F.lit(i))


def even_positions(n: Column, k: Column) -> Column:
    """The distinct rounded points of k evenly spaced positions over 0..n-1, ascending; [0] if n <= 1.

    Ties go to the even neighbour.
    """
    m = F.least(k, n).cast("int")
    step = (n - 1).cast("double") / F.greatest(m - 1, F.lit(1))
    points = F.transform(F.sequence(F.lit(0), F.greatest(m - 1, F.lit(0))), lambda i: F.bround(i * step, 0).cast("int"))
    return F.when(n <= 1, F.array(F.lit(0))).otherwise(F.array_sort(F.array_distinct(points)))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, also where the body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def weigh(a: Column, b: Column, part: Column) -> Column:
    """(1 - part) * a + part * b with the first product not rounded by itself, as a fused multiply-add gives it; a where both are equal.

    The error of that product is taken by splitting its factors in halves, that of the sum by subtracting back.
    """
    w = 1 - part
    half = lambda x: x * 134217729.0 - (x * 134217729.0 - x)
    wh, ah = half(w), half(a)
    p, q = w * a, part * b
    lost = ((wh * ah - p) + wh * (a - ah) + (w - wh) * ah) + (w - wh) * (a - ah)
    s = p + q
    rest = (p - (s - (s - p))) + (q - (s - p))
    return F.when(a == b, a).otherwise(F.nanvl(s + (rest + lost), s))
