"""One order over a whole table without a task that holds it: numbers, running totals, neighbours, exact quantiles.

Rows are range-partitioned by the order and sorted inside their partitions; the result is written once, so that a place
is the same in every later step. What partitions must know of each other (counts, sums, edges) is one row a partition and
goes through the driver. Orders should end in a column that tells rows apart: equal rows are in one partition.
Null values sort as the order columns say. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize

PLACE = "__place"
PART = "__part"
_BITS = 33  # of monotonically_increasing_id: the partition stands above, the row's place in it below


def in_order(df: DataFrame, order: Sequence[Column | str], parts: int | None = None) -> DataFrame:
    """Rows in order with ``PART`` (ascending with the order) and ``PLACE`` (from 0 in each part), written once."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(PLACE, F.monotonically_increasing_id())
    stored = materialize(placed, "in-order")
    return stored.withColumns({PART: F.shiftright(PLACE, _BITS).cast("int"), PLACE: F.col(PLACE).bitwiseAND(F.lit((1 << _BITS) - 1))})


def _per_part(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return F.broadcast(df.sparkSession.createDataFrame(rows, f"{PART} int, {schema}"))  # one row a partition


def number_rows(df: DataFrame, order: Sequence[Column | str], name: str = "row_number", first: int = 1, parts: int | None = None) -> DataFrame:
    """``df`` with its rows numbered by the order (long, from ``first``)."""
    rows = in_order(df, order, parts)
    counts = sorted((r[PART], r["n"]) for r in rows.groupBy(PART).agg(F.count("*").alias("n")).collect())
    starts = accumulate([n for _, n in counts], initial=first)
    offsets = _per_part(df, [(p, s) for (p, _), s in zip(counts, starts)], "__start long")
    return rows.join(offsets, PART).withColumn(name, F.col("__start") + F.col(PLACE)).drop(PART, PLACE, "__start")


def running_totals(df: DataFrame, order: Sequence[Column | str], value: str, name: str = "total", parts: int | None = None) -> DataFrame:
    """``df`` with the sum of ``value`` (a long) over its own and all earlier rows."""
    rows = in_order(df, order, parts)
    sums = sorted((r[PART], r["n"] or 0) for r in rows.groupBy(PART).agg(F.sum(value).cast("long").alias("n")).collect())
    offsets = _per_part(df, [(p, s) for (p, _), s in zip(sums, accumulate([n for _, n in sums], initial=0))], "__start long")
    inside = F.sum(value).over(Window.partitionBy(PART).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__inside", inside).join(offsets, PART).withColumn(name, F.col("__start") + F.coalesce("__inside", F.lit(0))).drop(PART, PLACE, "__start", "__inside")


def with_neighbours(df: DataFrame, order: Sequence[Column | str], around: bool = False, parts: int | None = None, **columns: tuple[int, Column]) -> DataFrame:
    """``df`` with, for each ``name=(step, expression)``, the expression of the nearest row before (step -1) or after (1)
    its own where it is not null; ``around`` goes on from the other end (there a row may find itself)."""
    rows = in_order(df.withColumns({f"__v_{n}": e for n, (_, e) in columns.items()}), order, parts)
    edge = {n: (F.min_by if step > 0 else F.max_by)(F.struct(F.col(f"__v_{n}").alias("v")), F.when(F.col(f"__v_{n}").isNotNull(), F.col(PLACE))).alias(n) for n, (step, _) in columns.items()}
    ends = sorted(rows.groupBy(PART).agg(*edge.values()).collect(), key=lambda r: r[PART])
    w = Window.partitionBy(PART).orderBy(PLACE)
    out = rows
    for n, (step, _) in columns.items():
        near = w.rowsBetween(1, Window.unboundedFollowing) if step > 0 else w.rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn(f"__in_{n}", (F.first if step > 0 else F.last)(f"__v_{n}", ignorenulls=True).over(near))
    beyond = []
    for i, r in enumerate(ends):
        row = [r[PART]]
        for n, (step, _) in columns.items():
            ahead = ends[i + 1 :] if step > 0 else ends[:i][::-1]
            back = (ends[: i + 1] if step > 0 else ends[i:][::-1]) if around else []
            row.append(next((e[n]["v"] for e in [*ahead, *back] if e[n] is not None and e[n]["v"] is not None), None))
        beyond.append(tuple(row))
    kinds = dict(rows.dtypes)
    edges = _per_part(df, beyond, ", ".join(f"`__b_{n}` {kinds[f'__v_{n}']}" for n in columns))
    out = out.join(edges, PART)
    return out.select(*df.columns, *(F.coalesce(f"__in_{n}", f"__b_{n}").alias(n) for n in columns))


def _between(a: float, b: float, part: float) -> float:
    """From a towards b, as ``weigh`` gives it."""
    return a if part == 0 or a == b else math.fma(1 - part, a, part * b)


def quantiles(df: DataFrame, value: str, probs: Sequence[float], accuracy: int = 10_000, few: int = 100_000) -> list[float | None]:
    """Exact quantiles (linear interpolation) of a column's values, nulls and NaN aside; null for none.

    The values are written once. Up to ``few`` of them one aggregate orders. Beyond, a mergeable sketch brackets each wanted
    rank, a count tells where the bracket stands, and values inside it are grouped, ordered and summed up by range
    partitions. A bracket that misses its rank is replaced by the whole column.
    """
    x = materialize(df.select(F.col(value).cast("double").alias("x")).where("x is not null and not isnan(x)"), "values")
    n = x.count()
    if not n:
        return [None] * len(probs)
    if n <= few:
        held = x.agg(F.sort_array(F.collect_list("x")).alias("xs"))
        near = [(int(p * (n - 1)), min(n - 1, int(p * (n - 1)) + 1)) for p in probs]
        ends = held.select(*(F.element_at("xs", r + 1) for pair in near for r in pair)).head()
        return [_between(ends[2 * i], ends[2 * i + 1], p * (n - 1) - near[i][0]) for i, p in enumerate(probs)]
    # ranks as a floor and a ceiling, so that equal probabilities ask once
    wanted = sorted({r for p in probs for r in (int(p * (n - 1)), min(n - 1, int(p * (n - 1)) + 1))})
    slack = 2 / accuracy
    low = [max(0.0, r / n - slack) for r in wanted]
    high = [min(1.0, (r + 1) / n + slack) for r in wanted]
    ends = x.agg(F.percentile_approx("x", low + high, accuracy).alias("q"), F.min("x").alias("a"), F.max("x").alias("b")).head()
    spans = [(ends["q"][i], ends["q"][i + len(wanted)]) for i in range(len(wanted))]
    below = x.agg(*(F.count_if(F.col("x") < a).alias(f"a{i}") for i, (a, _) in enumerate(spans)), *(F.count_if(F.col("x") <= b).alias(f"b{i}") for i, (_, b) in enumerate(spans))).head()
    if any(not below[f"a{i}"] <= r < below[f"b{i}"] for i, r in enumerate(wanted)):
        spans = [(ends["a"], ends["b"])] * len(wanted)
    merged: list[list[float]] = []
    for a, b in sorted(set(spans)):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    at: dict[int, float] = {}
    for a, b in merged:
        start = x.where(F.col("x") < a).count()
        inside = x.where(F.col("x").between(a, b)).groupBy("x").agg(F.count("*").alias("n"))
        summed = running_totals(inside, ["x"], "n")
        mine = [r for r in wanted if any(sa >= a and sb <= b for w, (sa, sb) in zip(wanted, spans) if w == r)]
        holds = F.array(*(F.when((F.col("total") > r - start) & (F.col("total") - F.col("n") <= r - start), F.lit(r)) for r in mine))
        found = summed.select("x", F.explode(F.array_compact(holds)).alias("r")).collect()  # a row for each wanted rank
        at |= {r["r"]: r["x"] for r in found}
    out = []
    for p in probs:
        place = p * (n - 1)
        lo = int(place)
        hi = min(n - 1, lo + 1)
        out.append(_between(at[lo], at[hi], place - lo))
    return out
