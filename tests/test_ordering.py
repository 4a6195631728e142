"""One order over partitions: numbers, totals, neighbours and quantiles equal those of one sorted list."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright import storage
from tracewright.operators import ordering as o


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    return [(i, r.choice([None, 0.0, -1.5, r.random(), 7.0]), r.randrange(4)) for i in range(700)]


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_numbers_and_totals(spark, rows, parts):
    df = spark.createDataFrame(rows, "id long, x double, n int").repartition(5)
    order = [F.col("x").asc_nulls_last(), F.col("id")]
    want = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0]))
    got = {r["id"]: r["k"] for r in o.number_rows(df, order, "k", 0, parts).collect()}
    assert got == {r[0]: i for i, r in enumerate(want)}
    total, sums = 0, {}
    for r in want:
        total += r[2]
        sums[r[0]] = total
    assert {r["id"]: r["total"] for r in o.running_totals(df, order, "n", parts=parts).collect()} == sums


@pytest.mark.parametrize("around", [False, True])
def test_neighbours(spark, rows, around):
    df = spark.createDataFrame(rows, "id long, x double, n int")
    got = o.with_neighbours(df, ["id"], around, 9, before=(-1, F.col("id")), after=(1, F.col("id")), next_seven=(1, F.when(F.col("x") == 7, F.col("id"))))
    sevens = [r[0] for r in rows if r[1] == 7]
    for r in got.collect():
        i = r["id"]
        assert r["before"] == (i - 1 if i else 699 if around else None)
        assert r["after"] == (i + 1 if i < 699 else 0 if around else None)
        assert r["next_seven"] == next((s for s in sevens if s > i), sevens[0] if around else None)


@pytest.mark.parametrize("accuracy", [2, 10_000])
def test_quantiles(spark, rows, accuracy):
    df = spark.createDataFrame([*rows, (1000, math.nan, 0)], "id long, x double, n int")
    values = np.array([r[1] for r in rows if r[1] is not None])
    probs = [0.0, 1 / 3, 0.5, 2 / 3, 0.9, 1.0]
    got = o.quantiles(df, "x", probs, accuracy, few=0)
    assert o.quantiles(df, "x", probs) == got
    assert np.allclose(got, np.quantile(values, probs), rtol=1e-14, atol=0)
    exact = df.where("not isnan(x)").agg(*(F.percentile("x", F.lit(p)).alias(str(i)) for i, p in enumerate(probs))).head()
    assert got == list(exact)


def test_one_value_holds_a_third(spark):
    df = spark.range(30_000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id").cast("double")).alias("x"))
    values = [5.0 if i % 3 == 0 else float(i) for i in range(30_000)]
    assert np.allclose(o.quantiles(df, "x", [0.1, 1 / 3, 0.34, 0.9], 100, few=0), np.quantile(values, [0.1, 1 / 3, 0.34, 0.9]), rtol=1e-14)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "id long, x double")
    assert o.number_rows(df, ["id"]).count() == 0 and o.quantiles(df, "x", [0.5]) == [None]
    assert o.with_neighbours(df, ["id"], after=(1, F.col("id"))).count() == 0


def test_scratch_tables_can_be_dropped(spark):
    kept = storage.materialize(spark.range(5).toDF("id"), "five")
    assert kept.count() == 5
    assert storage.drop_scratch(spark)
    assert not storage.drop_scratch(spark)
