"""Interval join against all pairs; how many pairs meet; one long episode."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tracewright.operators import intervals as iv
from tracewright.operators import signals


@pytest.mark.parametrize("width", [None, 1, 3, 1000])
def test_equals_all_pairs(spark, width):
    r = random.Random(4)
    points = [(r.choice(["a", "b", None]), r.choice([None, r.randrange(-20, 60)]), i) for i in range(300)]
    spans = [(r.choice(["a", "b", "c", None]), r.choice([None, r.randrange(-40, 70)]), r.choice([None, r.randrange(-40, 70), 10**12]), i) for i in range(120)]
    want = sorted((p[2], s[3]) for p in points for s in spans if p[0] == s[0] and None not in (p[0], p[1], s[1], s[2]) and s[1] <= p[1] <= s[2])
    got = iv.interval_join(spark.createDataFrame(points, "k string, x long, i int"), spark.createDataFrame(spans, "k string, a long, b long, j int"), ["k"], "x", "a", "b", width)
    assert got.columns == ["k", "x", "i", "a", "b", "j"]
    assert sorted((x["i"], x["j"]) for x in got.collect()) == want


def test_short_intervals_need_no_look(spark):
    points, spans = [("a", i) for i in range(50)], [("a", 5 * i, 5 * i + i % 7) for i in range(9)]
    want = sorted((x, a) for _, x in points for _, a, b in spans if a <= x <= b)
    got = iv.interval_join(spark.createDataFrame(points, "k string, x int"), spark.createDataFrame(spans, "k string, a int, b int"), ["k"], "x", "a", "b", 4, short=True)
    assert sorted((r["x"], r["a"]) for r in got.collect()) == want


def test_empty_sides(spark):
    points, spans = spark.createDataFrame([("a", 1)], "k string, x int"), spark.createDataFrame([("a", 0, 5), ("a", 5, 0)], "k string, a int, b int")
    assert iv.interval_join(points, spans, ["k"], "x", "a", "b").count() == 1
    assert iv.interval_join(points.where("false"), spans, ["k"], "x", "a", "b").count() == 0
    assert iv.interval_join(points, spans.where("a > b"), ["k"], "x", "a", "b").count() == 0


def met_rows(spark, points, spans, w):
    """Rows that meet in bins, before the comparison of ends."""
    p = points.withColumn(iv.BIN, F.floor(F.col("frame_idx") / w))
    return p.join(spans.withColumn(iv.BIN, F.explode(F.sequence(F.floor(F.col("start_frame") / w), F.floor(F.col("end_frame") / w)))), ["episode_id", iv.BIN]).count()


def test_one_episode_of_a_million_frames(spark):
    n, m = 1_000_000, 50_000
    frames = spark.range(n).select(F.lit("e").alias("episode_id"), F.col("id").cast("int").alias("frame_idx"), F.array((F.col("id") % 97).cast("double")).alias("action"))
    length = F.when(F.col("id") % 10 == 0, 110).otherwise(10)  # 20 on average
    start = (F.floor(F.col("id") / 10) * 200 + F.when(F.col("id") % 10 == 0, 0).otherwise(100 + 10 * (F.col("id") % 10))).cast("int")
    spans = spark.range(m).select(F.lit("e").alias("episode_id"), F.col("id").cast("int").alias("segment_idx"), start.alias("start_frame"), (start + length - 1).cast("int").alias("end_frame"))
    w, _, _ = iv.bin_width(frames, spans, "frame_idx", "start_frame", "end_frame")
    assert w == 20 and met_rows(spark, frames, spans, w) <= 3 * n
    began = time.time()
    got = signals.excursions(frames, spans, smooth=1)
    rows = got.agg(F.count("*").alias("k"), F.sum("n").alias("n")).head()
    assert rows["k"] == m and rows["n"] == n and time.time() - began < 120
