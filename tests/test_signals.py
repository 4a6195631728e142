import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.functions import names
from tracewright.functions.vectors import even_positions, weigh
from tracewright.operators import signals as s


def model_window(a, rel=0.12, smooth=5):
    n = len(a)
    if n < 3:
        return 0, max(0, n - 1), 0, 0.0
    v = np.linalg.norm(np.diff(a, axis=0), axis=1)
    if len(v) >= smooth:
        v = np.convolve(v, np.ones(smooth) / smooth, mode="same")
    above = np.flatnonzero(v > rel * (np.quantile(v, 0.9) or v.max()))
    if not len(above):
        return 0, 0, 0, 0.0
    on, off = int(above[0]), int(above[-1]) + 1
    return on, off, off - on, round((off - on) / n, 4)


def frames(spark, episodes):
    rows = [(e, i, [float(x) for x in f]) for e, a in episodes.items() for i, f in enumerate(a)]
    return spark.createDataFrame(rows, "episode_id string, frame_idx int, action array<double>").repartition(3)


@pytest.fixture(scope="module")
def episodes():
    rng = np.random.default_rng(0)
    out = {"still": np.zeros((20, 3)), "one": np.ones((1, 3)), "two": np.arange(6.0).reshape(2, 3), "three": np.arange(9.0).reshape(3, 3)}
    for k in range(6):
        a = np.cumsum(rng.normal(size=(40 + k, 3)) * (rng.random((40 + k, 1)) > 0.5), axis=0)
        a[:8] = a[8]
        out[f"e{k}"] = a
    return out


def test_active_windows(spark, episodes):
    for r in s.active_windows(frames(spark, episodes)).collect():
        a = episodes[r["episode_id"]]
        assert (r["onset"], r["offset"], r["active_frames"], r["active_fraction"]) == pytest.approx(model_window(a))
        speed = 0.0 if len(a) < 2 else np.linalg.norm(np.diff(a, axis=0), axis=1).mean()
        assert r["n"] == len(a) and r["speed_norm"] == pytest.approx(speed)


def test_active_sets(spark, episodes):
    segs = [(e, i, a, b) for e, x in episodes.items() for i, (a, b) in enumerate([(0, 6), (7, 8), (9, 9), (10, 500)]) if a < len(x)]
    dims = names.dims_table(spark, ["joint_1", "joint_2", "gripper"], 3)
    df = spark.createDataFrame(segs, "episode_id string, segment_idx int, start_frame int, end_frame int")
    for r in s.active_sets(frames(spark, episodes), df, dims).collect():
        a = episodes[r["episode_id"]]
        part, span = a[r["start_frame"] : r["end_frame"] + 1], a.max(0) - a.min(0)
        want = None
        if len(a) >= 2:
            if len(part) >= 5:
                part = np.stack([np.convolve(part[:, d], np.ones(5) / 5, mode="valid") for d in range(3)], axis=1)
            m = (part.max(0) - part.min(0)) / np.maximum(span, 1e-6)
            on = [g for g, ds in (("arm", (0, 1)), ("gripper", (2,))) if max(m[d] for d in ds) > 0.25]
            want = "+".join(on) if on and r["end_frame"] > r["start_frame"] and len(a) - r["start_frame"] > 1 else "none"
        assert r["active_dof"] == want, r


def test_gripper(spark):
    x = np.concatenate([np.ones(10), np.zeros(3), np.ones(2), np.zeros(20), np.ones(15)])
    flat = {"g": np.stack([np.arange(50.0), x], axis=1), "flat": np.ones((30, 2))}
    series = frames(spark, flat).select("episode_id", "frame_idx", F.element_at("action", -1).alias("x"))
    raw = sorted((r["frame_idx"], r["kind"]) for r in s.transitions(series).collect())
    assert raw == [(10, "close"), (13, "open"), (15, "close"), (35, "open")]
    assert sorted(r["frame_idx"] for r in s.debounced(s.transitions(series)).collect()) == [10, 35]
    found = {r["episode_id"]: r["boundaries"] for r in s.proprioceptive_boundaries(frames(spark, flat)).collect()}
    assert found["flat"] == [] and found["g"][-1] == 35 and 10 in found["g"]


def test_even_positions(spark):
    rows = spark.createDataFrame([(n, k) for n in (0, 1, 2, 5, 17, 100) for k in (1, 2, 6, 12)], "n int, k int")
    for r in rows.select("n", "k", even_positions(F.col("n"), F.col("k")).alias("p")).collect():
        want = [0] if r["n"] <= 1 else sorted({int(round(x)) for x in np.linspace(0, r["n"] - 1, min(r["k"], r["n"]))})
        assert r["p"] == want, r


def test_dense_window(spark):
    got = spark.range(1).select(*(s.dense_window(F.lit(a), F.lit(b), m).alias(f"w{a}_{b}_{m}") for a, b, m in ((3, 9, 25), (0, 30, 10), (0, 29, 10)))).first()
    assert got[0] == list(range(3, 10)) and got[1] == [0, 4, 8, 12, 16, 20, 24, 28, 30] and got[2][-1] == 29


def test_names(spark):
    rows = spark.createDataFrame([(["shoulder.pos", "gripper.pos"],), (["ee_x", "ee_y", "roll"],), (["a"],), ([],), (None,), (["left_joint", "x"],)], "n array<string>")
    assert [r[0] for r in rows.select(names.control_modality(F.col("n"))).collect()] == ["joint", "end-effector", None, None, None, "joint"]
    assert [r[0] for r in rows.select(names.gripper_dims(F.col("n"), F.lit(2))).collect()] == [[1], [1], [1], [1], [1], [1]]
    groups = rows.select(names.component_groups(F.col("n"), F.lit(2), {"gripper": ["grip"], "left": ["left"]})).collect()
    assert [r[0] for r in groups] == [["arm", "gripper"], ["arm", "arm"], ["arm", "arm"], ["arm", "arm"], ["arm", "arm"], ["left", "arm"]]


def test_results_do_not_depend_on_partitioning(spark, episodes):
    df = frames(spark, episodes)
    a, b = (sorted(map(str, s.active_windows(df.repartition(n)).collect())) for n in (1, 7))
    assert a == b


def test_frame_embedding(spark):
    rng = np.random.default_rng(1)
    image = rng.random((36, 50))
    df = spark.createDataFrame([(image.ravel().tolist(), 36, 50)], "g array<double>, h int, w int")
    got = np.array(df.select(s.frame_embedding(F.col("g"), F.col("h"), F.col("w"))).first()[0])
    want = image[::3, ::4][:12, :12].ravel()
    want = want - want.mean()
    assert got == pytest.approx(want / np.linalg.norm(want))


def test_a_quantile_between_near_values_stays_between_them(spark):
    """Two values a last bit apart about the quartile: the quarter of the way from the lower one rounds to it, so it is not below."""
    a, b = float.fromhex("0x1.54fdf3b645a1dp-1"), float.fromhex("0x1.54fdf3b645a1ep-1")
    x = [9.0] * 58
    for i in range(14):
        x[2 + i] = 0.1
    x[30], x[40] = a, b  # the 15th and 16th of 58: the quartile is at 14.25 from 0
    speed = spark.createDataFrame([("e", i, v) for i, v in enumerate(x)], "episode_id string, i int, s double")
    assert {r["q"] for r in s.with_quantile(speed, "s", 0.25, "q").collect()} == {a}
    assert [r["frame_idx"] for r in s.pauses(speed).collect()] == [9]


def test_a_product_is_not_rounded_before_the_sum(spark):
    rng = np.random.default_rng(6)
    near = rng.random(500)
    rows = [(float(x), float(np.nextafter(x, 2)) if i % 2 else float(rng.random()), float(p)) for i, x in enumerate(near) for p in (0.25, 0.5, 0.75, 0.1, 0.9)]
    rows += [(float("inf"), float("inf"), 0.5), (1.0, float("inf"), 0.5)]
    df = spark.createDataFrame(rows, "a double, b double, p double")
    got = df.select("*", weigh(F.col("a"), F.col("b"), F.col("p")).alias("w")).collect()
    assert all(r["w"] == (r["a"] if r["a"] == r["b"] else math.fma(1 - r["p"], r["a"], r["p"] * r["b"])) for r in got)
