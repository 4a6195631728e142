"""Frame labels by pieces between the ends of segments; places in viewer orders by the columns of the order alone."""

import random

from tracewright.operators import export, views

SEGS = "episode_id string, segment_idx int, start_frame int, end_frame int, subtask_text string, phase string"


def test_frame_labels_of_overlapping_segments(spark):
    r, segs = random.Random(3), []
    n = {f"e{i}": r.randrange(0, 30) for i in range(12)}
    for e in n:
        for k in range(r.randrange(0, 9)):
            a = r.randrange(-5, 35)
            segs.append((e, k, None if r.random() < 0.1 else a, None if r.random() < 0.1 else a + r.randrange(-3, 25), r.choice("xyz "), None))
    segments = spark.createDataFrame(segs, SEGS)
    got = export.frame_indices(segments, spark.createDataFrame(list(n.items()), "episode_id string, num_frames int"))
    numbers = {x["phrase"]: x["subtask_index"] for x in export.vocabulary(segments).collect()}
    want = []
    for e, m in n.items():
        for i in range(m):
            held = [(k, numbers[t]) for x, k, a, b, t, _ in segs if x == e and t.strip() and max(0, a or 0) <= i <= min(m - 1, m - 1 if b is None else b)]
            want.append((e, i, max(held)[1] if held else 0))
    assert sorted(tuple(x) for x in got.collect()) == sorted(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "explode(sequence" in plan.split("Exchange")[0], "frames appear after the last shuffle"


def test_places_move_the_columns_of_the_order_alone(spark, monkeypatch):
    df = spark.createDataFrame([(str(i), i % 2, i % 5, "long text") for i in range(20)], "episode_id string, task_ord int, n_flags int, note string")
    want = {(x["place"], x["episode_id"]) for x in views.placed_view(df, "flags", True).collect()}
    seen, number = [], views.number_rows
    monkeypatch.setattr(views, "number_rows", lambda d, *a, **k: seen.append(d.columns) or number(d, *a, **k))
    assert {tuple(x) for x in views.places(df, "flags", True).collect()} == want and len(want) == 20
    assert seen == [["episode_id", "task_ord", "n_flags"]]
