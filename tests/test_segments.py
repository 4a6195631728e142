import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewright.functions import text as t
from tracewright.operators import metrics, segments as g


def one(spark, build, n=50, **lists):
    df = spark.createDataFrame([(n,)], "n int").select("n", *(F.lit(json.dumps(v)).alias(k) for k, v in lists.items()))
    row = df.select(*[c.alias(f"c{i}") for i, c in enumerate(build() if isinstance(build(), tuple) else (build(),))]).first()
    return row[0] if len(row) == 1 else tuple(row)


def brief(segs):
    return [(s["start_frame"], s["end_frame"], s["phase"]) for s in segs]


def test_validated(spark):
    answer = {"segments": [{"subtask_text": " a ", "end_step": 9}, {"text": "", "end_step": 20}, {"text": "b", "end_frame": "x"}, {"description": "c", "end_step": 400}, {"text": "d", "end_step": 3}]}
    out = one(spark, lambda: g.validated(g.parse_answer(F.col("a")), F.col("n")), a=answer)
    assert [(s["segment_idx"], s["start_frame"], s["end_frame"], s["subtask_text"]) for s in out] == [(0, 0, 9, "a"), (1, 10, 10, "b"), (2, 11, 49, "c")]
    empty = one(spark, lambda: g.validated(g.parse_answer(F.col("a")), F.col("n")), a={"x": 1})
    assert [(s["start_frame"], s["end_frame"], s["subtask_text"]) for s in empty] == [(0, 49, "complete the task")]


GOOD = [{"phase": "Approach", "end_frame": 9, "evidence": "e", "target": "cube"}, {"phase": "dance", "end_frame": 20, "evidence": "e", "target": "cube"}, {"phase": "retract", "end_frame": 30, "evidence": "e", "target": "none"}]


@pytest.mark.parametrize(
    "items,error",
    [
        (GOOD, None),
        ([], "no segments in answer"),
        ([GOOD[0] | {"end_frame": "soon"}], "segment missing integer end_frame"),
        ([GOOD[0] | {"evidence": " "}], "segment missing per-boundary evidence"),
        ([GOOD[0] | {"target": "N/A"}], "segment (approach) missing a target object"),
        (GOOD[:2], "below min granularity: 2 < 3 segments"),
        (GOOD + [GOOD[2] | {"end_frame": 40}], None),
    ],
)
def test_grounded(spark, items, error):
    segs, e = one(spark, lambda: g.grounded(g.parse_answer(F.col("a")), F.col("n"), vocabulary=["approach", "retract"]), a=items)
    assert e == error
    if error is None:
        assert brief(segs) == [(0, 9, "approach"), (10, 20, "other"), (21, 49, "retract")] and segs[0]["subtask_text"] == "approach cube"


def test_open_vocabulary_lets_wind_down_go_without_target(spark):
    items = GOOD[:2] + [{"phase": "go home", "end_frame": 30, "evidence": "e", "target": "none"}]
    segs, e = one(spark, lambda: g.grounded(g.parse_answer(F.col("a")), F.col("n"), vocabulary=None), a=items)
    assert e is None and brief(segs)[-1] == (21, 49, "go home")


def seg_list(spec):
    return F.array(*(g.segment(F.lit(a), F.lit(b), p, p, "e", None, i) for i, (a, b, p) in enumerate(spec)))


def test_deduped_tail(spark):
    cases = [
        ([(0, 9, "grasp"), (10, 19, "retract"), (20, 29, "withdraw arm"), (30, 49, "home")], [(0, 9, "grasp"), (10, 49, "retract")]),
        ([(0, 9, "a"), (10, 19, "a"), (20, 29, "b")], [(0, 9, "a"), (10, 19, "a"), (20, 29, "b")]),
        ([(0, 9, "a"), (10, 19, "a")], [(0, 19, "a")]),
    ]
    for spec, want in cases:
        assert brief(one(spark, lambda: g.deduped_tail(seg_list(spec)))) == want


def test_snapped(spark):
    spec = [(0, 9, "approach"), (10, 29, "grasp"), (30, 39, "move"), (40, 49, "release")]
    moves = F.array(*(F.struct(F.lit(f).alias("frame_idx"), F.lit(k).alias("kind")) for f, k in ((5, "open"), (14, "close"), (37, "open"), (41, "open"))))
    assert brief(one(spark, lambda: g.snapped(seg_list(spec), moves))) == [(0, 14, "approach"), (15, 29, "grasp"), (30, 37, "move"), (38, 49, "release")]
    assert brief(one(spark, lambda: g.snapped(seg_list(spec), moves, 1))) == spec


def test_refined_is_sequential(spark):
    spec = [(0, 9, "a"), (10, 19, "b"), (20, 49, "c")]
    answers = F.array(F.lit(18), F.lit(3))
    assert brief(one(spark, lambda: g.refined(seg_list(spec), answers, 15, F.col("n")))) == [(0, 18, "a"), (19, 20, "b"), (21, 49, "c")]


def test_combined_samples(spark):
    def row(e, k, ends, target="t"):
        out, start = [], 0
        for i, b in enumerate(ends):
            out.append((i, start, b, f"s{k}", "p", "e", target))
            start = b + 1
        return e, k, 50, out

    rows = [row("a", 0, [10, 49]), row("a", 1, [11, 20, 49]), row("a", 2, [14, 30, 49]), row("b", 0, [49]), row("c", 0, [5, 49]), row("c", 1, [9, 20, 49]), ("d", 0, 50, [])]
    df = spark.createDataFrame(rows, f"episode_id string, sample int, num_frames int, segments {g.SEGMENTS}")
    got = {r["episode_id"]: r["segments"] for r in g.combined_samples(df).collect()}
    assert [(s["start_frame"], s["end_frame"], s["subtask_text"], s["target"]) for s in got["a"]] == [(0, 12, "s1", None), (13, 25, "s1", None), (26, 49, "s1", None)]
    assert len(got["b"]) == 1 and [s["end_frame"] for s in got["c"]] == [5, 49] and got["d"][0]["subtask_text"] == "complete the task"


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-5, 80), max_size=9), st.integers(1, 60))
def test_segments_cover_the_episode(spark, ends, n):
    segs = one(spark, lambda: g.validated(g.parse_answer(F.col("a")), F.col("n")), n=n, a=[{"text": "x", "end_step": e} for e in ends])
    assert segs[0]["start_frame"] == 0 and segs[-1]["end_frame"] == n - 1
    assert all(b["start_frame"] == a["end_frame"] + 1 for a, b in zip(segs, segs[1:])) and [s["segment_idx"] for s in segs] == list(range(len(segs)))


def test_greedy_boundary_matching(spark):
    def brute(pred, gold, tol):
        used, errs = set(), []
        for b in sorted(gold):
            near = sorted((abs(p - b), j) for j, p in enumerate(pred) if j not in used and abs(p - b) <= tol)
            if near:
                used.add(near[0][1])
                errs.append(near[0][0])
        return errs

    for pred, gold, tol in (([1, 5, 9], [2, 6], 3), ([10], [8, 11], 5), ([], [1], 5), ([4, 4, 6], [5, 5, 5], 1), ([3], [], 2)):
        arr = lambda xs: F.array(*map(F.lit, xs)).cast("array<int>")
        assert spark.range(1).select(metrics.greedy_errors(arr(pred), arr(gold), tol)).first()[0] == brute(pred, gold, tol)


def test_iou_is_symmetric_and_bounded(spark):
    rows = [(0, 9, 5, 14), (0, 9, 20, 30), (3, 3, 3, 3), (None, 1, 2, 3)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int")
    x = df.select(metrics.temporal_iou(*map(F.col, "abcd")).alias("x"), metrics.temporal_iou(*map(F.col, "cdab")).alias("y")).collect()
    assert [r["x"] for r in x] == [r["y"] for r in x] == pytest.approx([5 / 15, 0.0, 1.0, None])


def test_text_functions(spark):
    def run(c):
        return spark.range(1).select(c).first()[0]

    assert run(t.object_tokens(F.lit("Grasp the (Cube), then RED Brick."))) == ["cube", "brick"]
    assert run(t.has_unnegated(F.lit("It was not placed"), t.SUCCESS_WORDS)) is False
    assert run(t.has_unnegated(F.lit("no " + "x " * 10 + "placed"), t.SUCCESS_WORDS)) is True
    assert run(t.clean_target(F.lit(" The Scene "))) is None and run(t.clean_target(F.lit("x" * 90))) == "x" * 80
    assert run(t.extract_json(F.lit('```json\n{"a": 1}\n```'))) == '{"a": 1}' and run(t.extract_json(F.lit('so: [1, 2] ok'))) == "[1, 2]" and run(t.extract_json(F.lit("none"))) is None
    assert [run(t.frame_answer(F.lit(x))) for x in ('{"frame": 7}', '{"end_frame": "8"}', "9", '{"x": 1}')] == [7, 8, 9, None]
    m = run(t.metadata_answer(F.lit('{"quality": 9, "mistake": "Yes", "reason": " r "}')))
    assert (m["quality"], m["task_success_quality"], m["mistake"], m["reason"]) == (5, 5, True, "r")
    assert run(t.candidates_text(F.lit('{"candidates":[{"content":{"parts":[{"text":"a"},{"text":"b"}]}}]}'))) == "a\nb"
    assert run(t.output_text(F.lit('{"output":[{"content":[{"type":"text","text":"a"},{"type":"x","text":"n"}]}]}'))) == "a"
    assert run(t.output_text(F.lit('{"output_text":"z"}'))) == "z" and t.fill("{a} {b}", a=1) == "1 {b}"
