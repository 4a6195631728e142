"""Segment construction: ordered folds over an episode's segments, as higher-order functions over one array column.

An episode has few segments (6 by default), so folds over arrays stay small; nothing here shuffles but the grouping of
samples. A segment is (segment_idx, start_frame, end_frame, subtask_text, phase, evidence, target).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_target, contact_kind, is_wind_down, target_optional

SEGMENT = "struct<segment_idx:int,start_frame:int,end_frame:int,subtask_text:string,phase:string,evidence:string,target:string>"
SEGMENTS = f"array<{SEGMENT}>"
ANSWER = "array<struct<end_frame:string,end_step:string,subtask_text:string,text:string,description:string,phase:string,evidence:string,target:string>>"
#: Default phases and the error texts of ``grounded`` are fixed values: stored answers and reports state them.
PHASES = ["approach", "grasp", "transport", "release-place", "retract"]


def segment(start, end, text, phase=None, evidence=None, target=None, idx=0) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    parts = zip(("segment_idx", "start_frame", "end_frame", "subtask_text", "phase", "evidence", "target"), (idx, start, end, text, phase, evidence, target), ("int", "int", "int", "string", "string", "string", "string"))
    return F.struct(*(as_col(v).cast(t).alias(n) for n, v, t in parts))


def none() -> Column:
    return F.array().cast(SEGMENTS)


def parse_answer(json: Column) -> Column:
    """Items of a segmentation answer: a JSON list, or an object with segments or subtasks; null if there is no list."""
    listed = F.when(F.trim(json).startswith("["), json).otherwise(F.coalesce(F.get_json_object(json, "$.segments"), F.get_json_object(json, "$.subtasks")))
    return F.from_json(listed, ANSWER)


def numbered(segs: Column) -> Column:
    return F.transform(segs, lambda s, i: s.withField("segment_idx", i.cast("int")))


def stretched(segs: Column, last: Column) -> Column:
    """First segment from frame 0, last one to the last frame, numbered."""
    n = F.size(segs)
    ends = F.transform(segs, lambda s, i: s.withField("start_frame", F.when(i == 0, F.lit(0)).otherwise(s["start_frame"])).withField("end_frame", F.when(i == n - 1, last).otherwise(s["end_frame"])))
    return numbered(ends)


def _cover(items: Column, last: Column, make) -> Column:
    """Contiguous segments from frame 0: each starts after the one before, ends no earlier and not after the last frame."""

    def step(s, item):
        cursor = F.when(F.size(s) > 0, F.element_at(s, -1)["end_frame"] + 1).otherwise(F.lit(0))
        made = make(item, cursor)
        return F.when((cursor > last) | made.isNull(), s).otherwise(F.concat(s, F.array(made)))

    return F.aggregate(items, none(), step)


def _text(item: Column) -> Column:
    pick = lambda x: F.nullif(x, F.lit(""))
    return F.trim(F.coalesce(pick(item["subtask_text"]), pick(item["text"]), pick(item["description"]), F.lit("")))


def _whole(x: Column) -> Column:
    return x.try_cast("double").cast("int")


def validated(items: Column, num_frames: Column, most: int = 6) -> Column:
    """Free-text answers: items without text are skipped, unreadable ends end where they start; never empty."""
    last = F.greatest(F.lit(0), num_frames - 1).cast("int")

    def make(item, cursor):
        end = F.coalesce(_whole(F.coalesce(item["end_step"], item["end_frame"])), cursor)
        return F.when(_text(item) != "", segment(cursor, F.least(F.greatest(cursor, end), last), F.substring(_text(item), 1, 160)))

    segs = _cover(F.slice(F.coalesce(items, F.array().cast(ANSWER)), 1, most), last, make)
    return F.when(F.size(segs) > 0, stretched(segs, last)).otherwise(F.array(segment(F.lit(0), last, "complete the task")))


def deduped_tail(segs: Column) -> Column:
    """Trailing segments of one phase, or all of a wind-down kind, become one with the first one's label."""

    def step(done, b):  # from the end: the accumulator holds what follows, nearest first
        a = F.element_at(done, 1)
        same = ((a["phase"] != "") & (a["phase"] == b["phase"])) | (is_wind_down(a["phase"]) & is_wind_down(b["phase"]))
        merged = b.withField("end_frame", a["end_frame"]).withField("target", F.coalesce(b["target"], a["target"]))
        only = F.size(done) == 1
        return F.when(F.size(done) == 0, F.array(b)).when(only & F.coalesce(same, F.lit(False)), F.array(merged)).otherwise(F.concat(F.array(b), done))

    return F.aggregate(F.reverse(segs), none(), step)


def grounded(items: Column, num_frames: Column, *, vocabulary: list[str] | None = PHASES, grounded: bool = True, require_target: bool = True, min_segments: int | None = 3, most: int = 6) -> tuple[Column, Column]:
    """(segments, error) of a grounded answer; error is null, or what it fails first.

    ``vocabulary`` None leaves phases free; others outside it become "other". Errors: no segments, no integer end,
    missing evidence, missing target (but for withdrawal), too few segments (the segments are given all the same).
    """
    last = F.greatest(F.lit(0), num_frames - 1).cast("int")
    cut = F.slice(F.coalesce(items, F.array().cast(ANSWER)), 1, most)

    def fields(item):
        raw = F.lower(F.trim(F.coalesce(item["phase"], F.lit(""))))
        phase = F.when(raw.isin(vocabulary), raw).otherwise("other") if vocabulary is not None else raw
        return phase, F.trim(F.coalesce(item["evidence"], F.lit(""))), clean_target(item["target"]), _whole(F.coalesce(item["end_frame"], item["end_step"]))

    def make(item, cursor):
        phase, evidence, target, end = fields(item)
        named = F.trim(F.concat_ws(" ", F.nullif(phase, F.lit("")), target))
        text = F.coalesce(F.nullif(_text(item), F.lit("")), F.nullif(named, F.lit("")), F.lit("subtask"))
        return segment(cursor, F.least(F.greatest(cursor, F.coalesce(end, cursor)), last), F.substring(text, 1, 160), F.nullif(phase, F.lit("")), F.nullif(evidence, F.lit("")), target)

    def wrong(item):
        phase, evidence, target, end = fields(item)
        e = F.when(end.isNull(), "segment missing integer end_frame")
        if grounded:
            e = e.when(evidence == "", "segment missing per-boundary evidence")
        if require_target:
            e = e.when(target.isNull() & ~target_optional(phase, vocabulary is None), F.concat(F.lit("segment ("), F.when(phase != "", phase).otherwise("phase"), F.lit(") missing a target object")))
        return e

    covered = _cover(cut, last, make)
    # items after the last frame is reached are not looked at
    used = F.slice(cut, 1, F.size(covered))
    errors = F.filter(F.transform(used, wrong), lambda e: e.isNotNull())
    segs = stretched(deduped_tail(covered), last)
    error = F.when(F.coalesce(F.size(items), F.lit(0)) <= 0, "no segments in answer").when(F.size(errors) > 0, F.element_at(errors, 1)).when(F.size(covered) == 0, "no valid segments after parsing")
    if min_segments:
        error = error.when(F.size(segs) < min_segments, F.concat(F.lit("below min granularity: "), F.size(segs).cast("string"), F.lit(f" < {min_segments} segments")))
    return segs, error


def from_boundaries(boundaries: Column, num_frames: Column, phases: list[str] = PHASES) -> Column:
    """Segments between inner boundaries, phases by order."""
    last = F.greatest(F.lit(0), num_frames - 1).cast("int")
    names = F.array(*map(F.lit, phases))
    edges = F.concat(F.array(F.lit(-1)), boundaries)

    def one(b, i):
        phase = F.coalesce(F.get(names, i), F.lit("other"))
        end = F.coalesce(F.get(boundaries, i), last)
        return segment(b + 1, F.least(F.greatest(b + 1, end), last), F.concat(phase, F.lit(" (proprioceptive)")), phase, "gripper/end-effector event", None, i)

    segs = F.transform(edges, one)
    whole = F.array(segment(F.lit(0), last, "complete the task", "other"))
    return F.when(num_frames <= 1, whole).otherwise(stretched(segs, last))


def monotonic(boundaries: Column, last: Column) -> Column:
    """Each boundary after the one before and before the last frame."""

    def step(out, b):
        before = F.when(F.size(out) > 0, F.element_at(out, -1)).otherwise(F.lit(0))
        return F.concat(out, F.array(F.greatest(before + 1, F.least(b, last - 1))))

    return F.aggregate(boundaries, F.array().cast("array<int>"), step)


def combined_samples(samples: DataFrame) -> DataFrame:
    """(episode_id, sample, num_frames, segments) -> (episode_id, segments): self-consistency.

    Of samples with the commonest number of segments (the one seen first if several are as common), each boundary is
    the median, rounded half to even; labels are the first such sample's, targets are dropped.
    """
    some = samples.where(F.size("segments") > 0).withColumn("k", F.size("segments"))
    counts = some.groupBy("episode_id", "k").agg(F.count("*").alias("c"), F.min("sample").alias("first"))
    modal = counts.groupBy("episode_id").agg(F.max_by("k", F.struct("c", -F.col("first"))).alias("k"))
    same = some.join(modal, ["episode_id", "k"])
    ref = same.groupBy("episode_id", "k").agg(F.min_by("segments", "sample").alias("ref"), F.max("num_frames").alias("num_frames"))
    ends = same.select("episode_id", F.posexplode("segments").alias("j", "s")).groupBy("episode_id", "j").agg(F.bround(F.percentile(F.col("s.end_frame"), F.lit(0.5)), 0).cast("int").alias("b"))
    lists = ends.groupBy("episode_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "b"))), lambda x: x["b"]).alias("bs"))
    last = F.greatest(F.lit(0), F.col("num_frames") - 1).cast("int")
    made = ref.join(lists, "episode_id").withColumn("bs", monotonic(F.slice("bs", 1, F.col("k") - 1), last))

    def step(out, r):
        i = F.size(out)
        start = F.when(i > 0, F.element_at(out, -1)["end_frame"] + 1).otherwise(F.lit(0))
        end = F.least(F.greatest(start, F.coalesce(F.get(F.col("bs"), i), last)), last)
        return F.concat(out, F.array(segment(start, end, r["subtask_text"], r["phase"], r["evidence"], None, i)))

    built = stretched(F.aggregate("ref", none(), step), last)
    combined = made.select("episode_id", F.when(F.col("k") <= 1, F.col("ref")).otherwise(built).alias("segments"))
    empty = samples.groupBy("episode_id").agg(F.max("num_frames").alias("n")).join(modal, "episode_id", "left_anti")
    return combined.union(empty.select("episode_id", F.array(segment(F.lit(0), F.greatest(F.lit(0), F.col("n") - 1), "complete the task"))))


def _moved(segs: Column, choose) -> Column:
    """Ordered pass over the boundaries: choose(a, b) gives a new end for a (the boundary stays if null); the next
    boundary sees the change."""

    def step(out, b):
        a = F.element_at(out, -1)
        new = F.when(F.size(out) > 0, choose(a, b))
        moved = F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(a.withField("end_frame", new), b.withField("start_frame", new + 1)))
        return F.when(new.isNull(), F.concat(out, F.array(b))).otherwise(moved)

    return F.aggregate(segs, none(), step)


def snapped(segs: Column, transitions: Column, window: int = 8) -> Column:
    """Boundaries that begin a grasp go to the nearest closing, those that begin a release to the nearest opening, if
    one lies within ``window`` and strictly inside both segments. ``transitions``: array of (frame_idx, kind), sorted."""

    def choose(a, b):
        ka, kb = contact_kind(a["phase"]), contact_kind(b["phase"])
        kind = F.when((kb == "grasp") & (ka != "grasp"), "close").when((kb == "release") & (ka != "release"), "open")
        near = F.array_sort(F.transform(F.filter(transitions, lambda t: t["kind"] == kind), lambda t: F.struct(F.abs(t["frame_idx"] - a["end_frame"]).alias("d"), t["frame_idx"].cast("int").alias("f"))))
        best = F.get(near, F.lit(0))
        return F.when((best["d"] <= window) & (best["f"] > a["start_frame"]) & (best["f"] < b["end_frame"]), best["f"])

    return _moved(segs, choose)


def refined(segs: Column, answers: Column, window: int, num_frames: Column) -> Column:
    """Boundaries moved to refinement answers (array by boundary, null keeps), inside the window and both segments."""

    def choose(a, b):
        frame = F.get(answers, a["segment_idx"])
        lo, hi = F.greatest(F.lit(0), a["end_frame"] - window), F.least(num_frames - 1, a["end_frame"] + window)
        inside = F.least(F.greatest(lo, frame), hi)
        return F.when(frame.isNotNull(), F.least(F.greatest(a["start_frame"] + 1, inside), b["end_frame"] - 1).cast("int"))

    return _moved(segs, choose)


def subgoals(segs: Column, num_frames: Column) -> Column:
    """(segment_idx, frame_idx): the last frame of each segment, cut to the episode."""
    last = F.greatest(F.lit(0), num_frames - 1)
    return F.transform(segs, lambda s: F.struct(s["segment_idx"].alias("segment_idx"), F.least(F.greatest(s["end_frame"], F.lit(0)), last).cast("int").alias("frame_idx")))


def even_segments(last_frame: Column, n: int) -> Column:
    """n nearly equal (start, end) ranges; edges round half to even."""
    last = F.greatest(last_frame, F.lit(n - 1))
    edge = lambda i: F.bround(i * last / F.lit(float(n)), 0).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(edge(i).alias("start"), F.greatest(edge(i), F.when(i < n - 1, edge(i + 1) - 1).otherwise(last)).cast("int").alias("end")))


def runs(frames: DataFrame, label: str = "phase") -> DataFrame:
    """(episode_id, segment_idx, start_frame, end_frame, label): maximal runs of equal labels along the frames."""
    from pyspark.sql import Window

    w = Window.partitionBy("episode_id").orderBy("frame_idx")
    new = (~F.col(label).eqNullSafe(F.lag(label).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    marked = frames.withColumn("__new", new).withColumn("segment_idx", F.sum("__new").over(w) - 1)
    return marked.groupBy("episode_id", "segment_idx").agg(F.min("frame_idx").alias("start_frame"), F.max("frame_idx").alias("end_frame"), F.first(label).alias(label))


def segment_at(segments: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (episode_id, frame_idx) with the segment that holds the frame."""
    return asked.join(segments, "episode_id", "left").where(F.col("start_frame").isNull() | F.col("frame_idx").between(F.col("start_frame"), F.col("end_frame")))
