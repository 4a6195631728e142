"""Exports: phrase vocabulary, dense frame labels, per-episode lists, JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import METADATA, SUBGOAL, SUBTASK
from ..storage import materialize
from .intervals import interval_join
from .ordering import number_rows


def phrase(field: str = "subtask_text") -> Column:
    """The phrase of a segment: the field, else its text, else its phase, trimmed; null if all are blank."""
    text = F.coalesce(F.col(field), F.nullif(F.col("subtask_text"), F.lit("")), F.nullif(F.col("phase"), F.lit("")), F.lit(""))
    return F.nullif(F.trim(text), F.lit(""))


def vocabulary(segments: DataFrame, field: str = "subtask_text") -> DataFrame:
    """(phrase, subtask_index): distinct phrases numbered from 0 by where they are first seen, episodes as strings."""
    first = segments.select(phrase(field).alias("phrase"), F.struct(F.col("episode_id").cast("string").alias("e"), F.col("segment_idx").alias("s")).alias("o")).where("phrase is not null").groupBy("phrase").agg(F.min("o").alias("o"))
    return number_rows(first, ["o", "phrase"], "subtask_index", 0).select("phrase", F.col("subtask_index").cast("int").alias("subtask_index"))


def frame_indices(segments: DataFrame, episodes: DataFrame, field: str = "subtask_text") -> DataFrame:
    """(episode_id, frame_idx, subtask_index) for every frame: the last segment that holds it, 0 if none does.

    Episodes are cut where a segment begins or ends; a piece has one label throughout. Pieces find their segment and become
    frames at the end, so no frame is shuffled.
    """
    n = F.col("num_frames") - 1
    named = segments.withColumn("phrase", phrase(field)).where("phrase is not null").join(vocabulary(segments, field), "phrase")
    spans = named.join(episodes.select("episode_id", "num_frames"), "episode_id").select(
        "episode_id", "segment_idx", "subtask_index", F.greatest(F.lit(0), F.coalesce("start_frame", F.lit(0))).alias("a"), F.least(n, F.coalesce("end_frame", n)).alias("b")
    ).where("a <= b")
    spans = materialize(spans, "spans")
    held = episodes.where("num_frames > 0").select("episode_id", F.col("num_frames").cast("int").alias("n"))
    cuts = spans.select("episode_id", F.explode(F.array("a", F.col("b") + 1)).alias("c")).join(held, "episode_id").where("c < n")
    cuts = cuts.union(held.select("episode_id", F.lit(0), "n")).dropDuplicates(["episode_id", "c"])
    end = F.coalesce(F.lead("c").over(Window.partitionBy("episode_id").orderBy("c")), F.col("n")) - 1
    pieces = materialize(cuts.select("episode_id", F.col("c").cast("int").alias("c"), end.cast("int").alias("end")), "pieces")
    met = interval_join(pieces.select("episode_id", "c"), spans, ["episode_id"], "c", "a", "b")
    label = met.groupBy("episode_id", "c").agg(F.max_by("subtask_index", "segment_idx").alias("subtask_index"))
    every = pieces.join(label, ["episode_id", "c"], "left").withColumn("subtask_index", F.coalesce("subtask_index", F.lit(0)))
    return every.select("episode_id", F.explode(F.sequence("c", "end")).alias("frame_idx"), "subtask_index")


def fps_or_default(fps: Column) -> Column:
    return F.coalesce(F.nullif(F.nanvl(fps.cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(30.0))


def episode_lists(segments: DataFrame, episodes: DataFrame, field: str = "subtask_text") -> DataFrame:
    """One row an episode with parallel lists: indices, names, start and end frames and times (4 places)."""
    named = segments.withColumn("phrase", F.coalesce(phrase(field), F.lit(""))).join(vocabulary(segments, field), "phrase", "left")
    row = F.struct("segment_idx", F.coalesce("subtask_index", F.lit(0)).alias("i"), F.col("phrase").alias("n"), F.coalesce("start_frame", F.lit(0)).alias("a"), F.coalesce("end_frame", F.lit(0)).alias("b"))
    per = named.groupBy("episode_id").agg(F.array_sort(F.collect_list(row)).alias("r"))
    fps = fps_or_default(F.col("fps"))
    take = lambda f: F.transform("r", lambda x: x[f])
    time = lambda f: F.transform("r", lambda x: F.round(x[f] / fps, 4))
    out = episodes.select("episode_id", "fps").join(per, "episode_id", "left").withColumn("r", F.coalesce("r", F.array().cast(dict(per.dtypes)["r"])))
    return out.select(
        "episode_id", F.expr("try_cast(episode_id as bigint)").alias("episode_index"), take("i").alias("subtask_indices"), take("n").alias("subtask_names"),
        take("a").alias("subtask_start_frames"), take("b").alias("subtask_end_frames"), time("a").alias("subtask_start_times"), time("b").alias("subtask_end_times"),
    )


def write_subtask_export(segments: DataFrame, episodes: DataFrame, path: str, field: str = "subtask_text") -> None:
    """meta/subtasks and meta/episodes_subtasks below ``path``."""
    vocabulary(segments, field).write.parquet(f"{path}/meta/subtasks")
    episode_lists(segments, episodes, field).write.parquet(f"{path}/meta/episodes_subtasks")


def json_lines(annotations: DataFrame) -> DataFrame:
    """(episode_id, json): one object an episode with ordered subtasks and subgoals, keys sorted, nulls written."""
    is_ = lambda kind: F.col("record_type") == kind
    sub = F.struct("segment_idx", "active_dof", "end_frame", "start_frame", "subtask_text")
    goal = F.struct("segment_idx", F.col("subgoal_frame_idx").alias("frame_idx"), F.col("subgoal_image_path").alias("image_path"))
    m = lambda c: F.first(F.when(is_(METADATA), F.col(c)), ignorenulls=True).alias(c)
    e = lambda c: F.first(c, ignorenulls=True).alias(c)
    per = annotations.groupBy("episode_id").agg(
        m("boundary_clarity"), m("control_modality"), m("control_mode"), m("cost_usd"), e("fps"), m("mistake"), e("model"), e("num_frames"), e("provider"), m("quality"), m("reason"),
        e("schema_version"), e("source"), F.array_sort(F.collect_list(F.when(is_(SUBGOAL), goal))).alias("subgoals"), F.array_sort(F.collect_list(F.when(is_(SUBTASK), sub))).alias("subtasks"),
        e("task"), m("task_success_quality"),
    )
    return per.select("episode_id", F.to_json(F.struct(*sorted(per.columns)), {"ignoreNullFields": "false"}).alias("json"))


def write_json_lines(annotations: DataFrame, path: str) -> None:
    json_lines(annotations).orderBy(F.col("episode_id").cast("string")).select("json").write.text(path)
