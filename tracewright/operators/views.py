"""Result sets for inspection and review: projections, episode payloads, galleries, queues and their orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, query_target
from . import metrics
from .ordering import number_rows


def phase_segments(segments: DataFrame, phase: str) -> DataFrame:
    """Segments of a phase, case and edge blanks aside, with their middle frame; a null phase matches nothing."""
    hit = segments.where(F.lower(F.trim("phase")) == phase.strip().lower())
    return hit.select("episode_id", "segment_idx", "phase", query_target(F.col("target")).alias("target"), "start_frame", "end_frame", F.floor((F.col("start_frame") + F.col("end_frame")) / 2).cast("int").alias("mid_frame"))


def viewer_segments(segments: DataFrame) -> DataFrame:
    clean = {c: blank_to_null(F.col(c)) for c in ("phase", "target", "subtask_text", "boundary_evidence")}
    return segments.select("episode_id", "segment_idx", F.col("start_frame").alias("start"), F.col("end_frame").alias("end"), clean["phase"].alias("phase"), clean["target"].alias("target"), clean["subtask_text"].alias("text"), clean["boundary_evidence"].alias("evidence"))


MODULE_FIELDS = ("quality", "speed", "novelty", "curation_value", "curation_tier", "control_modality")


def module_block(metadata: DataFrame) -> DataFrame:
    """The fields of the deterministic modules; numbers to 5 places."""
    kinds = dict(metadata.dtypes)
    return metadata.select("episode_id", *(F.round(F.nanvl(c, F.lit(None).cast("double")), 5).alias(c) if kinds[c] == "double" else F.col(c) for c in MODULE_FIELDS))


def subgoal_block(subgoals: DataFrame) -> DataFrame:
    return subgoals.select("episode_id", "segment_idx", F.col("subgoal_frame_idx").alias("frame_idx"), F.col("retrieved_subgoal_episode_id").alias("retrieved_episode_id"), F.col("retrieved_subgoal_frame_idx").alias("retrieved_frame_idx"))


def enabled_modules(metadata: DataFrame, segments: DataFrame, subgoals: DataFrame) -> DataFrame:
    """(episode_id, modules): which modules an episode's filled fields speak for."""
    seg = segments.groupBy("episode_id").agg(F.count("*").alias("s"))
    goal = subgoals.groupBy("episode_id").agg(F.count("*").alias("g"))
    j = metadata.join(seg, "episode_id", "left").join(goal, "episode_id", "left")
    has = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    filled = lambda c: F.col(c).isNotNull()
    rules = [("segmentation", has("s")), ("quality", filled("quality")), ("speed", filled("speed")), ("subgoals", has("g")), ("control", filled("control_modality")), ("novelty", filled("novelty")), ("curation", filled("curation_value"))]
    return j.select("episode_id", F.array_compact(F.array(*(F.when(p, n) for n, p in rules))).alias("modules"))


def thumb_frames(episodes: DataFrame, subgoals: DataFrame) -> DataFrame:
    """(episode_id, thumb_frame): the first subgoal's frame, else the middle."""
    first = subgoals.groupBy("episode_id").agg(F.min_by("subgoal_frame_idx", F.when(F.col("subgoal_frame_idx").isNotNull(), F.col("segment_idx"))).alias("f"))
    return episodes.join(first, "episode_id", "left").select("episode_id", F.coalesce("f", F.floor(F.col("num_frames") / 2)).cast("int").alias("thumb_frame"))


def episode_payloads(episodes: DataFrame, tracks: DataFrame, flags: DataFrame, gold_track: str = "gold") -> DataFrame:
    """One row an episode: its tracks as ordered segments, metrics per track, flags and the sort keys of the viewer."""
    seg = F.struct("segment_idx", F.col("start_frame").alias("start"), F.col("end_frame").alias("end"))
    per_track = tracks.groupBy("episode_id", "track").agg(F.array_sort(F.collect_list(seg)).alias("segments"))
    packed = per_track.groupBy("episode_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("track", "segments")))).alias("tracks"))
    scores = metrics.track_metrics(tracks, gold_track)
    packed_scores = scores.groupBy("episode_id").agg(F.array_sort(F.collect_list(F.struct("track", "iou", "precision", "recall", "mae"))).alias("metrics"))
    n_flags = flags.groupBy("episode_id").agg(F.count("*").alias("n_flags"), F.array_sort(F.collect_set("check")).alias("checks"))
    out = episodes.withColumn("episode_id", F.col("episode_id").cast("string"))
    for df in (packed, packed_scores, metrics.min_iou(scores), n_flags):
        out = out.join(df.withColumn("episode_id", F.col("episode_id").cast("string")), "episode_id", "left")
    return out.withColumns({"sort_iou": F.coalesce("sort_iou", F.lit(1.0)), "n_flags": F.coalesce("n_flags", F.lit(0).cast("long"))})


def gallery_id(task: Column | str = "task", episode: Column | str = "episode_id") -> Column:
    return F.concat_ws("::", task, episode)


def merge_galleries(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """Payloads of several tasks as one, ids prefixed by the task, in the order given."""
    out = None
    for i, (task, df) in enumerate(parts):
        named = df.withColumns({"task_name": F.lit(task), "task_ord": F.lit(i), "source_episode_id": F.col("episode_id").cast("string")})
        named = named.withColumn("episode_id", gallery_id("task_name", "source_episode_id"))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    return out


def track_names(tracks: DataFrame) -> DataFrame:
    """(track, ord): track names by where they are first seen."""
    return tracks.groupBy("track").agg(F.min("ord").alias("ord"))


SPEED_RANK = {"slow": 0, "medium": 1, "fast": 2}


def view_order(df: DataFrame, by: str = "id", grouped: bool = False) -> list[Column]:
    """Viewer orders: id (numbers by value first), iou ascending, flags, quality, novelty, value or speed descending;
    unknown last, ids break ties."""
    number = F.expr("try_cast(episode_id as bigint)")
    ids = [number.asc_nulls_last(), F.col("episode_id")]
    speed = F.lit(-1)
    for name, rank in SPEED_RANK.items():
        speed = F.when(F.col("speed") == name, rank).otherwise(speed) if "speed" in df.columns else speed
    keys = {"id": [], "iou": lambda: [F.col("sort_iou").asc_nulls_last()], "flags": lambda: [F.col("n_flags").desc_nulls_last()], "quality": lambda: [F.col("quality").desc_nulls_last()], "novelty": lambda: [F.col("novelty").desc_nulls_last()], "value": lambda: [F.col("curation_value").desc_nulls_last()], "speed": lambda: [speed.desc()]}[by]
    return [*([F.col("task_ord")] if grouped else []), *(keys() if callable(keys) else keys), *ids]


def sorted_view(df: DataFrame, by: str = "id", grouped: bool = False) -> DataFrame:
    return df.orderBy(*view_order(df, by, grouped))


def placed_view(df: DataFrame, by: str = "id", grouped: bool = False) -> DataFrame:
    """``df`` with place, from 1, in a viewer order; pages are then filters on place."""
    return number_rows(df, view_order(df, by, grouped), "place")


#: The column that an order reads beside ids and tasks.
VIEW_KEYS = {"id": None, "iou": "sort_iou", "flags": "n_flags", "quality": "quality", "novelty": "novelty", "value": "curation_value", "speed": "speed"}


def places(df: DataFrame, by: str = "id", grouped: bool = False) -> DataFrame:
    """(place, episode_id) of ``placed_view``; only columns of the order travel."""
    keys = ["episode_id", *(["task_ord"] if grouped else []), *([VIEW_KEYS[by]] if VIEW_KEYS[by] in df.columns else [])]
    return placed_view(df.select(*keys), by, grouped).select("place", "episode_id")


def filtered_gallery(df: DataFrame, task: str | None = None, tier: str | None = None) -> DataFrame:
    if task:
        df = df.where(F.col("task_name") == task)
    return df.where(F.col("curation_tier") == tier) if tier else df


def queue(payloads: DataFrame, grades: DataFrame | None = None, only: str = "all") -> DataFrame:
    """Episodes to look at: flagged, ungraded or all."""
    if only == "flagged":
        return payloads.where("n_flags > 0")
    if only == "ungraded" and grades is not None:
        return payloads.join(grades.select(F.col("item_id").alias("episode_id")), "episode_id", "left_anti")
    return payloads
