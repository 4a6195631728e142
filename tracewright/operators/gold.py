"""Human labels beside model labels: template, synchronisation, edits, review order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ordering import with_neighbours

#: Fixed values of the format.
GOLD_VERSION = "gold/v1"
AUTO_SEG = "array<struct<segment_idx:int,start_frame:int,end_frame:int,subtask_text:string>>"
AUTO_META = "struct<quality:int,task_success_quality:int,mistake:boolean,boundary_clarity:string,reason:string>"
AUTO_GOAL = "array<struct<segment_idx:int,frame_idx:int>>"
GOLD_SEG = "array<struct<segment_idx:int,start_frame:int,end_frame:int,subtask_text:string,accept_auto:boolean>>"
GOLD_META = "struct<quality:int,mistake:boolean,reason:string,accept_auto:boolean>"
GOLD_GOAL = "array<struct<segment_idx:int,frame_idx:int,accept_auto:boolean>>"
EPISODE = f"struct<episode_id:string,task:string,num_frames:int,auto:struct<subtasks:{AUTO_SEG},metadata:{AUTO_META},subgoals:{AUTO_GOAL}>,gold:struct<subtasks:{GOLD_SEG},metadata:{GOLD_META},subgoals:{GOLD_GOAL}>,review_notes:string>"


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """A gold JSON file as one row an episode."""
    return spark.read.schema(f"schema_version string, episodes array<{EPISODE}>").json(path, multiLine=True).select(F.inline("episodes"))


def template(view: DataFrame) -> DataFrame:
    """Gold table of an episode view: model labels filled in, human labels empty."""
    no = F.lit(None)
    seg = F.transform("subtasks", lambda s: F.struct(s["segment_idx"].alias("segment_idx"), s["start_frame"].alias("start_frame"), s["end_frame"].alias("end_frame"), s["subtask_text"].alias("subtask_text")))
    goal = F.transform("subgoals", lambda s: F.struct(s["segment_idx"].alias("segment_idx"), s["subgoal_frame_idx"].alias("frame_idx")))
    meta = F.struct(*(F.col("metadata")[c].alias(c) for c in ("quality", "task_success_quality", "mistake", "boundary_clarity", "reason")))
    gseg = F.transform("subtasks", lambda s: F.struct(s["segment_idx"].alias("segment_idx"), no.cast("int").alias("start_frame"), no.cast("int").alias("end_frame"), no.cast("string").alias("subtask_text"), no.cast("boolean").alias("accept_auto")))
    ggoal = F.transform("subgoals", lambda s: F.struct(s["segment_idx"].alias("segment_idx"), no.cast("int").alias("frame_idx"), no.cast("boolean").alias("accept_auto")))
    return view.select(
        "episode_id", "task", "num_frames",
        F.struct(seg.cast(AUTO_SEG).alias("subtasks"), meta.cast(AUTO_META).alias("metadata"), goal.cast(AUTO_GOAL).alias("subgoals")).alias("auto"),
        F.struct(gseg.cast(GOLD_SEG).alias("subtasks"), no.cast(GOLD_META).alias("metadata"), ggoal.cast(GOLD_GOAL).alias("subgoals")).alias("gold"),
        F.lit("").alias("review_notes"),
    )


def synchronise(fresh: DataFrame, existing: DataFrame) -> DataFrame:
    """Fresh template with the human labels kept; episodes that are no longer annotated go."""
    old = existing.select("episode_id", F.col("gold").alias("__gold"), F.col("review_notes").alias("__notes"))
    joined = fresh.join(old, "episode_id", "left")
    return joined.withColumns({"gold": F.coalesce("__gold", "gold"), "review_notes": F.coalesce("__notes", "review_notes")}).drop("__gold", "__notes")


def _apply(targets: Column, updates: Column, fields: tuple[str, ...]) -> Column:
    """Fields of the update with the same segment_idx, where the update has them (a map from field to text)."""

    def one(t):
        u = F.get(F.filter(F.coalesce(updates, F.array().cast("array<struct<segment_idx:int,fields:map<string,string>>>")), lambda x: x["segment_idx"] == t["segment_idx"]), F.lit(0))["fields"]
        out = t
        for f in fields:
            kind = {"subtask_text": "string", "accept_auto": "boolean"}.get(f, "int")
            out = out.withField(f, F.when(F.coalesce(F.map_contains_key(u, f), F.lit(False)), F.element_at(u, f).cast(kind)).otherwise(t[f]))
        return out

    return F.transform(targets, one)


def update_reviews(gold: DataFrame, edits: DataFrame) -> DataFrame:
    """Upsert of edits (episode_id, quality, mistake, reason, accept_auto_metadata, subtasks, subgoals, review_notes).

    Quality is cut to 1..5; a null mistake takes the model's; null reason and notes keep what is there; subtasks and
    subgoals are arrays of (segment_idx, fields map) that change only fields they name. One edit an episode.
    """
    e = edits.select("episode_id", *(F.col(c).alias(f"__{c}") for c in edits.columns if c != "episode_id"), F.lit(True).alias("__hit"))
    j = gold.join(e, "episode_id", "left")
    old = F.col("gold.metadata")
    meta = F.struct(
        F.coalesce(F.when(F.col("__quality").isNotNull(), F.greatest(F.lit(1), F.least(F.lit(5), "__quality"))), old["quality"]).cast("int").alias("quality"),
        F.coalesce("__mistake", F.col("auto.metadata.mistake")).alias("mistake"), F.coalesce("__reason", old["reason"]).alias("reason"), F.coalesce("__accept_auto_metadata", F.lit(False)).alias("accept_auto"),
    )
    new = F.struct(
        _apply(F.col("gold.subtasks"), F.col("__subtasks"), ("start_frame", "end_frame", "subtask_text", "accept_auto")).alias("subtasks"), meta.alias("metadata"),
        _apply(F.col("gold.subgoals"), F.col("__subgoals"), ("frame_idx", "accept_auto")).alias("subgoals"),
    )
    out = j.withColumns({"gold": F.when(F.col("__hit"), new).otherwise(F.col("gold")), "review_notes": F.when(F.col("__hit"), F.coalesce("__review_notes", "review_notes")).otherwise(F.col("review_notes"))})
    return out.select(*gold.columns)


def is_reviewed() -> Column:
    """A human gave the episode a quality."""
    return F.col("gold.metadata.quality").isNotNull()


def review_state(gold: DataFrame) -> DataFrame:
    return gold.agg(F.count("*").alias("episode_count"), F.count_if(is_reviewed()).alias("reviewed_count"))


def review_order(entries: DataFrame) -> DataFrame:
    """entries (episode_id, ord, reviewed) with previous, following (both around the end) and the next unreviewed
    episode after each (around the end, itself last; null if there is none)."""
    own, unreviewed = F.col("episode_id"), F.when(~F.col("reviewed"), F.col("episode_id"))
    return with_neighbours(entries.select("episode_id", "ord", "reviewed"), ["ord", "episode_id"], True, previous=(-1, own), following=(1, own), next_unreviewed=(1, unreviewed))
