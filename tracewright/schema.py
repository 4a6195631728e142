"""The annotations table: one long, versioned, additive format for metadata, segments and subgoals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources.commits import CommitLog, is_log

#: Fixed value of the format.
SCHEMA_VERSION = "annotations/v6"
#: Column names and types in canonical order; fixed values of the format.
COLUMNS = {
    "schema_version": "string", "source": "string", "episode_id": "string", "task": "string", "num_frames": "int", "fps": "double",
    "record_type": "string", "segment_idx": "int", "start_frame": "int", "end_frame": "int", "subtask_text": "string", "phase": "string",
    "target": "string", "boundary_evidence": "string", "active_dof": "string", "quality": "int", "task_success_quality": "int",
    "mistake": "boolean", "boundary_clarity": "string", "control_mode": "string", "control_modality": "string", "reason": "string",
    "speed": "string", "speed_norm": "double", "novelty": "double", "curation_value": "double", "curation_tier": "string",
    "active_frames": "int", "active_seconds": "double", "active_fraction": "double", "subgoal_frame_idx": "int", "subgoal_image_path": "string",
    "retrieved_subgoal_episode_id": "string", "retrieved_subgoal_frame_idx": "int", "provider": "string", "model": "string",
    "strategy": "string", "cost_usd": "double", "receipt_path": "string",
}
METADATA, SUBTASK, SUBGOAL = "episode_metadata", "subtask", "subgoal"
EPISODE_COLUMNS = ["source", "episode_id", "task", "num_frames", "fps", "provider", "model", "strategy"]


def ddl() -> str:
    return ", ".join(f"{c} {t}" for c, t in COLUMNS.items())


def conform(df: DataFrame) -> DataFrame:
    """Canonical columns in order; missing ones null, NaN taken as null, others dropped."""
    have = set(df.columns)

    def one(c: str, t: str):
        if c not in have:
            return F.lit(None).cast(t).alias(c)
        x = F.nanvl(c, F.lit(None).cast("double")) if t == "double" and dict(df.dtypes)[c] in ("double", "float") else F.col(c)
        return x.cast(t).alias(c)

    out = df.select(*(one(c, t) for c, t in COLUMNS.items()))
    return out.withColumn("schema_version", F.coalesce("schema_version", F.lit(SCHEMA_VERSION)))


def rank_of_type():
    return F.when(F.col("record_type") == METADATA, 0).when(F.col("record_type") == SUBTASK, 1).when(F.col("record_type") == SUBGOAL, 2).otherwise(3)


def sort_key() -> list:
    """Canonical order: episode id as a string, record type, segment (none first)."""
    return [F.col("episode_id").cast("string"), rank_of_type(), F.coalesce("segment_idx", F.lit(-1))]


def canonical(df: DataFrame) -> DataFrame:
    return conform(df).orderBy(*sort_key())


def flatten(episodes: DataFrame, metadata: DataFrame | None, segments: DataFrame | None, subgoals: DataFrame | None) -> DataFrame:
    """Annotations from three tables by record type, each with the episode's own columns."""
    own = episodes.select(*[c for c in EPISODE_COLUMNS if c in episodes.columns])
    parts = []
    for df, kind in ((metadata, METADATA), (segments, SUBTASK), (subgoals, SUBGOAL)):
        if df is not None:
            extra = df.drop(*[c for c in own.columns if c != "episode_id"])
            parts.append(conform(own.join(extra, "episode_id").withColumn("record_type", F.lit(kind))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_annotations(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write in canonical order. Enriched tables go to a new path: a table can't be written over while it is read."""
    canonical(df).write.mode(mode).parquet(path)


def append_annotations(df: DataFrame, path: str) -> None:
    """Add episodes; only new rows are written."""
    conform(df).write.mode("append").parquet(path)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Any version of the table, plain files or a commit log; columns it lacks are null."""
    if is_log(spark, path):
        return conform(CommitLog(spark, path).read())
    return conform(spark.read.option("mergeSchema", "true").parquet(path))


def metadata_of(df: DataFrame) -> DataFrame:
    return df.where(F.col("record_type") == METADATA)


def segments_of(df: DataFrame) -> DataFrame:
    return df.where(F.col("record_type") == SUBTASK)


def subgoals_of(df: DataFrame) -> DataFrame:
    return df.where(F.col("record_type") == SUBGOAL)


def episode_view(df: DataFrame) -> DataFrame:
    """One row an episode: task, num_frames, fps, metadata struct, ordered subtasks and subgoals. All episodes at once."""
    seg = ["segment_idx", "start_frame", "end_frame", "subtask_text", "phase", "target", "boundary_evidence", "active_dof"]
    goal = ["segment_idx", "subgoal_frame_idx", "subgoal_image_path", "retrieved_subgoal_episode_id", "retrieved_subgoal_frame_idx"]
    meta = [c for c in COLUMNS if c not in {*EPISODE_COLUMNS, *seg, *goal, "schema_version", "record_type"}]
    is_ = lambda kind: F.col("record_type") == kind
    return df.groupBy("episode_id").agg(
        F.first("task", ignorenulls=True).alias("task"),
        F.max("num_frames").alias("num_frames"),
        F.first("fps", ignorenulls=True).alias("fps"),
        F.first(F.when(is_(METADATA), F.struct(*meta)), ignorenulls=True).alias("metadata"),
        F.array_sort(F.collect_list(F.when(is_(SUBTASK), F.struct(*seg)))).alias("subtasks"),
        F.array_sort(F.collect_list(F.when(is_(SUBGOAL), F.struct(*goal)))).alias("subgoals"),
    )


def episode_ids(df: DataFrame) -> DataFrame:
    """Distinct episode ids with their place in canonical order."""
    return df.groupBy("episode_id").agg(F.min(F.struct(*(c.alias(f"k{i}") for i, c in enumerate(sort_key())))).alias("ord")).orderBy("ord").select("episode_id")
