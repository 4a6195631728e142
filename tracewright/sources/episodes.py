"""Readers of episodes, frames and their side files; each gives DataFrames, pixels stay binary."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import control_modality
from ..operators.signals import number_frames

IMAGES, VIDEOS = "png jpg jpeg bmp".split(), "mp4 mov mkv avi".split()


def image_frames(spark: SparkSession, root: str) -> DataFrame:
    """(episode_id, frame_idx, path, content): images below one folder an episode, numbered by name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(IMAGES + [x.upper() for x in IMAGES]) + "}").load(root)
    parts = F.split("path", "/")
    rows = files.select(F.element_at(parts, -2).alias("episode_id"), F.element_at(parts, -1).alias("name"), "path", "content")
    return number_frames(rows, ["name"]).drop("name")


def image_episodes(spark: SparkSession, root: str, fps: float = 10.0, side: DataFrame | None = None) -> DataFrame:
    """(episode_id, task, num_frames, fps); file contents are not read. Side data overrides task and fps."""
    n = image_frames(spark, root).drop("content").groupBy("episode_id").agg(F.count("*").cast("int").alias("num_frames"))
    return with_side(n, fps, default_side(spark, root) if side is None else side)


def video_episodes(spark: SparkSession, root: str, fps: float = 10.0, side: DataFrame | None = None) -> DataFrame:
    """(episode_id, path, task, fps) of video files; the id is the file's stem. Frames need a decoder, see ``decode``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(VIDEOS) + "}").load(root).drop("content")
    rows = files.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("episode_id"), "path", F.lit(None).cast("int").alias("num_frames"))
    return with_side(rows, fps, default_side(spark, root) if side is None else side)


def with_side(episodes: DataFrame, fps: float, side: DataFrame | None) -> DataFrame:
    if side is None:
        return episodes.withColumns({"task": F.lit(None).cast("string"), "fps": F.lit(float(fps))})
    return episodes.join(side, "episode_id", "left").withColumn("fps", F.coalesce("fps", F.lit(float(fps))))


def side_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(episode_id, task, fps) of JSON-lines files, read line by line; the last line of an episode wins."""
    lines = spark.read.text(path).select(F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row")).alias("line"), "value")
    rows = lines.select("line", F.from_json("value", "episode_id string, task string, fps double").alias("r")).where("r.episode_id is not null")
    last = rows.groupBy("r.episode_id").agg(F.max_by("r", "line").alias("r"))
    return last.select("episode_id", "r.task", "r.fps")


def default_side(spark: SparkSession, root: str) -> DataFrame | None:
    """Side data of a folder: of its episodes.jsonl, or else of its tasks.jsonl, or None."""
    there = spark.read.format("binaryFile").option("pathGlobFilter", "{episodes,tasks}.jsonl").load(root).select("path").limit(2).collect()
    first = min((r["path"] for r in there), default=None)
    return None if first is None else side_metadata(spark, first)


def decode(frames: DataFrame) -> DataFrame:
    """Add height, width and gray (row-major doubles) to (.., content), decoded in Arrow batches. Needs an image library
    on the executors; without it the call fails at once."""
    import io

    import pandas as pd
    from PIL import Image  # optional

    kept = [c for c in frames.columns if c != "content"]

    def run(batches):
        import numpy as np

        for pdf in batches:
            arrays = [np.asarray(Image.open(io.BytesIO(c)).convert("RGB"), np.float64).mean(axis=2) for c in pdf["content"]]
            yield pdf[kept].assign(height=[a.shape[0] for a in arrays], width=[a.shape[1] for a in arrays], gray=pd.Series([a.ravel() for a in arrays], dtype=object))

    kinds = ", ".join(f"`{n}` {t}" for n, t in frames.select(kept).dtypes)
    return frames.mapInPandas(run, f"{kinds}, height int, width int, gray array<double>")


def episode_files(spark: SparkSession, root: str, below: str = "data") -> DataFrame:
    """(path, first, last, rows): which episodes each parquet file of a dataset may hold, from footers alone. Files without
    statistics may hold any (nulls)."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{root}/{below}").select("path")

    def footers(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs

        for batch in batches:
            out = []
            for path in batch.column("path").to_pylist():
                files, at = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
                with files.open_input_file(at) as f:
                    meta = pq.ParquetFile(f).metadata
                place = next((i for i in range(meta.num_columns) if meta.schema.column(i).path == "episode_index"), None)
                stats = [meta.row_group(i).column(place).statistics for i in range(meta.num_row_groups)] if place is not None else []
                known = stats and all(x is not None and x.has_min_max for x in stats)
                out.append((path, min(x.min for x in stats) if known else None, max(x.max for x in stats) if known else None, meta.num_rows))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["path", "first", "last", "rows"])

    return listed.mapInArrow(footers, "path string, first long, last long, rows long")


def frame_files(spark: SparkSession, root: str, episodes: list[int] | None = None) -> DataFrame:
    """Rows of data/**/*.parquet, of the episodes of a list if there is one: only files that may hold them are opened, of these
    only row groups that may. Columns are those of one file."""
    everything = spark.read.option("recursiveFileLookup", "true")
    if episodes is None:
        return everything.parquet(f"{root}/data")
    wanted = sorted(set(episodes))
    holds = F.exists(F.array(*map(F.lit, wanted)).cast("array<long>"), lambda e: e.between(F.col("first"), F.col("last"))) if wanted else F.lit(False)
    paths = [r["path"] for r in episode_files(spark, root).where(holds | F.col("first").isNull() & F.lit(bool(wanted)) & (F.col("rows") > 0)).select("path").collect()]
    rows = spark.read.parquet(*paths) if paths else everything.parquet(f"{root}/data").where("false")
    return rows.where(F.col("episode_index").isin(wanted)) if wanted else rows


def vector_frames(spark: SparkSession, root: str, column: str = "action", episodes: list[int] | None = None) -> DataFrame:
    """(episode_id, frame_idx, action) of all data/**/*.parquet; an episode list chooses files, row groups and rows.

    Stays long: no grouping, no ordering until an operator asks for it.
    """
    rows = frame_files(spark, root, episodes)
    return rows.select(F.col("episode_index").cast("string").alias("episode_id"), F.col("frame_index").cast("int").alias("frame_idx"), F.transform(F.col(f"`{column}`"), lambda x: x.cast("double")).alias("action"))


def dataset_episodes(spark: SparkSession, root: str, episodes: list[int] | None = None) -> DataFrame:
    """(episode_id, task, num_frames, fps) from meta/episodes parquet with dataset_from_index, dataset_to_index.

    The task is the first of ``tasks``, or ``task``; an episode that has neither takes that of its first frame.
    """
    rows = spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/meta/episodes")
    if episodes is not None:
        rows = rows.where(F.col("episode_index").isin(episodes))
    kinds = dict(rows.dtypes)
    given = [F.get(F.col(c), F.lit(0)) if kinds[c].startswith("array") else F.col(c).cast("string") for c in ("tasks", "task") if c in kinds]
    task = F.nullif(F.trim(F.coalesce(*given)), F.lit("")) if given else F.lit(None).cast("string")
    fps = float(dataset_info(root).get("fps", 30.0))
    out = rows.select(F.col("episode_index").cast("string").alias("episode_id"), task.alias("task"), (F.col("dataset_to_index") - F.col("dataset_from_index")).cast("int").alias("num_frames"), F.lit(fps).alias("fps"))
    if (first := first_frame_tasks(spark, root, episodes)) is None:
        return out
    return out.join(first, "episode_id", "left").select("episode_id", F.coalesce("task", "__first").alias("task"), "num_frames", "fps")


def first_frame_tasks(spark: SparkSession, root: str, episodes: list[int] | None = None) -> DataFrame | None:
    """(episode_id, __first): the task text that the first frame of each episode states; None if frames have no such column.
    An episode list chooses files as for ``vector_frames``."""
    frames = frame_files(spark, root, episodes)
    if "task" not in frames.columns:
        return None
    return frames.groupBy(F.col("episode_index").cast("string").alias("episode_id")).agg(F.min_by("task", "frame_index").alias("__first"))


def camera_key(info: dict, wanted: str | None = None) -> str:
    """The feature that holds a dataset's images: the one wanted, or the first."""
    cameras = [name for name, f in info.get("features", {}).items() if f.get("dtype") in ("image", "video")]
    if not cameras:
        raise ValueError("the dataset has no camera feature")
    if wanted is not None and wanted not in cameras:
        raise ValueError(f"no camera {wanted!r}; the dataset has {', '.join(cameras)}")
    return wanted or cameras[0]


def camera_frames(spark: SparkSession, root: str, wanted: str | None = None) -> DataFrame:
    """(episode_id, frame_idx, content) of the images that data/**/*.parquet holds; content is null for images kept as video."""
    key = camera_key(dataset_info(root), wanted)
    rows = spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true").parquet(f"{root}/data")
    image = F.col(f"`{key}`.bytes") if key in rows.columns and dict(rows.dtypes)[key].startswith("struct") else F.col(f"`{key}`") if key in rows.columns else F.lit(None)
    return rows.select(F.col("episode_index").cast("string").alias("episode_id"), F.col("frame_index").cast("int").alias("frame_idx"), image.cast("binary").alias("content"))


def dataset_info(root: str) -> dict:
    """meta/info.json of a dataset; small, read by the driver."""
    return json.loads((Path(root) / "meta" / "info.json").read_text(encoding="utf-8"))


def feature_names(info: dict, column: str = "action") -> list[str] | None:
    """Names of a vector's dimensions; names nested in a map are unwrapped."""
    names = info.get("features", {}).get(column, {}).get("names")
    if isinstance(names, dict):
        names = next((v for v in names.values() if isinstance(v, list)), None)
    return [str(n) for n in names] if names else None


def detect(spark: SparkSession, info: dict) -> dict:
    """Parameters read off a dataset: fps, action names, control space."""
    names = feature_names(info)
    space = spark.range(1).select(control_modality(F.lit(names).cast("array<string>") if names else F.lit(None).cast("array<string>")).alias("m")).first()["m"]
    return {"fps": info.get("fps"), "action_names": names, "control_space": space, "robot_type": info.get("robot_type")}


def detect_directory(config_path: str | None, fps: float = 10.0) -> dict:
    """Parameters of a directory source from an explicit JSON file."""
    c = json.loads(Path(config_path).read_text(encoding="utf-8")) if config_path else {}
    return {"fps": fps, "action_names": c.get("action_names"), "control_space": c.get("control_space"), "arm_dims": c.get("arm_dims"), "gripper_dims": c.get("gripper_dims"), "phase_vocabulary": c.get("phase_vocabulary")}


def synthetic(spark: SparkSession, n_episodes: int = 3, num_frames: int = 24, fps: float = 10.0, n_dims: int = 7) -> tuple[DataFrame, DataFrame]:
    """(episodes, frames): a generated source; dimensions move linearly, the last one closes half-way."""
    episodes = spark.range(n_episodes).select(F.format_string("synthetic_%02d", "id").alias("episode_id"), F.lit("move the square to the corner").alias("task"), F.lit(num_frames).alias("num_frames"), F.lit(float(fps)).alias("fps"))
    rows = episodes.select("episode_id", F.explode(F.sequence(F.lit(0), F.lit(num_frames - 1))).alias("frame_idx"))
    moving = F.transform(F.sequence(F.lit(1), F.lit(n_dims - 1)), lambda d: F.col("frame_idx") * d / float(num_frames))
    grip = F.array(F.when(F.col("frame_idx") >= num_frames // 2, 1.0).otherwise(0.0))
    return episodes, rows.withColumn("action", F.concat(moving, grip))


def first_episodes(episodes: DataFrame, n: int | None) -> DataFrame:
    """The first n episodes in canonical order."""
    return episodes if n is None else episodes.orderBy(F.col("episode_id").cast("string")).limit(n)


SOURCES = {"dataset": dataset_episodes, "images": image_episodes, "videos": video_episodes, "synthetic": lambda spark, target=None, **k: synthetic(spark, **k)[0]}


def build_source(spark: SparkSession, kind: str, target: str | None = None, **options) -> DataFrame:
    """Episodes of a registered kind of source."""
    if kind not in SOURCES:
        raise ValueError(f"unknown source {kind!r}; use one of {', '.join(SOURCES)}")
    return SOURCES[kind](spark, target, **options)
