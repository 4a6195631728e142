"""The supplied tables in the shapes of the engine: events as frames, conversations and orders as segments, and so on."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.signals import number_frames


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def frames(spark: SparkSession, d: str) -> DataFrame:
    """users as episodes, events in time as frames, the value as the only dimension."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("episode_id"), "ts", "event_id", "value", "event_type")
    return number_frames(rows, ["ts", "event_id"]).select("episode_id", "frame_idx", F.array("value").alias("action"), F.col("event_type").alias("phase"), "event_id")


def frames_2d(spark: SparkSession, d: str) -> DataFrame:
    """A second dimension beside: the event number modulo 7."""
    return frames(spark, d).withColumn("action", F.concat("action", F.array((F.col("event_id") % 7).cast("double"))))


def blocks(spark: SparkSession, d: str, size: int = 12) -> DataFrame:
    """Segments of 12 frames."""
    rows = frames(spark, d).groupBy("episode_id", F.floor(F.col("frame_idx") / size).alias("segment_idx")).agg(F.min("frame_idx").alias("start_frame"), F.max("frame_idx").alias("end_frame"))
    return rows.withColumn("segment_idx", F.col("segment_idx").cast("int"))


def conversations(spark: SparkSession, d: str) -> DataFrame:
    """Turns as segments: their text, the role as phase, frames by running length of the text."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    end = F.sum(F.length("text")).over(w)
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("episode_id"), F.col("turn").cast("int").alias("segment_idx"), (end - F.length("text")).cast("int").alias("start_frame"), (end - 1).cast("int").alias("end_frame"),
        F.col("text").alias("subtask_text"), F.col("role").alias("phase"), F.lit(None).cast("string").alias("target"),
    )


def conversation_episodes(spark: SparkSession, d: str) -> DataFrame:
    segs = conversations(spark, d)
    return segs.groupBy("episode_id").agg((F.max("end_frame") + 1).cast("int").alias("num_frames")).withColumns({"fps": F.lit(10.0), "task": F.lit("talk")})


def even_tracks(spark: SparkSession, d: str) -> DataFrame:
    """As many equal segments as each conversation has turns, over the same frames."""
    w = Window.partitionBy("episode_id")
    segs = conversations(spark, d).withColumns({"n": F.count("*").over(w), "last": F.max("end_frame").over(w), "k": F.row_number().over(w.orderBy("segment_idx")) - 1})
    start, end = F.floor(F.col("k") * (F.col("last") + 1) / F.col("n")), F.floor((F.col("k") + 1) * (F.col("last") + 1) / F.col("n")) - 1
    return segs.select("episode_id", "segment_idx", start.cast("int").alias("start_frame"), end.cast("int").alias("end_frame"))


def order_segments(spark: SparkSession, d: str) -> DataFrame:
    """Customers as episodes, orders as segments whose length is the price in whole units."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    length = F.floor("o_totalprice").cast("long")
    end = F.sum(length).over(w)
    return table(spark, d, "orders").select(F.col("o_custkey").alias("episode_id"), (F.row_number().over(w) - 1).alias("segment_idx"), (end - length).alias("start_frame"), (end - 1).alias("end_frame"), F.col("o_orderpriority").alias("subtask_text"))


def scores(spark: SparkSession, d: str) -> DataFrame:
    """Documents as episodes with quality 1 or 5 from labels (null without), length as novelty, the text as reason."""
    lab = table(spark, d, "labels").select("doc_id", (1 + 4 * F.col("quality")).alias("quality"), (F.col("toxic") == 1).alias("mistake"))
    docs = table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("novelty"), F.col("text").alias("reason"), "lang", "source")
    return docs.join(lab, "doc_id", "left").withColumnRenamed("doc_id", "episode_id").withColumn("task_success_quality", F.lit(None).cast("int"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("episode_id"), F.lit(0).alias("frame_idx"), "embedding", "label")


def clip_file(frames: list[bytes], scale: int = 600, step: int = 60, every: int = 5) -> bytes:
    """A minimal MP4 file whose frames are any bytes: the data, then one video track's tables; every n-th frame is a key."""
    box = lambda kind, *body: struct.pack(">I4s", 8 + sum(map(len, body)), kind) + b"".join(body)
    table = lambda kind, *numbers: box(kind, bytes(4), struct.pack(f">{len(numbers)}I", *numbers))
    n, start, keys = len(frames), box(b"ftyp", b"isom"), range(1, len(frames) + 1, every)
    tables = box(
        b"stbl", table(b"stts", 1, n, step), table(b"stss", len(keys), *keys), table(b"stsc", 1, 1, n, 1), table(b"stsz", 0, n, *map(len, frames)), table(b"stco", 1, len(start) + 8)
    )
    head, kind = table(b"mdhd", 0, 0, scale, n * step, 0), box(b"hdlr", bytes(8), b"vide", bytes(13))
    return start + box(b"mdat", *frames) + box(b"moov", box(b"trak", box(b"mdia", head, kind, box(b"minf", tables))))
