"""Queries that write the supplied tables as files of the engine's formats and read them back by its sources and sinks."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..sources import containers, raster
from ..sources import episodes as src
from ..sources.commits import CommitLog
from ..storage import scratch_dir
from . import providers
from . import stand_ins as s
from .catalog import CONV, _annotations, query


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _clips(spark: SparkSession, d: str) -> DataFrame:
    """(path, content): a video file a conversation, its turns' texts as frames, the first of each five standing alone."""
    turns = s.table(spark, d, "conversations").select("conv_id", "turn", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("frame"))

    def clip(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("turn")
        return pd.DataFrame({"path": [f"{pdf['conv_id'].iloc[0]}.mp4"], "content": [s.clip_file([bytes(x) for x in pdf["frame"]])]})

    return turns.groupBy("conv_id").applyInPandas(clip, "path string, content binary")


@query("""select conv_id::varchar as episode_id, row_number() over (partition by conv_id order by turn) - 1 as frame_idx, round((row_number() over (partition by conv_id order by turn) - 1) / 10.0::double, 4) as time,
  strlen(text)::bigint as size, (row_number() over (partition by conv_id order by turn) - 1) % 5 = 0 as key, md5(text) as digest from conversations""")
def container_frames(spark, d):
    """Conversations as video files: their index, and the bytes of every frame by its range."""
    path = _fresh(spark, "clips")
    raster.write_pictures(_clips(spark, d), path)
    entries = containers.container_index(spark, path)
    return containers.frame_bytes(entries, path).select("episode_id", "frame_idx", F.round("time", 4).alias("time"), "size", "key", F.md5("content").alias("digest"))


_PIXEL = "greatest(0, least(255, floor(x::double * 64 + 128)))"


@query(f"select vec_id, 8::bigint as height, 8::bigint as width, list_sum(list_transform(embedding, lambda x: {_PIXEL}))::bigint as gray, md5(list_aggregate(list_transform(embedding, lambda x: {_PIXEL}::int::varchar), 'string_agg', ',')) as digest from embeddings")
def pictures_read_back(spark, d):
    """Embeddings drawn as gray pictures, half of them PNG and half BMP, written and read back pixel by pixel."""
    path = _fresh(spark, "pictures")
    pixel = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(x.cast("double") * 64 + 128))).cast("int")
    rows = s.table(spark, d, "embeddings").select("vec_id", F.transform("embedding", pixel).alias("values"), F.lit(8).alias("height"), F.lit(8).alias("width"))
    for kind, own in (("png", "vec_id % 2 = 0"), ("bmp", "vec_id % 2 <> 0")):  # both halves: all rows
        made = raster.encode_pictures(rows.where(own), kind)
        raster.write_pictures(made.select(F.concat_ws(".", F.col("vec_id").cast("string"), F.lit(kind)).alias("path"), "content"), path)
    got = raster.decode_pictures(raster.read_pictures(spark, path))
    byte = lambda i: F.conv(F.hex(F.substring("rgb", 3 * i + 1, 1)), 16, 10).cast("int")
    got = got.withColumn("pixels", F.array(*(byte(i) for i in range(64))))
    total = F.aggregate("pixels", F.lit(0).cast("long"), lambda a, x: a + x)
    return got.select(F.substring_index("path", ".", 1).cast("long").alias("vec_id"), "height", "width", total.alias("gray"), F.md5(F.array_join(F.col("pixels").cast("array<string>"), ",").cast("binary")).alias("digest"))


_ROWS = f"with {CONV}, e as (select distinct episode_id from seg)"
_KINDS = "select 'subtask' as record_type, count(*) as n, count(distinct episode_id) as episodes from seg union all select 'subgoal', count(*), count(distinct episode_id) from seg union all select 'episode_metadata', count(*), count(distinct episode_id) from e where episode_id in (select doc_id from documents)"


@query(f"{_ROWS} select *, 5::bigint as version from ({_KINDS})")
def committed_annotations(spark, d):
    """Annotations committed a record type at a time, one of them twice under its key, then put into fewer files."""
    log, rows = CommitLog(spark, _fresh(spark, "commits")), schema.conform(_annotations(spark, d))
    for kind in (schema.METADATA, schema.SUBTASK, schema.SUBGOAL, schema.SUBTASK):
        log.append(rows.where(F.col("record_type") == kind), kind)
    log.compact()
    log.replace(log.read())
    n = log.snapshot().version
    return log.read().groupBy("record_type").agg(F.count("*").alias("n"), F.count_distinct("episode_id").alias("episodes")).withColumn("version", F.lit(n))


@query(f"{_ROWS} {_KINDS}")
def sidecar_rows(spark, d):
    """The annotations table written in canonical order, added to and read back."""
    path, rows = _fresh(spark, "sidecar"), _annotations(spark, d)
    schema.write_annotations(rows.where(F.col("record_type") != schema.SUBGOAL), path)
    schema.append_annotations(rows.where(F.col("record_type") == schema.SUBGOAL), path)
    return schema.read_annotations(spark, path).groupBy("record_type").agg(F.count("*").alias("n"), F.count_distinct("episode_id").alias("episodes"))


@query("select user_id::varchar as episode_id, count(*) as n, round(sum(value::float::double), 3) as total, round(sum(-value::float::double), 3) as state from events group by 1")
def scanned_vectors(spark, d):
    """Events as the frame files of a dataset; actions and states scanned back."""
    path = _fresh(spark, "dataset")
    rows = s.frames(spark, d)
    one = F.col("action")[0].cast("float")
    rows = rows.select(F.col("episode_id").alias("episode_index"), F.col("frame_idx").cast("long").alias("frame_index"), F.array(one).alias("action"), F.array(-one).alias("observation.state"))
    rows.repartitionByRange("episode_index").sortWithinPartitions("episode_index", "frame_index").write.parquet(f"{path}/data/chunk-000")
    action, state = src.vector_frames(spark, path), src.vector_frames(spark, path, "observation.state")
    per = lambda df, name: df.groupBy("episode_id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("action")[0]), 3).alias(name))
    return per(action, "total").join(per(state, "state").drop("n"), "episode_id")


@query("select conv_id::varchar as episode_id, arg_max(role, turn) as task, max(turn)::double + 1 as fps from conversations group by 1")
def side_tasks(spark, d):
    """Turns as lines of side data; an episode's last line counts."""
    path = _fresh(spark, "side")
    lines = s.table(spark, d, "conversations").repartition("conv_id").sortWithinPartitions("conv_id", "turn")
    line = F.to_json(F.struct(F.col("conv_id").cast("string").alias("episode_id"), F.col("role").alias("task"), (F.col("turn") + 1).cast("double").alias("fps")))
    lines.select(line.alias("value")).write.text(path)
    return src.side_metadata(spark, path)


@query("select 'quality' as stage, 200::bigint as status_code, count(distinct conv_id) as n, count(distinct conv_id) as answers from conversations")
def receipts_stored(spark, d):
    """Every episode asked twice: one good receipt each."""
    path, labels = _fresh(spark, "receipts"), F.array(F.lit(0), F.col("num_frames") - 1)
    asked = s.conversation_episodes(spark, d).select(F.col("episode_id").cast("string").alias("episode_id"), F.lit("quality").alias("stage"), F.concat(F.lit("Rate "), "task").alias("question"), labels.alias("frame_labels"))
    mock = providers.build_provider("mock")
    for _ in range(2):
        providers.ask(asked, mock, path)
    return providers.stored(spark, path).groupBy("stage", "status_code").agg(F.count("*").alias("n"), F.count("answer").alias("answers"))
