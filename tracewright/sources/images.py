"""Pixels: decoding, contact sheets and frame extraction. Image and video libraries are optional and imported on the
executors; without one a call fails with ImportError. Analytics only ever use embeddings or gray arrays made here."""

from __future__ import annotations

import io

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def decode_videos(videos: DataFrame, every: int = 1) -> DataFrame:
    """(episode_id, content) of whole files -> (episode_id, frame_idx, content as PNG), every n-th frame, streamed: a
    task holds one file and one frame."""

    def run(batches):
        import av
        from PIL import Image

        for pdf in batches:
            for episode, data in zip(pdf["episode_id"], pdf["content"]):
                with av.open(io.BytesIO(data)) as clip:
                    for i, frame in enumerate(clip.decode(video=0)):
                        if i % every == 0:
                            out = io.BytesIO()
                            Image.fromarray(frame.to_ndarray(format="rgb24")).save(out, "PNG")
                            yield pd.DataFrame({"episode_id": [episode], "frame_idx": [i], "content": [out.getvalue()]})

    return videos.select(F.col("episode_id").cast("string").alias("episode_id"), "content").mapInPandas(run, "episode_id string, frame_idx int, content binary")


def contact_sheets(frames: DataFrame, columns: int = 3, width: int = 224) -> DataFrame:
    """(sheet, frame_idx, caption, content) -> (sheet, content): one montage PNG a sheet, frames in order, captioned.

    A sheet has few frames by its purpose; its group is collected in one task.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from PIL import Image, ImageDraw

        pdf = pdf.sort_values("frame_idx")
        thumbs = []
        for data in pdf["content"]:
            image = Image.open(io.BytesIO(data)).convert("RGB")
            thumbs.append(image.resize((width, max(1, round(image.height * width / image.width)))))
        tall = max(t.height for t in thumbs) + 16
        rows = -(-len(thumbs) // columns)
        sheet = Image.new("RGB", (columns * width, rows * tall), "white")
        for i, (t, caption) in enumerate(zip(thumbs, pdf["caption"])):
            x, y = i % columns * width, i // columns * tall
            sheet.paste(t, (x, y + 16))
            ImageDraw.Draw(sheet).text((x + 2, y + 2), caption or "", fill="black")
        out = io.BytesIO()
        sheet.save(out, "PNG")
        return pd.DataFrame({"sheet": [pdf["sheet"].iloc[0]], "content": [out.getvalue()]})

    rows = frames.select(F.col("sheet").cast("string").alias("sheet"), "frame_idx", "caption", "content")
    return rows.groupBy("sheet").applyInPandas(run, "sheet string, content binary")


def data_url(content) -> F.Column:
    return F.concat(F.lit("data:image/png;base64,"), F.base64(content))


def subgoal_images(subgoals: DataFrame, frames: DataFrame) -> DataFrame:
    """subgoals (episode_id, segment_idx, subgoal_frame_idx) with the image bytes of their frame and a relative path."""
    at = frames.select("episode_id", F.col("frame_idx").alias("subgoal_frame_idx"), "content")
    path = F.concat_ws("/", F.lit("subgoals"), "episode_id", F.format_string("%03d.png", "segment_idx"))
    return subgoals.join(at, ["episode_id", "subgoal_frame_idx"], "left").withColumn("subgoal_image_path", F.when(F.col("content").isNotNull(), path))
