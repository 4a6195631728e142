"""Frames of video files by their index: which bytes a frame is, when it shows, whether it stands alone. No decoder.

MP4 and MOV files are read by their sample tables (sizes, chunks, times, key frames), AVI files by their list of chunks; of a
file only box headers and these tables are read, wherever they stand. The reader of the data source plans one partition a
file for few files, and partitions of consecutive files for many. ``frame_bytes`` then reads the ranges of wanted frames alone, so a whole clip is never in memory.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .raster import _filesystem

SUFFIXES = (".mp4", ".mov", ".m4v", ".avi")
SCHEMA = "episode_id string, path string, frame_idx int, time double, offset bigint, size bigint, key boolean"
#: Rows of an Arrow batch.
BATCH = 50_000
#: Partitions that files are dealt to; more than ``PARTS * FILES`` files get more.
PARTS = 96
#: Files of a partition at most.
FILES = 2_000


class BadContainer(ValueError):
    """The file has no index that can be read."""


def _boxes(f: BinaryIO, start: int, stop: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, first byte, end) of the boxes between two places; bodies are not read."""
    while start + 8 <= stop:
        f.seek(start)
        size, kind = struct.unpack(">I4s", f.read(8))
        body = start + 8
        if size == 1:
            size, body = struct.unpack(">Q", f.read(8))[0], start + 16
        end = stop if size == 0 else start + size
        if end < body or end > stop:
            raise BadContainer(f"the box {kind!r} at {start} does not fit")
        yield kind, body, end
        start = end


def _inside(f: BinaryIO, start: int, stop: int, *path: bytes) -> tuple[int, int] | None:
    """Body of the first box of a path of kinds."""
    for kind, a, b in _boxes(f, start, stop):
        if kind == path[0]:
            return (a, b) if len(path) == 1 else _inside(f, a, b, *path[1:])
    return None


def _table(f: BinaryIO, span: tuple[int, int] | None, kind: str, skip: int = 8) -> np.ndarray:
    """Entries of a table box after its version and count."""
    if span is None:
        return np.zeros(0, kind)
    f.seek(span[0] + skip)
    data = f.read(span[1] - span[0] - skip)
    one = np.dtype(kind).itemsize
    return np.frombuffer(data, kind, len(data) // one)


def _mp4(f: BinaryIO, size: int) -> tuple[np.ndarray, ...]:
    movie = _inside(f, 0, size, b"moov")
    if movie is None:
        raise BadContainer("no movie box")
    for kind, a, b in _boxes(f, *movie):
        if kind != b"trak":
            continue
        handler = _inside(f, a, b, b"mdia", b"hdlr")
        if handler is None:
            continue
        f.seek(handler[0] + 8)
        if f.read(4) == b"vide":
            return _track(f, _inside(f, a, b, b"mdia"))
    raise BadContainer("no video track")


def _track(f: BinaryIO, media: tuple[int, int]) -> tuple[np.ndarray, ...]:
    head, tables = _inside(f, *media, b"mdhd"), _inside(f, *media, b"minf", b"stbl")
    if head is None or tables is None:
        raise BadContainer("a video track without tables")
    f.seek(head[0])
    long = f.read(1) == b"\1"
    f.seek(head[0] + (20 if long else 12))
    scale = struct.unpack(">I", f.read(4))[0]
    at = {kind: (a, b) for kind, a, b in _boxes(f, *tables)}
    f.seek(at[b"stsz"][0] + 4)
    same, n = struct.unpack(">II", f.read(8))
    sizes = np.full(n, same, np.int64) if same else _table(f, at[b"stsz"], ">u4", 12)[:n].astype(np.int64)
    chunks = (_table(f, at[b"co64"], ">u8") if b"co64" in at else _table(f, at.get(b"stco"), ">u4")).astype(np.int64)
    # samples of each chunk: an entry holds until the next one's first chunk
    runs = _table(f, at.get(b"stsc"), ">u4").reshape(-1, 3).astype(np.int64)
    per = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunks) + 1)))
    if per.sum() < n:
        raise BadContainer("chunks hold fewer samples than there are sizes")
    chunk = np.repeat(np.arange(len(per)), per)[:n]
    before = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if n else np.zeros(0, np.int64)
    first = np.searchsorted(chunk, np.arange(len(chunks)))
    offsets = chunks[chunk] + before - before[np.minimum(first[chunk], max(n - 1, 0))] if n else before
    steps = _table(f, at.get(b"stts"), ">u4").reshape(-1, 2).astype(np.int64)
    lasts = np.repeat(steps[:, 1], steps[:, 0])[:n]
    times = np.concatenate([[0], np.cumsum(lasts)])[:n]
    late = _table(f, at.get(b"ctts"), ">u4").reshape(-1, 2)
    if len(late):  # shown later than decoded; versions differ in the sign alone
        times = times + np.repeat(late[:, 1].astype(np.uint32).view(np.int32).astype(np.int64), late[:, 0].astype(np.int64))[:n]
        times = times - times.min(initial=0)
    key = np.ones(n, bool)
    if b"stss" in at:
        key[:] = False
        key[_table(f, at[b"stss"], ">u4").astype(np.int64) - 1] = True
    shown = np.argsort(times, kind="stable")
    return times[shown] / max(scale, 1), offsets[shown], sizes[shown], key[shown]


def _chunks(f: BinaryIO, start: int, stop: int) -> Iterator[tuple[bytes, int, int]]:
    while start + 8 <= stop:
        f.seek(start)
        kind, size = struct.unpack("<4sI", f.read(8))
        yield kind, start + 8, min(stop, start + 8 + size)
        start += 8 + size + size % 2


def _avi(f: BinaryIO, size: int) -> tuple[np.ndarray, ...]:
    step, movie, index = 1 / 30, None, None
    for kind, a, b in _chunks(f, 12, size):
        f.seek(a)
        what = f.read(4) if kind == b"LIST" else b""
        if what == b"hdrl":
            for k, x, _ in _chunks(f, a + 4, b):
                if k == b"avih":
                    f.seek(x)
                    step = (struct.unpack("<I", f.read(4))[0] or 33_333) / 1e6
        elif what == b"movi":
            movie = a
        elif kind == b"idx1":
            f.seek(a)
            index = np.frombuffer(f.read(b - a), [("kind", "S4"), ("flags", "<u4"), ("offset", "<u4"), ("size", "<u4")], (b - a) // 16)
    if movie is None or index is None:
        raise BadContainer("no list of chunks")
    video = index[np.isin(np.char.array(index["kind"])[:].astype("U4"), [f"{s:02d}d{t}" for s in range(100) for t in "cb"])] if len(index) else index
    video = video[video["kind"] == video["kind"][0]] if len(video) else video  # the first video stream
    base = movie if len(video) and video["offset"].min() < movie else 0  # offsets count from the list or from the file
    n = len(video)
    return np.arange(n) * step, base + video["offset"].astype(np.int64) + 8, video["size"].astype(np.int64), (video["flags"] & 0x10) > 0


def read_index(f: BinaryIO, size: int) -> tuple[np.ndarray, ...]:
    """(time, offset, size, key) of the frames of the first video track, in the order they show."""
    f.seek(0)
    start = f.read(12)
    if start[:4] == b"RIFF" and start[8:] == b"AVI ":
        return _avi(f, size)
    try:
        return _mp4(f, size)
    except (struct.error, KeyError) as e:
        raise BadContainer(str(e)) from e


class _Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


def _shares(names: list[str]) -> list[list[str]]:
    """Consecutive names in shares that differ by one at most: each file by itself up to ``PARTS``."""
    n = max(min(len(names), PARTS), -(-len(names) // FILES))
    if not n:
        return []
    return [names[len(names) * i // n : len(names) * (i + 1) // n] for i in range(n)]


class _IndexReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[_Files]:
        from pyarrow import fs

        files, base = _filesystem(self.path)
        found = [files.get_file_info(base)] if files.get_file_info(base).is_file else files.get_file_info(fs.FileSelector(base, recursive=True))
        names = sorted(x.path for x in found if x.is_file and x.path.lower().endswith(SUFFIXES))
        return [_Files(x) for x in _shares(names)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        files, held, rows = _filesystem(self.path)[0], [], 0
        for path in partition.paths:
            with files.open_input_file(path) as f:
                time, offset, size, key = read_index(f, f.size())
            stem = path.rpartition("/")[2].rpartition(".")[0]
            for a in range(0, len(time), BATCH):
                n = len(time[a : a + BATCH])
                held.append(
                    pa.RecordBatch.from_arrays(
                        [pa.array([stem] * n), pa.array([path] * n), pa.array(np.arange(a, a + n, dtype=np.int32)), *(pa.array(np.ascontiguousarray(x[a : a + n])) for x in (time, offset, size, key))],
                        ["episode_id", "path", "frame_idx", "time", "offset", "size", "key"],
                    )
                )
                rows += n
                if rows >= BATCH:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches(BATCH)
                    held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches(BATCH)


class ContainerIndex(DataSource):
    """A row a frame of every video file below ``path``."""

    @classmethod
    def name(cls) -> str:
        return "container_index"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _IndexReader:
        return _IndexReader(self.options["path"])


def container_index(spark: SparkSession, path: str) -> DataFrame:
    """(episode_id, path, frame_idx, time, offset, size, key) of all frames of video files below ``path``."""
    spark.dataSource.register(ContainerIndex)
    return spark.read.format("container_index").load(path)


def container_episodes(index: DataFrame) -> DataFrame:
    """(episode_id, path, num_frames, fps): frames and their mean rate, 30 where one frame shows none."""
    span = F.max("time") - F.min("time")
    return index.groupBy("episode_id", "path").agg(F.count("*").cast("int").alias("num_frames"), F.coalesce(F.when(span > 0, (F.count("*") - 1) / span), F.lit(30.0)).alias("fps"))


def clamped(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (episode_id, frame_idx) with the entry of the frame of that number, of the first or last beyond the ends: asked is
    the number asked for."""
    last = index.groupBy("episode_id").agg(F.max("frame_idx").alias("__last"))
    near = wanted.select("episode_id", F.col("frame_idx").alias("asked")).join(last, "episode_id")
    near = near.select("episode_id", "asked", F.greatest(F.lit(0), F.least("asked", "__last")).cast("int").alias("frame_idx"))
    return near.join(index, ["episode_id", "frame_idx"])


def frame_bytes(entries: DataFrame, root: str) -> DataFrame:
    """Entries of an index with content, the bytes of their frames: one read of a range each, files opened once a batch."""
    names = [f.name for f in entries.schema.fields if f.name != "content"]
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in entries.schema.fields if f.name != "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = _filesystem(root)
        for batch in batches:
            at = list(zip(batch.column("path").to_pylist(), batch.column("offset").to_pylist(), batch.column("size").to_pylist()))
            for a in range(0, len(at), 64):  # frames in memory
                opened, out = {}, []
                for path, offset, size in at[a : a + 64]:
                    if path not in opened:
                        opened[path] = files.open_input_file(path)
                    out.append(opened[path].read_at(size, offset))
                for f in opened.values():
                    f.close()
                yield pa.RecordBatch.from_arrays([*(batch.column(n).slice(a, 64) for n in names), pa.array(out, pa.binary())], [*names, "content"])

    return entries.select(*names).sortWithinPartitions("path", "offset").mapInArrow(run, kinds + "content binary")
