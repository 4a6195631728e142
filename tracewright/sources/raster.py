"""PNG and BMP pictures without an image library, and a sink that writes them wholly or not at all.

Pictures are arrays of bytes, height x width x channels. ``read_picture`` takes PNG of any colour type, bit depth and
interlacing, and uncompressed BMP of 8, 24 or 32 bits; 16-bit samples keep their upper byte, a palette becomes colours. Checksums
of PNG chunks are verified. Decoding runs in Arrow batches, a picture at a time.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Fixed values of the formats.
PNG_MARK = b"\x89PNG\r\n\x1a\n"
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}  # by colour type
_PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]  # x, y, step x, step y


def _predicted(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A row of bytes from what its filter left of it."""
    if kind == 0:
        return row
    if kind == 2:
        return row + above
    if kind == 1:
        pad = -len(row) % step
        return np.cumsum(np.append(row, np.zeros(pad, np.uint8)).reshape(-1, step), axis=0, dtype=np.uint8).ravel()[: len(row)]
    if kind > 4:
        raise ValueError(f"unknown filter {kind}")
    out, up = bytearray(row.tobytes()), above.tobytes()
    for i in range(len(out)):
        a, b = (out[i - step] if i >= step else 0), up[i]
        if kind == 3:
            guess = (a + b) // 2
        else:
            c = up[i - step] if i >= step else 0
            guess = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
        out[i] = (out[i] + guess) & 255
    return np.frombuffer(bytes(out), np.uint8)


def _samples(row: np.ndarray, depth: int, n: int) -> np.ndarray:
    """n samples of a row: as stored for less than 8 bits, the upper byte of 16."""
    if depth == 8:
        return row[:n]
    if depth == 16:
        return row[0 : 2 * n : 2]
    bits = np.unpackbits(row).reshape(-1, depth)
    return (bits @ (1 << np.arange(depth)[::-1])).astype(np.uint8)[:n]


def _png(data: bytes) -> np.ndarray:
    at, header, palette, packed = len(PNG_MARK), None, None, []
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or zlib.crc32(kind + body) != int.from_bytes(data[at + 8 + size : at + 12 + size], "big"):
            raise ValueError("a PNG chunk is cut or damaged")
        at += 12 + size
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
    if header is None or header[3] not in _SAMPLES:
        raise ValueError("a PNG file without a valid header")
    width, height, depth, colour, _, _, interlaced = header
    per = _SAMPLES[colour]
    raw, start = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8), 0
    out = np.zeros((height, width, per), np.uint8)
    step = max(1, per * depth // 8)
    for x, y, dx, dy in _PASSES if interlaced else [(0, 0, 1, 1)]:
        columns, rows = len(range(x, width, dx)), len(range(y, height, dy))
        if not columns:
            continue
        size = (columns * per * depth + 7) // 8
        above = np.zeros(size, np.uint8)
        for i in range(rows):
            above = _predicted(int(raw[start]), raw[start + 1 : start + 1 + size], above, step)
            out[y + i * dy, x::dx] = _samples(above, depth, columns * per).reshape(columns, per)
            start += 1 + size
    if colour == 3:
        if palette is None:
            raise ValueError("a PNG file without its palette")
        return palette[out[:, :, 0]]
    return out * np.uint8(255 // ((1 << depth) - 1)) if depth < 8 else out


def _bmp(data: bytes) -> np.ndarray:
    offset, head, width, height, _, depth, packing = struct.unpack("<10xIIiiHHI", data[:34])
    if packing not in (0, 3) or depth not in (8, 24, 32):
        raise ValueError("BMP files of 8, 24 or 32 plain bits only")
    size = (width * depth // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, size * abs(height), offset).reshape(abs(height), size)[:, : width * depth // 8]
    rows = rows[::-1] if height > 0 else rows
    if depth == 8:
        used = struct.unpack("<I", data[46:50])[0] or 256
        return np.frombuffer(data, np.uint8, 4 * used, 14 + head).reshape(-1, 4)[rows][:, :, 2::-1]
    return rows.reshape(abs(height), width, depth // 8)[:, :, 2::-1]


def read_picture(data: bytes) -> np.ndarray:
    if data.startswith(PNG_MARK):
        return _png(data)
    if data.startswith(b"BM"):
        return _bmp(data)
    raise ValueError("neither PNG nor BMP")


def write_png(picture: np.ndarray) -> bytes:
    """8-bit PNG of 1 to 4 channels; each row as its difference from the one above."""
    height, width, per = picture.shape
    flat = np.ascontiguousarray(picture, np.uint8).reshape(height, width * per)
    rows = np.concatenate([np.full((height, 1), 2, np.uint8), np.diff(flat, axis=0, prepend=np.zeros((1, width * per), np.uint8))], axis=1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    colour = next(c for c, n in _SAMPLES.items() if n == per and c != 3)
    return PNG_MARK + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def write_bmp(picture: np.ndarray) -> bytes:
    """24-bit BMP, rows from the bottom."""
    rgb = to_rgb(picture)
    height, width, _ = rgb.shape
    size = (3 * width + 3) // 4 * 4
    rows = np.zeros((height, size), np.uint8)
    rows[:, : 3 * width] = rgb[::-1, :, ::-1].reshape(height, -1)
    return struct.pack("<2sIIIIiiHHIIiiII", b"BM", 54 + rows.size, 0, 54, 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def to_bytes(values: np.ndarray) -> np.ndarray:
    """Samples as bytes: fractions none of which exceeds 1 are scaled by 255, all else is cut to 0..255."""
    if values.dtype == np.uint8:
        return values
    scale = 255.0 if values.dtype.kind == "f" and values.max(initial=0) <= 1 else 1.0
    return np.clip(np.rint(values * scale) if scale > 1 else values, 0, 255).astype(np.uint8)


def to_rgb(picture: np.ndarray) -> np.ndarray:
    """Three channels of bytes: gray is repeated, transparency dropped, channels that stand first go last."""
    p = to_bytes(np.asarray(picture))
    p = p[:, :, None] if p.ndim == 2 else p
    if p.shape[2] > 4 and p.shape[0] in (1, 3):
        p = np.moveaxis(p, 0, 2)
    return np.repeat(p[:, :, :1], 3, axis=2) if p.shape[2] < 3 else p[:, :, :3]


# --- pictures of DataFrames


def _others(df: DataFrame, names: tuple[str, ...]) -> tuple[list[str], str]:
    kept = [f for f in df.schema.fields if f.name not in names]
    return [f.name for f in kept], "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)


def decode_pictures(files: DataFrame) -> DataFrame:
    """(.., content) with height, width, rgb (row by row) and error in its place; damaged or null files have an error alone."""
    names, kinds = _others(files, ("content", "height", "width", "rgb", "error"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                height = width = pixels = error = None
                try:
                    rgb = to_rgb(read_picture(batch.column("content")[i].as_py() or b""))
                    height, width, pixels = rgb.shape[0], rgb.shape[1], rgb.tobytes()
                except (ValueError, struct.error, zlib.error, IndexError) as e:
                    error = str(e)
                own = [pa.array([height], pa.int32()), pa.array([width], pa.int32()), pa.array([pixels], pa.binary()), pa.array([error], pa.string())]
                yield pa.RecordBatch.from_arrays([*(batch.column(n).slice(i, 1) for n in names), *own], [*names, "height", "width", "rgb", "error"])

    return files.select(*names, "content").mapInArrow(run, kinds + "height int, width int, rgb binary, error string")


def encode_pictures(frames: DataFrame, kind: str = "png") -> DataFrame:
    """(.., values ARRAY of numbers, height, width) with content in place of values: one channel if there is a value a
    pixel, three if there are three, row by row."""
    names, kinds = _others(frames, ("values", "content"))
    write = {"png": write_png, "bmp": write_bmp}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v, h, w in zip(batch.column("values"), batch.column("height").to_pylist(), batch.column("width").to_pylist()):
                out.append(None if v.as_py() is None else write(to_bytes(v.values.to_numpy(zero_copy_only=False)).reshape(h, w, -1)))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(out, pa.binary())], [*names, "content"])

    return frames.select(*names, "values").mapInArrow(run, kinds + "content binary")


# --- the sink


class _Written(WriterCommitMessage):
    def __init__(self, folder: str | None, count: int) -> None:
        self.folder, self.count = folder, count


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


class PictureWriter(DataSourceArrowWriter):
    """Files of a task go to a folder of its attempt; the commit gives these folders their place, an abort deletes them."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        from pyspark import TaskContext

        files, base = _filesystem(self.path)
        folder, count = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:12]}", 0
        for batch in iterator:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                if content is None:
                    continue
                if name.startswith("/") or ".." in name.split("/"):
                    raise ValueError(f"{name} is no path below the target")
                full = f"{base}/_staged-{self.job}/{folder}/{name}"
                files.create_dir(full.rpartition("/")[0], recursive=True)
                with files.open_output_stream(full) as out:
                    out.write(content)
                count += 1
        return _Written(folder if count else None, count)

    def commit(self, messages) -> None:
        from pyarrow import fs

        files, base = _filesystem(self.path)
        files.create_dir(base, recursive=True)
        if self.overwrite:
            for old in files.get_file_info(fs.FileSelector(base)):
                if old.base_name.startswith("part-"):
                    files.delete_dir(old.path)
        for m in messages:
            if m is not None and m.folder:
                files.move(f"{base}/_staged-{self.job}/{m.folder}", f"{base}/{m.folder}")
        self._clear(files, base)
        with files.open_output_stream(f"{base}/_SUCCESS") as out:
            out.write(b"")

    def abort(self, messages) -> None:
        self._clear(*_filesystem(self.path))

    def _clear(self, files, base: str) -> None:
        from pyarrow import fs

        if files.get_file_info(f"{base}/_staged-{self.job}").type == fs.FileType.Directory:
            files.delete_dir(f"{base}/_staged-{self.job}")


class PictureSink(DataSource):
    """Rows (path STRING, content BINARY) as files below ``path``; null contents are left out."""

    @classmethod
    def name(cls) -> str:
        return "pictures"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite: bool) -> PictureWriter:
        return PictureWriter(self.options["path"], overwrite)


def write_pictures(files: DataFrame, path: str, mode: str = "append") -> None:
    """(path, content) written as files, all or none."""
    files.sparkSession.dataSource.register(PictureSink)
    files.select("path", "content").write.format("pictures").mode(mode).save(path)


def read_pictures(spark: SparkSession, path: str) -> DataFrame:
    """(path below the sink, content) of files that were committed."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{png,bmp}").load(path)
    return found.select(F.regexp_extract("path", r"/part-\d{5}-[0-9a-f]{12}/(.*)$", 1).alias("path"), "content").where("path <> ''")
