"""Pictures: formats against an encoder of the test's own, round trips, the sink's commit and abort."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.sources import raster as r


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def paeth(a, b, c):
    p = a + b - c
    return a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c


def png(samples, colour, depth, kinds, palette=None, interlace=False):
    """samples: height x width x channels of whole numbers; each row by the next of the filters ``kinds``."""
    h, w, n = samples.shape
    step, raw = max(1, n * depth // 8), b""
    passes = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)] if interlace else [(0, 0, 1, 1)]
    for x, y, dx, dy in passes:
        part = samples[y::dy, x::dx]
        if not part.size:
            continue
        before = None
        for i, row in enumerate(part):
            bits = "".join(format(v, f"0{depth}b") for v in row.ravel().tolist())
            line = int((bits + "0" * (-len(bits) % 8)), 2).to_bytes((len(bits) + 7) // 8, "big")
            up, kind = before or bytes(len(line)), kinds[i % len(kinds)]
            left = bytes(step) + line
            corner = bytes(step) + up
            guess = {0: lambda k: 0, 1: lambda k: left[k], 2: lambda k: up[k], 3: lambda k: (left[k] + up[k]) // 2, 4: lambda k: paeth(left[k], up[k], corner[k])}[kind]
            raw += bytes([kind]) + bytes((line[k] - guess(k)) & 255 for k in range(len(line)))
            before = line
    head = struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, interlace)
    return r.PNG_MARK + chunk(b"IHDR", head) + (chunk(b"PLTE", palette.tobytes()) if palette is not None else b"") + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("interlace", [False, True])
@pytest.mark.parametrize("colour,depth", [(0, 1), (0, 2), (0, 4), (0, 8), (0, 16), (2, 8), (2, 16), (4, 8), (6, 8), (3, 2), (3, 8)])
def test_every_kind_of_png(colour, depth, interlace):
    rng = np.random.default_rng(depth + 20 * colour)
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    palette = rng.integers(0, 256, (1 << min(depth, 8), 3), dtype=np.uint8) if colour == 3 else None
    x = rng.integers(0, 1 << depth, (11, 13, n))
    got = r.read_picture(png(x, colour, depth, [0, 1, 2, 3, 4], palette, interlace))
    want = palette[x[:, :, 0]] if colour == 3 else x >> 8 if depth == 16 else x * (255 // ((1 << depth) - 1)) if depth < 8 else x
    assert (got == want).all()


@pytest.mark.parametrize("shape", [(1, 1, 1), (7, 5, 1), (4, 9, 3), (3, 2, 4), (6, 6, 2)])
def test_own_files_come_back(shape):
    x = np.random.default_rng(1).integers(0, 256, shape, dtype=np.uint8)
    assert (r.read_picture(r.write_png(x)) == x).all()
    assert (r.read_picture(r.write_bmp(x)) == r.to_rgb(x)).all()


def test_bmp_with_a_palette_and_from_the_top():
    palette = np.arange(1024, dtype=np.uint8).reshape(256, 4)
    x = np.arange(6, dtype=np.uint8).reshape(2, 3)
    rows = b"".join(bytes(row) + b"\0" for row in x)
    data = struct.pack("<2sIIIIiiHHIIiiII", b"BM", 0, 0, 54 + 1024, 40, 3, -2, 1, 8, 0, 8, 0, 0, 0, 0) + palette.tobytes() + rows
    assert (r.read_picture(data) == palette[x][:, :, 2::-1]).all()


def test_colours():
    gray = np.array([[0.0, 0.5], [1.0, 0.25]])
    assert r.to_rgb(gray).tolist() == [[[0] * 3, [128] * 3], [[255] * 3, [64] * 3]]
    assert r.to_rgb(np.array([[300, -5]])).tolist() == [[[255] * 3, [0] * 3]]
    assert r.to_rgb(np.zeros((3, 8, 9), np.uint8)).shape == (8, 9, 3) and r.to_rgb(np.zeros((8, 9, 4), np.uint8)).shape == (8, 9, 3)


def test_damaged_files_have_an_error(spark):
    good = r.write_png(np.full((2, 2, 3), 9, np.uint8))
    bad = [good[:40], good[:50] + b"\xff" + good[51:], b"", None, b"GIF89a", b"BM123"]
    got = r.decode_pictures(spark.createDataFrame([(i, x) for i, x in enumerate([good, *bad])], "i int, content binary")).orderBy("i").collect()
    assert (got[0]["height"], got[0]["width"], got[0]["rgb"], got[0]["error"]) == (2, 2, bytes([9] * 12), None)
    assert all(x["rgb"] is None and x["error"] for x in got[1:])


def test_sink_commits_all_or_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    frames = spark.range(40).select(F.format_string("e%d/%03d.png", F.col("id") % 4, "id").alias("path"), F.array(*[((F.col("id") * k) % 256).cast("int") for k in range(6)]).alias("values"), F.lit(2).alias("height"), F.lit(3).alias("width"))
    made = r.encode_pictures(frames).repartition(3)
    r.write_pictures(made, path)
    got = {x["path"]: x["content"] for x in r.read_pictures(spark, path).collect()}
    assert got == {x["path"]: x["content"] for x in made.collect()} and len(got) == 40
    broken = made.withColumn("path", F.when(F.col("path") == "e3/039.png", "../x").otherwise(F.concat(F.lit("n"), F.col("path"))))
    with pytest.raises(Exception, match="no path below"):
        r.write_pictures(broken, path)
    assert {x["path"] for x in r.read_pictures(spark, path).collect()} == set(got)
    assert [x.name for x in (tmp_path / "out").iterdir() if x.name.startswith("_staged")] == []
    r.write_pictures(made.where("path like 'e1%'"), path, "overwrite")
    assert r.read_pictures(spark, path).count() == 10
