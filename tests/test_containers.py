"""Indexes of video files: layouts, lazy reads of ranges, clamped access, damaged files."""

import io
import random

import pytest

from tests.videos import avi, mp4
from tracewright.sources import containers as c


def frames(n, seed=1):
    r = random.Random(seed)
    return [bytes(r.randrange(256) for _ in range(r.randrange(1, 40))) for _ in range(n)]


def listed(data):
    time, offset, size, key = c.read_index(io.BytesIO(data), len(data))
    return [(round(t, 9), data[o : o + s], bool(k)) for t, o, s, k in zip(time.tolist(), offset.tolist(), size.tolist(), key.tolist())]


@pytest.mark.parametrize("tail", [True, False])
@pytest.mark.parametrize("wide", [True, False])
@pytest.mark.parametrize("n,per", [(1, 3), (6, 3), (7, 3), (10, 1), (5, 9)])
def test_mp4(tail, wide, n, per):
    x = frames(n)
    want = [(round(i * 20 / 600, 9), f, i in (0, 4)) for i, f in enumerate(x)]
    assert listed(mp4(x, keys=[k for k in (0, 4) if k < n], per_chunk=per, tail=tail, wide=wide)) == want


def test_order_of_showing_and_equal_sizes():
    x = [bytes([i]) * 4 for i in range(4)]
    got = listed(mp4(x, late=[0, 40, 0, 20], same=True))
    assert [f for _, f, _ in got] == [x[0], x[2], x[1], x[3]] and all(k for _, _, k in got)  # without a list every frame stands alone


@pytest.mark.parametrize("absolute", [True, False])
def test_avi(absolute):
    x = frames(9, 2)
    assert listed(avi(x, keys=(0, 5), absolute=absolute)) == [(round(i * 0.04, 9), f, i in (0, 5)) for i, f in enumerate(x)]


@pytest.mark.parametrize("data", [b"", b"junk" * 9, mp4(frames(3))[:60], b"RIFF\x04\0\0\0AVI "])
def test_damaged_files_say_so(data):
    with pytest.raises(c.BadContainer):
        c.read_index(io.BytesIO(data), len(data))


class Counting(io.BytesIO):
    got = 0

    def read(self, n=-1):
        out = super().read(n)
        self.got += len(out)
        return out


def test_data_are_not_read():
    data = mp4([bytes(100_000)] * 50)
    f = Counting(data)
    assert len(c.read_index(f, len(data))[0]) == 50 and f.got < 5_000


def test_lazy_frames(spark, tmp_path):
    clips = {"a": frames(7, 3), "b": frames(12, 4), "c": frames(3, 5)}
    (tmp_path / "more").mkdir()
    (tmp_path / "a.mp4").write_bytes(mp4(clips["a"]))
    (tmp_path / "more" / "b.MOV").write_bytes(mp4(clips["b"], tail=False))
    (tmp_path / "c.avi").write_bytes(avi(clips["c"]))
    (tmp_path / "notes.txt").write_text("x")
    index = c.container_index(spark, str(tmp_path))
    assert index.rdd.getNumPartitions() == 3 and index.count() == 22
    every = c.frame_bytes(index, str(tmp_path)).collect()
    assert {(r["episode_id"], r["frame_idx"]): r["content"] for r in every} == {(e, i): f for e, x in clips.items() for i, f in enumerate(x)}
    wanted = spark.createDataFrame([("a", -3), ("a", 2), ("b", 99), ("z", 0)], "episode_id string, frame_idx int")
    some = c.frame_bytes(c.clamped(index, wanted), str(tmp_path)).collect()
    assert {(r["episode_id"], r["asked"]): r["content"] for r in some} == {("a", -3): clips["a"][0], ("a", 2): clips["a"][2], ("b", 99): clips["b"][11]}
    rates = {r["episode_id"]: (r["num_frames"], round(r["fps"], 6)) for r in c.container_episodes(index).collect()}
    assert rates == {"a": (7, 30.0), "b": (12, 30.0), "c": (3, 25.0)}
    (tmp_path / "none").mkdir()
    assert c.container_index(spark, str(tmp_path / "none")).count() == 0


def test_many_files_share_partitions(spark, tmp_path):
    x = frames(2)
    for i in range(c.PARTS + 25):
        (tmp_path / f"f{i:03d}.mp4").write_bytes(mp4(x))
    index = c.container_index(spark, str(tmp_path))
    assert index.rdd.getNumPartitions() == c.PARTS
    assert sorted((r["episode_id"], r["frame_idx"]) for r in index.collect()) == [(f"f{i:03d}", j) for i in range(c.PARTS + 25) for j in range(2)]
    names = [str(i) for i in range(c.PARTS * c.FILES + 1)]
    shares = c._shares(names)
    assert sum(shares, []) == names and len(shares) == c.PARTS + 1 and max(map(len, shares)) <= c.FILES and c._shares([]) == []
