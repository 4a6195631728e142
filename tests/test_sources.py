"""Readers against small files, the rubric file, and the images of subgoal frames."""

import json

import pytest

from tracewright import __main__ as cli
from tracewright import config, schema
from tracewright.sources import episodes as src


@pytest.fixture
def folder(tmp_path):
    for e in ("a", "b"):
        (tmp_path / e).mkdir()
        for i in range(12):
            (tmp_path / e / f"{i:03d}.png").write_bytes(f"{e}{i}".encode())
    return tmp_path


def test_image_folders_and_side_files(spark, folder):
    assert {tuple(r) for r in src.image_episodes(spark, str(folder)).select("episode_id", "num_frames", "task", "fps").collect()} == {("a", 12, None, 10.0), ("b", 12, None, 10.0)}
    (folder / "tasks.jsonl").write_text('{"episode_id": "b", "task": "t"}\n')
    assert dict(src.image_episodes(spark, str(folder)).select("episode_id", "task").collect()) == {"a": None, "b": "t"}
    lines = [json.dumps({"episode_id": "a", "task": f"v{i}", "fps": i}) for i in range(40)] + ["", "not json", '{"task": "no id"}']
    (folder / "episodes.jsonl").write_text("\n".join(lines))
    got = {r["episode_id"]: (r["task"], r["fps"]) for r in src.image_episodes(spark, str(folder)).collect()}
    assert got == {"a": ("v39", 39.0), "b": (None, 10.0)}
    assert {tuple(r) for r in src.video_episodes(spark, str(folder)).collect()} == set()


def dataset(spark, root, tasks, frame_task):
    (root / "meta").mkdir(parents=True)
    (root / "meta" / "info.json").write_text(json.dumps({"fps": 20, "features": {"action": {"dtype": "float32", "names": ["x"]}, "front": {"dtype": "image"}, "side": {"dtype": "video"}}}))
    spark.createDataFrame([(0, 0, 2, tasks), (1, 2, 5, None)], "episode_index long, dataset_from_index long, dataset_to_index long, tasks array<string>").write.parquet(f"{root}/meta/episodes")
    rows = [(e, i, [float(i)], (f"{e}/{i}".encode(), None), f"frame {e}.{i}") for e, n in ((0, 2), (1, 3)) for i in range(n)]
    frames = spark.createDataFrame(rows, "episode_index long, frame_index long, action array<double>, front struct<bytes:binary,path:string>, task string")
    (frames if frame_task else frames.drop("task")).write.parquet(f"{root}/data")
    return str(root)


def test_dataset_tasks_and_cameras(spark, tmp_path):
    d = dataset(spark, tmp_path / "d", ["first", "second"], True)
    got = {tuple(r) for r in src.dataset_episodes(spark, d).select("episode_id", "task", "num_frames", "fps").collect()}
    assert got == {("0", "first", 2, 20.0), ("1", "frame 1.0", 3, 20.0)}
    assert {r["task"] for r in src.dataset_episodes(spark, dataset(spark, tmp_path / "e", [" "], False)).collect()} == {None}
    info = src.dataset_info(d)
    assert src.camera_key(info) == "front" and src.camera_key(info, "side") == "side"
    with pytest.raises(ValueError, match="no camera 'top'"):
        src.camera_key(info, "top")
    with pytest.raises(ValueError, match="no camera feature"):
        src.camera_key({"features": {"action": {"dtype": "float32"}}})
    assert {bytes(r["content"]) for r in src.camera_frames(spark, d).collect()} == {b"0/0", b"0/1", b"1/0", b"1/1", b"1/2"}
    assert {r["content"] for r in src.camera_frames(spark, d, "side").collect()} == {None}
    assert src.vector_frames(spark, d, episodes=[1]).count() == 3


def test_annotate_with_rubric_and_images(spark, folder):
    (folder / "r.json").write_text(json.dumps({"keyframes": 4, "strategies": {"phase_vocabulary": ["approach", "grasp", "transport", "other"], "max_segments": 5}, "gate": {"quality_outlier_margin": 3, "unknown": 1}}))
    r = config.load_rubric(folder / "r.json")
    assert (r.keyframes, r.phase_vocabulary, r.max_segments, r.min_segments, r.gate.quality_outlier_margin) == (4, ("approach", "grasp", "transport", "other"), 5, 3, 3)
    assert config.load_rubric() == config.Rubric()
    a = ["annotate", "--source", "images", "--target", str(folder), "--rubric", str(folder / "r.json"), "--fps", "5"]
    for more, n, pictures in ((["--strategy", "S1"], 4, 4), (["--no-images"], 3, 0)):
        out = str(folder.parent / f"out{pictures}")
        assert cli.run(spark, cli.parser().parse_args([*a, "--out", out, *more])) == 0
        goals = schema.subgoals_of(schema.read_annotations(spark, f"{out}/annotations")).where("episode_id = 'a'").collect()
        assert len(goals) == n and sum(g["subgoal_image_path"] is not None for g in goals) == pictures
    assert {bytes(x["content"])[:1] for x in spark.read.parquet(f"{folder.parent}/out4/subgoal_images").where("episode_id = 'a'").collect()} == {b"a"}
