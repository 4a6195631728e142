import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright import config, schema
from tracewright.operators import corpus, gate, views
from tracewright.plans import pipeline, providers
from tracewright.sources import episodes as src
from tracewright.streaming.incremental import annotate_stream

ALL = {m: {"enabled": True} for m in config.MODULES}


@pytest.fixture(scope="module")
def source(spark):
    episodes, frames = src.synthetic(spark, 18)
    rng = np.random.default_rng(0)
    rows = [(r["episode_id"], i, [float(x) for x in rng.normal(size=12)]) for r in episodes.collect() for i in range(24)]
    return episodes, frames, spark.createDataFrame(rows, "episode_id string, frame_idx int, embedding array<double>")


def test_full_run_with_mock(spark, source, tmp_path):
    episodes, frames, embeddings = source
    c = config.RunConfig.of({"modules": ALL | {"subgoals": {"enabled": True, "retrieval": True}, "segmentation": {"enabled": True, "snap_contact": True}}})
    out = pipeline.run_pipeline(c, episodes, frames, str(tmp_path), providers.MockProvider(), embeddings=embeddings, action_names=[f"j{i}.pos" for i in range(6)] + ["gripper.pos"], control_space="joint")
    assert out.columns == list(schema.COLUMNS)
    assert {r["record_type"]: r["count"] for r in out.groupBy("record_type").count().collect()} == {"episode_metadata": 18, "subtask": 72, "subgoal": 72}
    meta = schema.metadata_of(out).first()
    assert meta["quality"] == 4 and meta["control_modality"] == "joint" and meta["novelty"] > 0 and meta["active_seconds"] is not None and meta["cost_usd"] is None
    segs = schema.segments_of(out)
    assert {r[0] for r in segs.select("active_dof").distinct().collect()} <= {"none", "arm", "gripper", "arm+gripper"} and segs.where("boundary_evidence is null").count() == 0
    goals = schema.subgoals_of(out)
    assert goals.where("retrieved_subgoal_episode_id = episode_id").count() == 0
    # the mock splits evenly, so every episode is flagged and none may be retrieved from
    passed = gate.gate_passed(segs).count()
    assert goals.where("retrieved_subgoal_episode_id is not null").count() == (0 if passed == 0 else goals.count())
    view = schema.episode_view(out).first()
    assert [s["segment_idx"] for s in view["subtasks"]] == [0, 1, 2, 3] and len(view["subgoals"]) == 4
    again = pipeline.enrich(out, frames, pipeline.dims_table(spark, None, 7), control_space="joint")
    assert again.where("record_type = 'subtask' and active_dof not in ('arm', 'none')").count() == 0
    with pytest.raises(ValueError, match="requires"):
        config.RunConfig.of({"modules": {"segmentation": {"enabled": False}, "control": {"enabled": True}}}).validate()


@pytest.mark.parametrize("name", ["S0", "S4", "S2-open"])
def test_strategies(spark, source, tmp_path, name):
    episodes = source[0].limit(3)
    out = pipeline.label_segments(episodes, providers.MockProvider(), config.load_strategy(name), config.Rubric(), str(tmp_path)).collect()
    assert len(out) == 3 and {len(r["segments"]) for r in out} == {3 if name == "S0" else 4}
    assert all(r["segments"][-1]["end_frame"] == 23 for r in out)


class Flaky(providers.MockProvider):
    name = "flaky"

    def answer(self, stage, question, labels):
        if stage.endswith("_a0"):
            return '{"segments": []}', 0.5
        if stage == "fail":
            raise OSError("no network")
        return super().answer(stage, question, labels)


def test_retries_receipts_and_errors(spark, source, tmp_path):
    providers.register_provider("flaky", Flaky)
    assert "flaky" in providers.available_providers()
    p = providers.build_provider("flaky")
    out = pipeline.label_segments(source[0].limit(2), p, config.load_strategy("S2"), config.Rubric(), str(tmp_path)).collect()
    assert all(r["error"] is None and len(r["segments"]) == 4 for r in out)
    stored = providers.stored(spark, str(tmp_path))
    n = stored.count()
    pipeline.label_segments(source[0].limit(2), p, config.load_strategy("S2"), config.Rubric(), str(tmp_path)).collect()
    assert providers.stored(spark, str(tmp_path)).count() == n
    asked = source[0].limit(1).select("episode_id", F.lit("fail").alias("stage"), F.lit("q").alias("question"), F.array(F.lit(0)).alias("frame_labels"))
    assert providers.ask(asked, p, str(tmp_path)).count() == 0
    assert providers.stored(spark, str(tmp_path)).where("status_code = 500").first()["error"] == "no network"


def test_stream_resumes(spark, tmp_path):
    episodes, _ = src.synthetic(spark, 4)
    a, out = str(tmp_path / "in"), str(tmp_path / "out")
    kinds = ", ".join(f"{n} {t}" for n, t in episodes.dtypes)
    seen = []

    def annotate(df):
        seen.append(df.count())
        ok = df.where("episode_id <> 'synthetic_02'") if len(seen) == 1 else df
        return ok.withColumns({"record_type": F.lit("episode_metadata"), "quality": F.lit(3)})

    episodes.where("episode_id <= 'synthetic_02'").coalesce(1).write.parquet(a)
    annotate_stream(spark, a, kinds, annotate, out)
    assert schema.read_annotations(spark, f"{out}/annotations").count() == 2
    episodes.where("episode_id > 'synthetic_02'").coalesce(1).write.mode("append").parquet(a)
    annotate_stream(spark, a, kinds, annotate, out)
    assert schema.read_annotations(spark, f"{out}/annotations").select("episode_id").distinct().count() == 4 and seen == [3, 2]
    annotate_stream(spark, a, kinds, annotate, out)
    assert seen == [3, 2]


def test_older_annotations_are_read(spark, tmp_path):
    spark.createDataFrame([("1", "subtask", 0, 0, 5, "t")], "episode_id string, record_type string, segment_idx int, start_frame int, end_frame int, subtask_text string").write.parquet(str(tmp_path / "a"))
    df = schema.read_annotations(spark, str(tmp_path / "a"))
    assert df.columns == list(schema.COLUMNS) and df.first()["phase"] is None and df.first()["schema_version"] == schema.SCHEMA_VERSION


def test_order_and_ids(spark):
    rows = [(e, t, i) for e in ("2", "10") for t, i in (("subgoal", 0), ("subtask", 1), ("subtask", 0), ("episode_metadata", None))]
    df = schema.canonical(spark.createDataFrame(rows, "episode_id string, record_type string, segment_idx int"))
    assert [(r["episode_id"], r["record_type"], r["segment_idx"]) for r in df.collect()][:4] == [("10", "episode_metadata", None), ("10", "subtask", 0), ("10", "subtask", 1), ("10", "subgoal", 0)]
    assert [r[0] for r in schema.episode_ids(df).collect()] == ["10", "2"]


def test_tiers_are_null_below_the_guard(spark):
    df = spark.createDataFrame([(str(i), float(i % 5), float(i)) for i in range(14)], "episode_id string, quality double, novelty double")
    assert corpus.tiers(corpus.curation_values(df)).where("curation_tier is not null").count() == 0
    more = df.union(spark.createDataFrame([("x", None, 3.0), ("y", 2.0, None)], df.schema))
    assert corpus.tiers(corpus.curation_values(more)).where("curation_tier is null").count() == 0


def test_novelty_alone_and_ties(spark):
    one = spark.createDataFrame([("a", [1.0, 0.0])], "episode_id string, embedding array<double>")
    assert corpus.novelty(one).collect()[0]["novelty"] == 0.0
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 4)).round(1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "episode_id int, embedding array<double>")
    got = {r["episode_id"]: r["novelty"] for r in corpus.novelty(df, 3).collect()}
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(d, np.inf)
    assert [got[i] for i in range(60)] == pytest.approx(np.sort(d, axis=1)[:, :3].mean(axis=1), abs=1e-5)


def test_gallery_views(spark):
    a = spark.createDataFrame([("10", 3, "full", "fast"), ("2", None, "minimal", "slow")], "episode_id string, quality int, curation_tier string, speed string")
    g = views.merge_galleries([("pour", a), ("fold", a)])
    assert [r["episode_id"] for r in views.sorted_view(g.drop("speed").withColumn("episode_id", F.col("source_episode_id")), "id").collect()] == ["2", "2", "10", "10"]
    assert [r["episode_id"] for r in views.sorted_view(g, "speed", grouped=True).collect()] == ["pour::10", "pour::2", "fold::10", "fold::2"]
    assert views.filtered_gallery(g, "fold", "full").count() == 1


def test_config_parsers(tmp_path):
    assert config.parse_episodes("0-3, 7") == [0, 1, 2, 3, 7] and config.parse_episodes("") is None
    assert config.parse_task_spec("pour|/d|images")["source"] == "images" and config.parse_task_spec("p")["camera"] is None
    (tmp_path / "s.json").write_text('{"base": "s2-open", "refine_boundaries": true, "other": 1}')
    s = config.load_strategy(str(tmp_path / "s.json"))
    assert s.open_vocabulary and s.refine_boundaries and config.load_strategy("s4").self_consistency_k == 3
    assert config.deep_merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}


def test_files(spark, tmp_path):
    for e, n in (("ep_a", 3), ("ep_b", 2)):
        (tmp_path / "img" / e).mkdir(parents=True)
        for i in range(n):
            (tmp_path / "img" / e / f"{i:03d}.png").write_bytes(b"x" * (i + 1))
    (tmp_path / "tasks.jsonl").write_text('{"episode_id": "ep_a", "task": "old"}\n\n{"episode_id": "ep_a", "task": "new", "fps": 5}\n')
    side = src.side_metadata(spark, str(tmp_path / "tasks.jsonl"))
    got = {r["episode_id"]: (r["num_frames"], r["task"], r["fps"]) for r in src.build_source(spark, "images", str(tmp_path / "img"), side=side).collect()}
    assert got == {"ep_a": (3, "new", 5.0), "ep_b": (2, None, 10.0)}
    spark.createDataFrame([(0, 0, [1.0, 2.0], [3.0]), (1, 0, [2.0, 3.0], [4.0])], "episode_index long, frame_index long, action array<float>, `observation.state` array<float>").write.parquet(str(tmp_path / "ds" / "data" / "chunk"))
    assert src.vector_frames(spark, str(tmp_path / "ds"), episodes=[1]).collect()[0]["action"] == [2.0, 3.0]
    assert src.vector_frames(spark, str(tmp_path / "ds"), "observation.state").count() == 2
    assert src.feature_names({"features": {"action": {"names": {"motors": ["a", "b"]}}}}) == ["a", "b"]
    assert src.detect(spark, {"fps": 30, "features": {"action": {"names": ["x.pos"]}}})["control_space"] == "joint"
