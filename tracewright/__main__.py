"""Command line: python -m tracewright COMMAND. Paths are tables of annotations, or files named in the options."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import config as cfg
from . import schema
from .functions.names import dims_table
from .operators import corpus, export, gate, gold, metrics, reports, views
from .plans import pipeline, providers
from .sources import episodes as src
from .sources.images import subgoal_images


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tracewright", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    annotated = argparse.ArgumentParser(add_help=False)
    annotated.add_argument("--annotations", required=True)

    c = sub.add_parser("annotate", help="label episodes of a source with a provider")
    c.add_argument("--source", choices=sorted(src.SOURCES), required=True)
    c.add_argument("--target")
    c.add_argument("--out", required=True)
    c.add_argument("--provider", default="mock")
    c.add_argument("--model")
    c.add_argument("--strategy", default="S0")
    c.add_argument("--limit", type=int)
    c.add_argument("--rubric", help="JSON or YAML file of thresholds and vocabularies")
    c.add_argument("--camera-key", help="feature that holds the images of a dataset with several cameras")
    c.add_argument("--fps", type=float, help="frame rate where the source states none")
    c.add_argument("--no-images", action="store_true", help="don't write the images of subgoal frames")
    c = sub.add_parser("run", help="a configured run over a dataset with frames")
    c.add_argument("--config", required=True)
    c.add_argument("--target")
    c.add_argument("--out")
    c.add_argument("--max-episodes", type=int)
    c = sub.add_parser("enrich", parents=[annotated], help="add measures of the action stream and retrieved subgoals")
    c.add_argument("--target", required=True)
    c.add_argument("--out", required=True)
    c.add_argument("--retrieve-subgoals", action="store_true")
    c.add_argument("--seed", type=int, default=0)
    c.add_argument("--episodes")
    sub.add_parser("gate", parents=[annotated], help="flags of an annotations table")
    c = sub.add_parser("query", parents=[annotated], help="segments of a phase, or episodes that need review")
    c.add_argument("--phase")
    c.add_argument("--needs-review", action="store_true")
    c.add_argument("--limit", type=int, default=24)
    c = sub.add_parser("export", parents=[annotated], help="JSON lines, or vocabulary and episode lists")
    c.add_argument("--out", required=True)
    c.add_argument("--format", choices=["jsonl", "subtasks"], default="jsonl")
    c.add_argument("--subtask-field", default="subtask_text")
    sub.add_parser("cost", parents=[annotated], help="cost of stored answers")
    c = sub.add_parser("reliability", help="agreement with human labels")
    c.add_argument("--gold", required=True)
    c = sub.add_parser("trial-report", help="tally of a blind trial")
    c.add_argument("--grades", required=True)
    c.add_argument("--unblind", required=True)
    c.add_argument("--protocol", choices=["mark-failures-only", "mark-all"], default="mark-failures-only")
    c.add_argument("--out")
    c = sub.add_parser("demo", help="generated episodes, mock answers, all modules")
    c.add_argument("--out", required=True)
    c.add_argument("--episodes", type=int, default=3)
    return p


def run(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.command == "annotate":
        episodes = src.first_episodes(src.build_source(spark, a.source, a.target), a.limit)
        if a.fps:
            episodes = episodes.withColumn("fps", F.coalesce("fps", F.lit(a.fps)))
        rubric = cfg.load_rubric(a.rubric)
        strategy, provider = cfg.load_strategy(a.strategy), providers.build_provider(a.provider, a.model)
        labelled = pipeline.label_segments(episodes, provider, strategy, rubric, f"{a.out}/receipts")
        quality = pipeline.label_quality(episodes, provider, rubric, f"{a.out}/receipts")
        segs = labelled.select("episode_id", F.inline("segments")).withColumnRenamed("evidence", "boundary_evidence")
        goals = segs.select("episode_id", "segment_idx", F.col("end_frame").alias("subgoal_frame_idx"))
        own = episodes.withColumns({"source": F.lit(a.source), "provider": F.lit(provider.name), "model": F.lit(provider.model), "strategy": F.lit(strategy.name)})
        if a.source in ("images", "dataset") and not a.no_images:
            frames = src.image_frames(spark, a.target) if a.source == "images" else src.camera_frames(spark, a.target, a.camera_key)
            pictures = subgoal_images(goals, frames.where("content is not null"))
            pictures.write.mode("overwrite").parquet(f"{a.out}/subgoal_images")
            goals = goals.join(spark.read.parquet(f"{a.out}/subgoal_images").select("episode_id", "segment_idx", "subgoal_image_path"), ["episode_id", "segment_idx"], "left")
        schema.write_annotations(schema.flatten(own, quality, segs, goals), f"{a.out}/annotations")
    elif a.command in ("run", "demo"):
        if a.command == "demo":
            c = cfg.RunConfig.of({"run": {"out": a.out, "dataset": {"source": "synthetic"}}, "modules": {m: {"enabled": True} for m in cfg.MODULES if m not in ("novelty", "curation")}})
            (episodes, frames), names, space = src.synthetic(spark, a.episodes), None, None
        else:
            c = cfg.RunConfig.load(a.config)
            target = a.target or c.data["run"]["dataset"]["target"]
            info = src.dataset_info(target)
            episodes = src.first_episodes(src.dataset_episodes(spark, target), a.max_episodes or c.data["run"]["probe"].get("max_episodes"))
            frames, found = src.vector_frames(spark, target).join(episodes.select("episode_id"), "episode_id", "left_semi"), src.detect(spark, info)
            names, space = found["action_names"], found["control_space"]
        model = c.data["run"]["model"]
        provider = providers.build_provider("mock" if a.command == "demo" else model["provider"], None if a.command == "demo" else model["name"])
        out = pipeline.run_pipeline(c, episodes, frames, a.out or c.data["run"]["out"], provider, action_names=names, control_space=space)
        out.groupBy("record_type").count().orderBy("record_type").show()
    elif a.command == "enrich":
        df, info = schema.read_annotations(spark, a.annotations), src.dataset_info(a.target)
        frames, found = src.vector_frames(spark, a.target, episodes=cfg.parse_episodes(a.episodes)), src.detect(spark, info)
        n_dims = frames.select(F.max(F.size("action"))).first()[0] or 0
        out = pipeline.enrich(df, frames, dims_table(spark, found["action_names"], n_dims), control_space=found["control_space"])
        if a.retrieve_subgoals:
            segs = schema.segments_of(out)
            asked = schema.subgoals_of(out).select("episode_id", "segment_idx", F.col("subgoal_frame_idx").alias("frame_idx"))
            picked = corpus.retrieve_seeded(asked, segs, a.seed, gate.gate_passed(segs)).withColumn("record_type", F.lit(schema.SUBGOAL)).drop("frame_idx")
            out = out.drop("retrieved_subgoal_episode_id", "retrieved_subgoal_frame_idx").join(picked, ["episode_id", "segment_idx", "record_type"], "left")
        schema.write_annotations(out, a.out)
    elif a.command == "gate":
        df = schema.read_annotations(spark, a.annotations)
        passed, text = reports.gate_text(gate.run_gate(df.select("episode_id").distinct(), schema.segments_of(df), schema.metadata_of(df)), df)
        print(text)
        return 0 if passed else 1
    elif a.command == "query":
        df = schema.read_annotations(spark, a.annotations)
        if a.phase:
            views.phase_segments(schema.segments_of(df), a.phase).orderBy("episode_id", "segment_idx").limit(a.limit).show(a.limit, False)
        if a.needs_review:
            meta = schema.metadata_of(df)
            gate.needs_review(gate.quality_outliers(meta), meta).select("episode_id", "quality", "detail", "reason").limit(a.limit).show(a.limit, False)
    elif a.command == "export":
        df = schema.read_annotations(spark, a.annotations)
        episodes = df.groupBy("episode_id").agg(F.max("num_frames").alias("num_frames"), F.first("fps", ignorenulls=True).alias("fps"))
        if a.format == "jsonl":
            export.write_json_lines(df, a.out)
        else:
            export.write_subtask_export(schema.segments_of(df), episodes, a.out, a.subtask_field)
    elif a.command == "cost":
        print(reports.as_json(metrics.cost_summary(schema.metadata_of(schema.read_annotations(spark, a.annotations))).first()))
    elif a.command == "reliability":
        print(metrics.reliability_text(metrics.reliability(gold.read_gold(spark, a.gold)).first()))
    elif a.command == "trial-report":
        text = reports.trial_report(spark, a.grades, a.unblind, a.protocol)
        if a.out:
            with open(a.out, "w", encoding="utf-8") as f:
                f.write(text)
        else:
            print(text)
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return run(SparkSession.builder.appName("tracewright").getOrCreate(), args)


if __name__ == "__main__":
    sys.exit(main())
