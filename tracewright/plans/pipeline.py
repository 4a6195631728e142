"""Whole runs: annotate with a provider, enrich with the deterministic modules, write the annotations table.

The configuration decides which branches exist; each is a lazy DataFrame keyed by episode_id, and the only actions are
the receipts of model calls and the sink.
"""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Rubric, RunConfig, Strategy
from ..functions.names import dims_table
from ..functions.text import captions, extract_json, frame_answer, is_contact, manifest, metadata_answer
from ..functions.vectors import even_positions
from ..operators import corpus, gate, segments, signals
from ..schema import canonical, flatten
from .providers import Provider, ask

QUESTIONS = {
    "events": "List the physical events with the frame where each is first visible, as JSON with events and objects. Task: ",
    "grounded": "Divide the episode into segments with phase, target, end_frame, evidence and subtask_text, as JSON with segments. Task: ",
    "subtasks": "Divide the episode into segments with end_step and subtask_text, as JSON with segments. Task: ",
    "quality": "Rate the episode: task_success_quality, curation_quality, mistake, boundary_clarity, reason, as JSON. Task: ",
    "refine": "Give the frame of this transition as JSON with frame. Transition: ",
}


def duties(strategy: Strategy, rubric: Rubric) -> str:
    """What an answer to the grounded question is held to, as ``segments.grounded`` will check it."""
    floor = rubric.min_segments if strategy.enforce_min_segments else 1
    said = [f"Give {floor} to {rubric.max_segments} segments.", "Each ends at one of the listed frames (end_frame, a whole number) and states in one clause what is seen there (evidence)."]
    if strategy.closed_vocabulary:
        said.append(f"phase is one of: {', '.join(rubric.phase_vocabulary)}.")
    else:
        said.append("phase is a short verb phrase of your own.")
    if strategy.require_target:
        said.append("target names the object that is acted on so that it is told from others in view; only a withdrawal may have none.")
    if floor > 1:
        said.append("One segment for the whole episode is no answer.")
    return " ".join(said)


def _requests(episodes: DataFrame, stage: str, labels, extra=None, rules: str = "", times: bool = True) -> DataFrame:
    """Questions of a stage. ``rules`` is said before the frames; a column ``rejected`` says why the last answer was no good."""
    kind = stage.split("/")[0]
    shown = manifest(labels, F.col("fps")) if times else F.array_join(F.transform(labels, lambda i: F.format_string("frame %d", i)), ", ")
    parts = [F.lit(QUESTIONS[kind]), F.coalesce("task", "episode_id"), F.lit(f"\n{rules}" if rules else ""), F.lit("\nFrames: "), shown]
    if extra is not None:
        parts += [F.lit("\nObserved: "), extra]
    if "rejected" in episodes.columns:
        parts.append(F.when(F.col("rejected").isNotNull(), F.concat(F.lit("\nThe last answer was rejected: "), "rejected", F.lit(". Answer anew and keep to all that is asked."))).otherwise(""))
    return episodes.select(F.col("episode_id").cast("string").alias("episode_id"), F.lit(stage).alias("stage"), F.concat(*parts).alias("question"), labels.alias("frame_labels"))


def label_segments(episodes: DataFrame, provider: Provider, strategy: Strategy, rubric: Rubric, receipts: str) -> DataFrame:
    """(episode_id, segments, error): segmentation by a strategy.

    Answers that fail the strategy's contract are asked for again, up to its number of attempts; episodes below the
    floor of segments are kept with their error as a warning, or count as failed, by the strategy's policy.
    """
    labels = even_positions(F.col("num_frames"), F.greatest(F.lit(2), F.lit(strategy.frame_count)))
    text = lambda df: df.withColumn("items", segments.parse_answer(extract_json(F.col("answer"))))
    base = episodes.select(F.col("episode_id").cast("string").alias("episode_id"), "task", "num_frames", "fps")
    provider = provider.at(strategy.temperature if strategy.self_consistency_k > 1 else 0.0)  # samples must differ
    if not strategy.grounded:
        got = text(ask(_requests(base, "subtasks", labels), provider, receipts)).select("episode_id", "items").join(base, "episode_id")
        return got.select("episode_id", segments.validated(F.col("items"), F.col("num_frames"), rubric.max_segments).alias("segments"), F.lit(None).cast("string").alias("error"))
    times, rules = strategy.caption_timestamps, duties(strategy, rubric)
    seen = ask(_requests(base, "events", labels, times=times), provider, receipts).select("episode_id", F.col("answer").alias("observations"))
    base = base.join(seen, "episode_id")
    vocabulary = list(rubric.phase_vocabulary) if strategy.closed_vocabulary else None
    samples = None
    for sample in range(strategy.self_consistency_k):
        todo, done = base, None
        for attempt in range(strategy.max_label_attempts):
            stage = f"grounded/s{sample}_a{attempt}"
            got = text(ask(_requests(todo, stage, labels, F.col("observations"), rules, times), provider, receipts)).select("episode_id", "items").join(todo, "episode_id")
            segs, error = segments.grounded(F.col("items"), F.col("num_frames"), vocabulary=vocabulary, require_target=strategy.require_target, min_segments=rubric.min_segments if strategy.enforce_min_segments else None, most=rubric.max_segments)
            tried = got.select("episode_id", "num_frames", segs.alias("segments"), error.alias("error"), F.lit(sample).alias("sample"))
            fine = F.col("error").isNull() | (F.col("error").startswith("below min") & F.lit(strategy.min_granularity_policy == "warn"))
            last = attempt == strategy.max_label_attempts - 1
            kept = tried if last else tried.where(fine)
            done = kept if done is None else done.unionByName(kept)
            if last or tried.where(~fine).isEmpty():
                break
            todo = todo.drop("rejected").join(tried.where(~fine).select("episode_id", F.col("error").alias("rejected")), "episode_id")
        samples = done if samples is None else samples.unionByName(done)
    if strategy.self_consistency_k > 1:
        out = segments.combined_samples(samples).withColumn("error", F.lit(None).cast("string"))
    else:
        out = samples.select("episode_id", "segments", "error")
    return refine_boundaries(out, base, provider, strategy, receipts) if strategy.refine_boundaries else out


def refine_boundaries(labelled: DataFrame, episodes: DataFrame, provider: Provider, strategy: Strategy, receipts: str) -> DataFrame:
    """Ask for the exact frame of every boundary (of contact phases only, if the strategy says so), then move them in order."""
    rows = labelled.join(episodes.select("episode_id", "task", "num_frames", "fps"), "episode_id")
    pairs = F.transform(F.slice("segments", 1, F.greatest(F.size("segments") - 1, F.lit(0))), lambda s, i: F.struct(i.alias("i"), s["end_frame"].alias("b"), s["phase"].alias("p"), F.get("segments", i + 1)["phase"].alias("q")))
    each = rows.select("episode_id", "num_frames", "fps", F.inline(pairs))
    if strategy.refine_contact_only:
        each = each.where(is_contact(F.col("p")) | is_contact(F.col("q")))
    lo, hi = F.greatest(F.lit(0), F.col("b") - strategy.refine_window), F.least(F.col("num_frames") - 1, F.col("b") + strategy.refine_window)
    window = signals.dense_window(lo.cast("int"), hi.cast("int"), strategy.refine_max_frames)
    asked = each.withColumn("labels", window).where(F.size("labels") >= 2)
    asked = asked.select("episode_id", "i", F.concat(F.lit("refine/b"), F.col("i").cast("string")).alias("stage"), F.concat(F.lit(QUESTIONS["refine"]), F.coalesce("p", F.lit("")), F.lit(" to "), F.coalesce("q", F.lit("")), F.lit("\n"), F.array_join(captions(F.col("labels"), F.col("fps")), ", ")).alias("question"), F.col("labels").alias("frame_labels"))
    got = ask(asked.drop("i"), provider, receipts).select("episode_id", F.regexp_extract("stage", r"(\d+)$", 1).cast("int").alias("i"), frame_answer(extract_json(F.col("answer"))).alias("f"))
    per = got.groupBy("episode_id").agg(F.map_from_entries(F.collect_list(F.struct("i", "f"))).alias("answers"))
    joined = rows.join(per, "episode_id", "left")
    answers = F.transform(F.sequence(F.lit(0), F.size("segments")), lambda i: F.element_at(F.coalesce("answers", F.create_map().cast("map<int,int>")), i))
    return joined.select("episode_id", segments.refined(F.col("segments"), answers, strategy.refine_window, F.col("num_frames")).alias("segments"), "error")


def label_quality(episodes: DataFrame, provider: Provider, rubric: Rubric, receipts: str) -> DataFrame:
    """(episode_id, quality, task_success_quality, mistake, boundary_clarity, control_mode, reason)."""
    labels = even_positions(F.col("num_frames"), F.lit(rubric.keyframes))
    got = ask(_requests(episodes, "quality", labels), provider, receipts)
    return got.select("episode_id", metadata_answer(extract_json(F.col("answer"))).alias("m")).select("episode_id", "m.*")


def run_pipeline(config: RunConfig, episodes: DataFrame, frames: DataFrame | None, out: str, provider: Provider, rubric: Rubric = Rubric(), embeddings: DataFrame | None = None, action_names: list[str] | None = None, control_space: str | None = None) -> DataFrame:
    """Annotations of all episodes with the enabled modules, written to ``out`` and read back.

    frames: (episode_id, frame_idx, action); embeddings: (episode_id, frame_idx, embedding). Episodes without an answer
    are in the failures table of the receipts, not in the result's segments.
    """
    config.validate()
    on, spark = set(config.enabled()), episodes.sparkSession
    episodes = episodes.withColumn("episode_id", F.col("episode_id").cast("string"))
    receipts = f"{out}/receipts"
    strategy = config.strategy()
    own = episodes.withColumns({"source": F.lit(config.data["run"]["dataset"]["source"]), "provider": F.lit(provider.name), "model": F.lit(provider.model), "strategy": F.lit(strategy.name)})

    segs = meta = goals = None
    if "segmentation" in on:
        labelled = label_segments(episodes, provider, strategy, rubric, receipts)
        if config.module("segmentation").get("snap_contact") and frames is not None:
            grip = frames.select("episode_id", "frame_idx", F.element_at("action", -1).alias("x"))
            moves = signals.debounced(signals.transitions(grip, rubric.gripper_norm_threshold), rubric.min_transition_frames)
            moves = moves.groupBy("episode_id").agg(F.array_sort(F.collect_list(F.struct("frame_idx", "kind"))).alias("moves"))
            labelled = labelled.join(moves, "episode_id", "left").withColumn("segments", F.when(F.col("moves").isNotNull(), segments.snapped(F.col("segments"), F.col("moves"), rubric.snap_window)).otherwise(F.col("segments")))
        segs = labelled.select("episode_id", F.inline("segments")).withColumnRenamed("evidence", "boundary_evidence")
        if "control" in on and config.module("control").get("active_dof") and frames is not None:
            n_dims = frames.select(F.max(F.size("action"))).first()[0] or 0
            dims = dims_table(spark, action_names, n_dims, rubric.control_groups, rubric.default_group)
            segs = signals.active_sets(frames, segs, dims, rubric.control_threshold, rubric.control_smooth)
        if "subgoals" in on:
            cut = segs.join(episodes.select("episode_id", "num_frames"), "episode_id")
            goals = cut.select("episode_id", "segment_idx", F.least(F.greatest("end_frame", F.lit(0)), F.col("num_frames") - 1).alias("subgoal_frame_idx"))
    # an episode-level module of any kind gives every episode a metadata row
    if on - {"segmentation", "subgoals"}:
        meta = episodes.select("episode_id", "fps")
    if "quality" in on:
        meta = meta.join(label_quality(episodes, provider, rubric, receipts), "episode_id", "left")
    if "speed" in on and frames is not None:
        windows = signals.active_windows(frames, rubric.motion_rel_threshold, rubric.motion_smooth)
        cuts = tuple(config.module("speed").get("cuts", (1 / 3, 2 / 3)))
        speed = signals.active_seconds(corpus.speed_tiers(windows, cuts, rubric.min_population), episodes)
        meta = meta.join(speed.select("episode_id", F.round("speed_norm", 6).alias("speed_norm"), "speed", "active_frames", "active_seconds", "active_fraction"), "episode_id", "left")
    if "control" in on:
        meta = meta.withColumn("control_modality", F.lit(control_space).cast("string"))
    if "novelty" in on and embeddings is not None:
        meta = meta.join(corpus.novelty(signals.episode_embeddings(embeddings), int(config.module("novelty").get("k", 5))), "episode_id", "left")
    if "curation" in on and "novelty" in meta.columns:
        w = config.module("curation").get("weights", {})
        meta = corpus.tiers(corpus.curation_values(meta, w_quality=w.get("quality", 0.5), w_novelty=w.get("novelty", 0.5)), config.module("curation").get("top_cut"))
    if goals is not None and config.module("subgoals").get("retrieval"):
        asked = goals.withColumnRenamed("subgoal_frame_idx", "frame_idx")
        allowed = gate.gate_passed(segs)
        if config.module("subgoals").get("retrieval_method") == "embedding" and embeddings is not None:
            goals = corpus.retrieve_nearest(asked, segs, embeddings, allowed)
        else:
            goals = corpus.retrieve_seeded(asked, segs, int(config.data["run"].get("seed", 0)), allowed)
        goals = goals.withColumnRenamed("frame_idx", "subgoal_frame_idx")
    spark.range(1).select(F.lit(json.dumps({"strategy": asdict(strategy)}, sort_keys=True)).alias("value")).write.mode("overwrite").text(f"{out}/strategy")
    canonical(flatten(own, None if meta is None else meta.drop("fps"), segs, goals)).write.mode("overwrite").parquet(f"{out}/annotations")
    return spark.read.parquet(f"{out}/annotations")


def enrich(annotations: DataFrame, frames: DataFrame, dims: DataFrame, rubric: Rubric = Rubric(), control_space: str | None = None) -> DataFrame:
    """Existing annotations with active_dof of segments, modality and speed of episodes computed anew."""
    is_seg, is_meta = F.col("record_type") == "subtask", F.col("record_type") == "episode_metadata"
    active = signals.active_sets(frames, annotations.where(is_seg).select("episode_id", "segment_idx", "start_frame", "end_frame"), dims, rubric.control_threshold, rubric.control_smooth).select("episode_id", "segment_idx", F.col("active_dof").alias("__dof"))
    windows = corpus.speed_tiers(signals.active_windows(frames, rubric.motion_rel_threshold, rubric.motion_smooth), min_population=rubric.min_population)
    windows = windows.select("episode_id", F.round("speed_norm", 6).alias("__norm"), F.col("speed").alias("__speed"), F.col("active_frames").alias("__af"), F.col("active_fraction").alias("__fr"))
    out = annotations.join(active, ["episode_id", "segment_idx"], "left").join(windows, "episode_id", "left")
    fps = F.coalesce(F.nullif("fps", F.lit(0.0)), F.lit(30.0))
    put = {
        "active_dof": F.when(is_seg, F.coalesce("__dof", "active_dof")).otherwise(F.col("active_dof")),
        "control_modality": F.when(is_meta, F.lit(control_space).cast("string")).otherwise(F.col("control_modality")),
        "speed_norm": F.when(is_meta, F.col("__norm")).otherwise(F.col("speed_norm")), "speed": F.when(is_meta, F.col("__speed")).otherwise(F.col("speed")),
        "active_frames": F.when(is_meta, F.col("__af")).otherwise(F.col("active_frames")), "active_fraction": F.when(is_meta, F.col("__fr")).otherwise(F.col("active_fraction")),
        "active_seconds": F.when(is_meta, F.round(F.col("__af") / fps, 3)).otherwise(F.col("active_seconds")),
    }
    return out.withColumns(put).select(*annotations.columns)
