"""Advisory quality gate: each rule is a table of flags (episode_id, check, detail); flags never drop rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import FAILURE_WORDS, PLACEHOLDER_REASONS, SUCCESS_WORDS, has_unnegated, object_tokens

DATASET = "__dataset__"


@dataclass(frozen=True)
class GateConfig:
    flag_repeated_subtask_text: bool = True
    flag_object_grounding: bool = True
    flag_score_reason_contradiction: bool = True
    flag_degenerate_single_segment: bool = True
    flag_uniform_split: bool = True
    uniform_split_cv_threshold: float = 0.12
    min_segments_for_uniform_check: int = 3
    flag_quality_outlier: bool = True
    quality_outlier_margin: int = 2
    min_distinct_quality_scores: int = 2
    min_episodes_for_dispersion: int = 8


def segment_stats(segments: DataFrame) -> DataFrame:
    """(episode_id, n_segments, n_lengths, mean_length, cv, n_texts, n_distinct_texts), one aggregation for all rules."""
    length = F.col("end_frame") - F.col("start_frame") + 1
    text = F.nullif(F.col("subtask_text"), F.lit(""))
    return segments.groupBy("episode_id").agg(
        F.count("*").alias("n_segments"), F.count(length).alias("n_lengths"), F.avg(length).alias("mean_length"),
        (F.stddev_pop(length) / F.nullif(F.avg(length), F.lit(0.0))).alias("cv"),
        F.count(text).alias("n_texts"), F.count_distinct(F.lower(F.trim(text))).alias("n_distinct_texts"),
    )


def is_degenerate() -> Column:
    return F.coalesce("n_segments", F.lit(0)) <= 1


def is_uniform(cv: float = 0.12, least: int = 3) -> Column:
    return F.coalesce((F.col("n_lengths") >= least) & (F.col("mean_length") > 0) & (F.col("cv") < cv), F.lit(False))


def _flag(df: DataFrame, check: str, detail: str | Column) -> DataFrame:
    return df.select(F.col("episode_id").cast("string").alias("episode_id"), F.lit(check).alias("check"), (detail if isinstance(detail, Column) else F.lit(detail)).alias("detail"))


def repeated_text(stats: DataFrame) -> DataFrame:
    return _flag(stats.where("n_distinct_texts < n_texts"), "repeated_subtask_text", "duplicate subtask text within episode")


def degenerate(episodes: DataFrame, stats: DataFrame) -> DataFrame:
    """Episodes of one segment or none."""
    return _flag(episodes.select("episode_id").join(stats, "episode_id", "left").where(is_degenerate()), "degenerate_single_segment", "a single subtask spans the whole episode")


def uniform(stats: DataFrame, cv: float = 0.12, least: int = 3) -> DataFrame:
    return _flag(stats.where(~is_degenerate() & is_uniform(cv, least)), "uniform_split", "segment lengths are near-uniform (boundaries not grounded to frames)")


def object_grounding(segments: DataFrame, observations: DataFrame) -> DataFrame:
    """First object word of each segment that neither the observation nor the task mentions, as part of a word too.

    ``observations`` is (episode_id, observation, task); episodes without one are skipped.
    """
    seen = observations.where("observation is not null").select("episode_id", F.lower("observation").alias("__o"), F.lower(F.coalesce("task", F.lit(""))).alias("__t"))
    met = segments.select("episode_id", "subtask_text").join(seen, "episode_id")
    missing = F.get(F.filter(object_tokens(F.col("subtask_text")), lambda w: ~F.col("__o").contains(w) & ~F.col("__t").contains(w)), F.lit(0))
    out = met.withColumn("__w", missing).where("__w is not null")
    return _flag(out, "object_grounding", F.concat(F.lit("'"), F.col("__w"), F.lit("' not in stage-one observation")))


def placeholder_reason(metadata: DataFrame) -> DataFrame:
    """Missing or templated reasons; a null reason counts as missing."""
    low = F.lower(F.trim(F.coalesce("reason", F.lit(""))))
    return _flag(metadata.where((low == "") | low.isin(PLACEHOLDER_REASONS)), "placeholder_reason", "missing or templated reason")


def contradictions(metadata: DataFrame) -> DataFrame:
    """Scores that the reason contradicts; an episode can have several. Null mistake is no mistake."""
    quality = F.coalesce(F.nullif("task_success_quality", F.lit(0)), F.col("quality"))
    good, bad = has_unnegated(F.col("reason"), SUCCESS_WORDS), has_unnegated(F.col("reason"), FAILURE_WORDS)
    rows = metadata.where(quality.isNotNull()).select("episode_id", quality.alias("q"), good.alias("good"), bad.alias("bad"), F.coalesce("mistake", F.lit(False)).alias("mistake"))
    found = F.array_compact(F.array(
        F.when((F.col("q") <= 2) & F.col("good") & ~F.col("bad"), "low quality with success reason"),
        F.when((F.col("q") >= 4) & F.col("bad") & ~F.col("good"), "high quality with failure reason"),
        F.when(F.col("mistake") & (F.col("q") >= 5), "mistake=true with perfect quality"),
    ))
    return _flag(rows.select("episode_id", F.explode(found).alias("d")), "score_reason_contradiction", F.col("d"))


def quality_counts(metadata: DataFrame) -> DataFrame:
    return metadata.where("quality is not null").groupBy("quality").agg(F.count("*").alias("n"))


def collapsed_scores(metadata: DataFrame, least_distinct: int = 2, least_episodes: int = 8) -> DataFrame:
    """One row for the dataset if scores hardly differ."""
    stats = metadata.agg(F.count("quality").alias("n"), F.count_distinct("quality").alias("d"), F.array_sort(F.collect_set("quality")).alias("q"))
    bad = stats.where((F.col("n") >= least_episodes) & (F.col("d") < least_distinct)).withColumn("episode_id", F.lit(DATASET))
    return _flag(bad, "collapsed_score_distribution", F.format_string("only %d distinct quality score(s) [%s] across %d episodes", "d", F.array_join(F.col("q").cast("array<string>"), ", "), "n"))


def quality_outliers(metadata: DataFrame, margin: int = 2) -> DataFrame:
    """Scores ``margin`` or more under the median of the dataset, if it has 3 scores."""
    stats = metadata.agg(F.count("quality").alias("__n"), F.percentile("quality", F.lit(0.5)).alias("__m"))
    low = metadata.where("quality is not null").join(F.broadcast(stats), how="cross").where((F.col("__n") >= 3) & (F.col("__m") - F.col("quality") >= margin))  # one row
    return _flag(low, "quality_outlier_needs_review", F.concat(F.lit("quality "), F.col("quality").cast("string"), F.lit(f" is >= {margin} below the dataset median "), F.regexp_replace(F.col("__m").cast("string"), r"\.0$", ""), F.lit("; needs_review")))


def run_gate(episodes: DataFrame, segments: DataFrame, metadata: DataFrame, observations: DataFrame | None = None, config: GateConfig = GateConfig()) -> DataFrame:
    """All enabled flags. Segments are aggregated once for the structural rules."""
    c, stats = config, segment_stats(segments)
    parts = []
    if c.flag_repeated_subtask_text:
        parts.append(repeated_text(stats))
    if c.flag_object_grounding and observations is not None:
        parts.append(object_grounding(segments, observations))
    if c.flag_score_reason_contradiction:
        parts += [placeholder_reason(metadata), contradictions(metadata)]
    if c.flag_degenerate_single_segment:
        parts.append(degenerate(episodes, stats))
    if c.flag_uniform_split:
        parts.append(uniform(stats, c.uniform_split_cv_threshold, c.min_segments_for_uniform_check))
    parts.append(collapsed_scores(metadata, c.min_distinct_quality_scores, c.min_episodes_for_dispersion))
    if c.flag_quality_outlier:
        parts.append(quality_outliers(metadata, c.quality_outlier_margin))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def band_counts(flags: DataFrame) -> DataFrame:
    return flags.where(F.col("check").isin("degenerate_single_segment", "uniform_split")).groupBy("check").agg(F.count("*").alias("n"))


def gate_passed(segments: DataFrame) -> DataFrame:
    """Episodes that retrieval may draw on: two segments or more, not uniform (fixed thresholds)."""
    return segment_stats(segments).where((F.col("n_segments") >= 2) & ~is_uniform(0.12, 3)).select("episode_id")


def needs_review(flags: DataFrame, metadata: DataFrame) -> DataFrame:
    """Flagged outliers with their metadata, worst quality first, unknown last."""
    outliers = flags.where(F.col("check") == "quality_outlier_needs_review").select("episode_id", "detail").dropDuplicates(["episode_id"])
    joined = outliers.join(metadata.drop("detail").withColumn("episode_id", F.col("episode_id").cast("string")), "episode_id")
    return joined.orderBy(F.coalesce("quality", F.lit(99)), "episode_id")
