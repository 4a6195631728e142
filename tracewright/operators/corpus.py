"""Measures relative to the whole corpus: novelty, curation value, guarded tiers, same-phase retrieval.

Corpus statistics are one-row aggregates (partial sums in each task) that are joined back by broadcast; quantiles and
nearest neighbours are exact (``ordering``, ``neighbours``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize
from .neighbours import extend_nearest, nearest
from .ordering import quantiles

MIN_POPULATION = 15
MIN_SPREAD = 0.08


def with_stats(df: DataFrame, **stats: Column) -> DataFrame:
    """Add one-row aggregates of df to its rows."""
    return df.join(F.broadcast(df.agg(*(c.alias(n) for n, c in stats.items()))), how="cross")  # one row


def minmax(df: DataFrame, value: str, out: str) -> DataFrame:
    """value scaled to 0..1 over the corpus, nulls aside; 0.5 for all if there is no spread."""
    with_ends = with_stats(df, __lo=F.min(value), __hi=F.max(value))
    scaled = F.when(F.col("__hi") - F.col("__lo") < 1e-9, 0.5).otherwise((F.col(value) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")))
    return with_ends.withColumn(out, F.when(F.col(value).isNotNull(), scaled)).drop("__lo", "__hi")


def curation_values(df: DataFrame, quality: str = "quality", novelty: str = "novelty", w_quality: float = 0.5, w_novelty: float = 0.5) -> DataFrame:
    """Add curation_value: weighted blend of scaled quality and novelty, a missing side counts 0.5; 4 places."""
    whole = w_quality + w_novelty or 1.0
    scaled = minmax(minmax(df, quality, "__q"), novelty, "__n")
    blend = (w_quality * F.coalesce("__q", F.lit(0.5)) + w_novelty * F.coalesce("__n", F.lit(0.5))) / whole
    return scaled.withColumn("curation_value", F.round(blend, 4)).drop("__q", "__n")


def tierable() -> tuple[dict[str, Column], Column]:
    """Statistics of curation_value and the guard over them: enough rows, spread and distinct values."""
    v = "curation_value"
    stats = {"__pop": F.count(v), "__spread": F.max(v) - F.min(v), "__distinct": F.count_distinct(v)}
    return stats, (F.col("__pop") >= MIN_POPULATION) & (F.col("__spread") >= MIN_SPREAD) & (F.col("__distinct") >= 3)


def tiers(df: DataFrame, top_cut: float | None = None) -> DataFrame:
    """Add curation_tier: terciles minimal, reduced, full; with ``top_cut`` keep (the top share) or cut; null unless
    the population can be tiered. The cuts are exact quantiles, found before the result is read."""
    stats, guard = tierable()
    v = F.col("curation_value")
    if top_cut is not None:
        (cut,) = (F.lit(x).cast("double") for x in quantiles(df, "curation_value", [max(0.0, 1.0 - top_cut)]))
        tier = F.when(v >= cut, "keep").otherwise("cut")
    else:
        lo, hi = (F.lit(x).cast("double") for x in quantiles(df, "curation_value", [1 / 3, 2 / 3]))
        tier = F.when(v <= lo, "minimal").when(v >= hi, "full").otherwise("reduced")
    return with_stats(df, **stats).withColumn("curation_tier", F.when(guard & v.isNotNull(), tier)).drop(*stats)


def speed_tiers(df: DataFrame, cuts: tuple[float, float] = (1 / 3, 2 / 3), min_population: int = MIN_POPULATION) -> DataFrame:
    """Add speed: slow, medium or fast by terciles of speed_norm; null for small or flat populations. The cuts are exact
    quantiles, found before the result is read."""
    v = F.col("speed_norm")
    stats = {"__pop": F.count(v), "__distinct": F.count_distinct(v)}
    lo, hi = (F.lit(x).cast("double") for x in quantiles(df, "speed_norm", cuts))
    tier = F.when(v <= lo, "slow").when(v >= hi, "fast").otherwise("medium")
    guard = (F.col("__pop") >= min_population) & (F.col("__distinct") >= 3) & (hi - lo >= 1e-9)
    return with_stats(df, **stats).withColumn("speed", F.when(guard, tier)).drop(*stats)


# --- novelty


def _vectors(embeddings: DataFrame) -> DataFrame:
    return embeddings.select(F.col("episode_id").alias("id"), F.lit(0).alias("grp"), F.col("episode_id").alias("owner"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))


def _mean_distance(episodes: DataFrame, best: DataFrame) -> DataFrame:
    """(episode_id, novelty) from (id, dist, other); 0 without neighbours. Written once, as corpus statistics and quantiles
    read it several times and neighbours are dear."""
    mean = best.groupBy("id").agg(F.avg("dist").alias("m"))
    joined = episodes.select("episode_id").join(mean, F.col("episode_id") == F.col("id"), "left")
    return materialize(joined.select("episode_id", F.round(F.coalesce("m", F.lit(0.0)), 5).alias("novelty")), "novelty")


def novelty(embeddings: DataFrame, k: int = 5) -> DataFrame:
    """(episode_id, novelty): mean distance to the k nearest other episodes (fewer if there are fewer); 0 alone."""
    rows = _vectors(embeddings)
    return _mean_distance(embeddings, nearest(rows, rows, k))


def pool_keys(pool: DataFrame) -> DataFrame:
    """A pool of datasets with the ids that tell its episodes apart (__id)."""
    return pool.withColumn("__id", F.concat_ws("::", "dataset", "episode_id"))


def pool_neighbours(pool: DataFrame, k: int = 8, before: DataFrame | None = None, neighbours: DataFrame | None = None) -> DataFrame:
    """(id, dist, other) of a pool, to be kept; with those of the pool ``before``, ``pool`` is only what was added to it."""
    rows = _vectors(pool_keys(pool).select(F.col("__id").alias("episode_id"), "embedding"))
    if before is None:
        return nearest(rows, rows, k)
    known = _vectors(pool_keys(before).select(F.col("__id").alias("episode_id"), "embedding"))
    return extend_nearest(neighbours, known, rows, k)


def rescore(pool: DataFrame, k: int = 8, w_quality: float = 0.5, w_novelty: float = 0.5, neighbours: DataFrame | None = None) -> DataFrame:
    """Pooled datasets (dataset, episode_id, embedding, quality, speed_norm): novelty, value, tier and speed over all.

    ``neighbours`` are those of ``pool_neighbours``, where a dataset joins others that are scored already.
    """
    key = pool_keys(pool)
    best = pool_neighbours(pool, k) if neighbours is None else neighbours
    new = _mean_distance(key.select(F.col("__id").alias("episode_id")), best).withColumnRenamed("episode_id", "__id")
    scored = curation_values(key.drop("novelty").join(new, "__id", "left"), w_quality=w_quality, w_novelty=w_novelty)
    return speed_tiers(tiers(scored)).drop("__id", "embedding")


# --- retrieval


def _phase(c: Column) -> Column:
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def candidates_by_phase(segments: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """(phase, episode_id, frame_idx): last frames of segments with a phase, of the allowed episodes if given."""
    out = segments.select(_phase(F.col("phase")).alias("phase"), "episode_id", F.col("end_frame").alias("frame_idx")).where("phase is not null and frame_idx is not null")
    return out if allowed is None else out.join(allowed.select("episode_id").distinct(), "episode_id", "left_semi")


def retrieve_nearest(subgoals: DataFrame, segments: DataFrame, embeddings: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """subgoals (episode_id, segment_idx, frame_idx) with the same-phase frame of another episode that looks nearest.

    ``embeddings`` is (episode_id, frame_idx, embedding). Ties go to the smaller (episode, frame).
    """
    name = lambda: F.concat_ws(":", F.col("episode_id").cast("string"), F.lpad(F.col("frame_idx").cast("string"), 12, "0"))
    vec = embeddings.select("episode_id", "frame_idx", F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    asked = subgoals.join(segments.select("episode_id", "segment_idx", _phase(F.col("phase")).alias("grp")), ["episode_id", "segment_idx"]).where("grp is not null").join(vec, ["episode_id", "frame_idx"])
    q = asked.select(F.concat_ws(":", F.col("episode_id").cast("string"), F.col("segment_idx").cast("string")).alias("id"), "grp", F.col("episode_id").cast("string").alias("owner"), "vector")
    c = candidates_by_phase(segments, allowed).distinct().join(vec, ["episode_id", "frame_idx"])
    c = c.select(name().alias("id"), F.col("phase").alias("grp"), F.col("episode_id").cast("string").alias("owner"), "vector")
    best = nearest(q, c, 1).select(F.col("id").alias("__id"), F.element_at(F.split("other", ":(?=[0-9]+$)"), 1).alias("retrieved_subgoal_episode_id"), F.element_at(F.split("other", ":(?=[0-9]+$)"), 2).cast("int").alias("retrieved_subgoal_frame_idx"))
    keyed = subgoals.withColumn("__id", F.concat_ws(":", F.col("episode_id").cast("string"), F.col("segment_idx").cast("string")))
    return keyed.join(best, "__id", "left").drop("__id")


def retrieve_seeded(subgoals: DataFrame, segments: DataFrame, seed: int = 0, allowed: DataFrame | None = None) -> DataFrame:
    """subgoals with a same-phase frame of another episode picked by seed among all there are.

    Candidates of a phase are numbered so that an episode's stand together: by the first three digits of the episode's
    hash, episode and frame, with sums per digits first. A subgoal draws a place among those of other episodes by its
    own hash, steps over its own episode's run, and meets its pick by an equi-join.
    """
    part = F.substring(F.md5(F.col("episode_id").cast("string")), 1, 3)
    c = candidates_by_phase(segments, allowed)
    held = c.groupBy("phase", "episode_id").agg(F.count("*").alias("m"))
    every = segments.select(_phase(F.col("phase")).alias("phase"), "episode_id").where("phase is not null").distinct()
    runs = every.join(held, ["phase", "episode_id"], "left").select("phase", "episode_id", part.alias("part"), F.coalesce("m", F.lit(0)).alias("m"))
    whole, before = Window.partitionBy("phase"), lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    sums = runs.groupBy("phase", "part").agg(F.sum("m").alias("m"))  # 4,096 rows a phase at most
    sums = sums.select("phase", "part", F.coalesce(F.sum("m").over(before("phase", "part")), F.lit(0)).alias("start"), F.sum("m").over(whole).alias("n"))
    inside = F.coalesce(F.sum("m").over(before("phase", "part", "episode_id")), F.lit(0))
    runs = runs.withColumn("inside", inside).join(sums, ["phase", "part"]).select("phase", "episode_id", "m", "n", (F.col("start") + F.col("inside")).alias("first"))
    own = F.row_number().over(Window.partitionBy("phase", "episode_id").orderBy("frame_idx")) - 1
    numbered = c.withColumn("own", own).join(runs, ["phase", "episode_id"])
    numbered = numbered.select("phase", (F.col("first") + F.col("own")).alias("place"), F.col("episode_id").alias("retrieved_subgoal_episode_id"), F.col("frame_idx").alias("retrieved_subgoal_frame_idx"))
    asked = subgoals.join(segments.select("episode_id", "segment_idx", _phase(F.col("phase")).alias("phase")), ["episode_id", "segment_idx"], "left").join(runs, ["phase", "episode_id"], "left")
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "episode_id", "segment_idx")), 1, 15), 16, 10).cast("long")
    drawn = F.when(F.col("n") > F.col("m"), F.pmod(h, F.col("n") - F.col("m")))
    met = asked.withColumn("place", drawn + F.when(drawn >= F.col("first"), F.col("m")).otherwise(0)).join(numbered, ["phase", "place"], "left")
    return met.select(*subgoals.columns, "retrieved_subgoal_episode_id", "retrieved_subgoal_frame_idx")
