"""Agreement of segmentations and labels: interval IoU, boundary precision and recall, reliability, trials, cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def temporal_iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """IoU of inclusive intervals; the union is their hull. Null if an end is null."""
    known = a0.isNotNull() & a1.isNotNull() & b0.isNotNull() & b1.isNotNull()
    inter = F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0) + 1)
    hull = F.greatest(a1, b1) - F.least(a0, b0) + 1
    return F.when(known & (hull > 0), inter / hull.cast("double"))


def paired(auto: DataFrame, gold: DataFrame, by: str = "position") -> DataFrame:
    """Segments of two tracks side by side: by place in their order, shorter one wins, or by segment_idx.

    Columns: episode_id, place, a_start, a_end, g_start, g_end.
    """

    def placed(df: DataFrame, prefix: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("episode_id").orderBy("segment_idx")) if by == "position" else F.col("segment_idx")
        return df.select("episode_id", place.alias("place"), F.col("start_frame").alias(f"{prefix}_start"), F.col("end_frame").alias(f"{prefix}_end"))

    return placed(auto, "a").join(placed(gold, "g"), ["episode_id", "place"])


def segment_ious(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("iou", temporal_iou(F.col("a_start"), F.col("a_end"), F.col("g_start"), F.col("g_end")))


def episode_iou(auto: DataFrame, gold: DataFrame, by: str = "position") -> DataFrame:
    """(episode_id, iou): mean over the pairs that have one."""
    return segment_ious(paired(auto, gold, by)).groupBy("episode_id").agg(F.avg("iou").alias("iou"))


def boundaries(segments: DataFrame) -> DataFrame:
    """(episode_id, place, b): ends of all segments but the last."""
    w = Window.partitionBy("episode_id").orderBy("segment_idx")
    rows = segments.select("episode_id", F.row_number().over(w).alias("place"), F.col("end_frame").alias("b"), F.lead("segment_idx").over(w).alias("__next"))
    return rows.where("__next is not null and b is not null").drop("__next")


def greedy_errors(pred: Column, gold: Column, tol: int) -> Column:
    """Errors of matches: each gold boundary, ascending, takes the nearest unused predicted one within tol (the first of
    equals). An ordered fold whose state is what is left and the errors so far."""
    state = lambda left, errors: F.struct(left.alias("left"), errors.alias("errors"))
    empty = F.array().cast("array<int>")

    def step(s, g):
        near = F.array_sort(F.filter(F.transform(s["left"], lambda p, i: F.struct(F.abs(p - g).alias("d"), i.alias("i"))), lambda x: x["d"] <= tol))
        best = F.get(near, F.lit(0))
        rest = F.filter(s["left"], lambda p, i: i != best["i"])
        return F.when(F.size(near) > 0, state(rest, F.concat(s["errors"], F.array(best["d"].cast("int"))))).otherwise(s)

    return F.aggregate(F.array_sort(gold), state(pred, empty), step, lambda s: s["errors"])


def boundary_scores(auto: DataFrame, gold: DataFrame, tol: int = 5) -> DataFrame:
    """(episode_id, matched, n_pred, n_gold, precision, recall, mae) over episodes of both tracks."""

    def lists(df: DataFrame, name: str) -> DataFrame:
        per = boundaries(df).groupBy("episode_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "b"))), lambda x: x["b"].cast("int")).alias(name))
        return df.select("episode_id").distinct().join(per, "episode_id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<int>")))

    both = lists(auto, "pred").join(lists(gold, "gold"), "episode_id").withColumn("errors", greedy_errors(F.col("pred"), F.col("gold"), tol))
    m, p, g = F.size("errors"), F.size("pred"), F.size("gold")
    ratio = lambda x: F.when(x > 0, m / x.cast("double"))
    mae = F.when(m > 0, F.aggregate("errors", F.lit(0), lambda s, e: s + e) / m.cast("double"))
    return both.select("episode_id", m.cast("long").alias("matched"), p.cast("long").alias("n_pred"), g.cast("long").alias("n_gold"), ratio(p).alias("precision"), ratio(g).alias("recall"), mae.alias("mae"))


def track_metrics(tracks: DataFrame, gold_track: str = "gold", tol: int = 5) -> DataFrame:
    """tracks (episode_id, track, segment_idx, start_frame, end_frame) against the gold track: one row a track, 4 places."""
    gold = tracks.where(F.col("track") == gold_track).drop("track")
    others = tracks.where(F.col("track") != gold_track)
    # episode and track as one key, so both metrics run once for all tracks
    key = F.struct("episode_id", "track")
    autos = others.withColumn("episode_id", key)
    golds = others.select("episode_id", "track").distinct().join(gold, "episode_id").withColumn("episode_id", key).drop("track")
    joined = boundary_scores(autos, golds, tol).join(episode_iou(autos, golds), "episode_id", "left")
    r = lambda c: F.round(c, 4).alias(c)
    return joined.select("episode_id.episode_id", "episode_id.track", r("iou"), r("precision"), r("recall"), r("mae"), "matched", "n_pred", "n_gold")


def min_iou(metrics: DataFrame) -> DataFrame:
    """(episode_id, sort_iou): least IoU over tracks, 1 if there is none."""
    return metrics.groupBy("episode_id").agg(F.coalesce(F.min("iou"), F.lit(1.0)).alias("sort_iou"))


def share(pred: Column) -> Column:
    return F.avg(pred.cast("double"))


def reliability(gold: DataFrame, by: str = "position") -> DataFrame:
    """One row over a gold table (episode_id, auto, gold: structs of subtasks, metadata, subgoals).

    Only what a reviewer accepted or filled counts. Gold segments pair with auto segments by place after unreviewed ones
    are left out; ``by="segment_idx"`` pairs by number instead.
    """
    g = gold.select(
        "episode_id", F.col("auto.subtasks").alias("a_seg"), F.col("auto.metadata.quality").alias("a_q"), F.col("auto.subgoals").alias("a_goal"),
        F.filter("gold.subtasks", lambda s: F.coalesce(s["accept_auto"], F.lit(False)) | s["start_frame"].isNotNull() | s["end_frame"].isNotNull()).alias("g_seg"),
        F.when(F.coalesce("gold.metadata.accept_auto", F.lit(False)) | F.col("gold.metadata.quality").isNotNull(), F.col("gold.metadata.quality")).alias("g_q"),
        (F.coalesce("gold.metadata.accept_auto", F.lit(False)) | F.col("gold.metadata.quality").isNotNull()).alias("g_meta"),
        F.filter("gold.subgoals", lambda s: F.coalesce(s["accept_auto"], F.lit(False)) | s["frame_idx"].isNotNull()).alias("g_goal"),
    )

    def pair(s, i):
        a = F.get(F.col("a_seg"), i) if by == "position" else F.get(F.filter("a_seg", lambda x: x["segment_idx"] == s["segment_idx"]), F.lit(0))
        ok = F.coalesce(s["accept_auto"], F.lit(False))
        return temporal_iou(a["start_frame"], a["end_frame"], F.when(ok, a["start_frame"]).otherwise(s["start_frame"]), F.when(ok, a["end_frame"]).otherwise(s["end_frame"]))

    goal = lambda s: F.coalesce(F.get(F.filter("a_goal", lambda a: a["segment_idx"] == s["segment_idx"]), F.lit(0))["frame_idx"] == s["frame_idx"], F.lit(False))
    rows = g.select(
        "episode_id", F.filter(F.transform("g_seg", pair), lambda x: x.isNotNull()).alias("ious"),
        F.transform(F.filter("g_goal", lambda s: s["segment_idx"].isNotNull() & s["frame_idx"].isNotNull()), goal).alias("goals"), "a_q", "g_q",
        ((F.size("g_seg") > 0) | F.col("g_meta") | (F.size("g_goal") > 0)).alias("reviewed"),
    )
    both = F.col("a_q").isNotNull() & F.col("g_q").isNotNull()
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    return rows.agg(
        F.count("*").alias("episode_count"), F.count_if("reviewed").alias("reviewed_episode_count"),
        (F.sum(total(F.col("ious"))) / F.nullif(F.sum(F.size("ious")), F.lit(0))).alias("boundary_iou_mean"),
        share(F.when(both, F.col("a_q") == F.col("g_q"))).alias("quality_exact"),
        share(F.when(both, F.abs(F.col("a_q") - F.col("g_q")) <= 1)).alias("quality_within_one"),
        (F.sum(F.size(F.filter("goals", lambda x: x))) / F.nullif(F.sum(F.size("goals")), F.lit(0))).alias("subgoal_agreement"),
    )


def reliability_text(row) -> str:
    pct = lambda x: "n/a" if x is None else f"{x:.3f}"
    return "\n".join([
        f"Reliability over {row['reviewed_episode_count']}/{row['episode_count']} reviewed episodes",
        f"  subtask boundary temporal IoU (mean): {pct(row['boundary_iou_mean'])}",
        f"  quality exact agreement:              {pct(row['quality_exact'])}",
        f"  quality within-one agreement:         {pct(row['quality_within_one'])}",
        f"  subgoal frame agreement:              {pct(row['subgoal_agreement'])}",
    ])


def marks_of(marks: Column, kind: str) -> Column:
    """Values of the marks whose key starts with ``kind``."""
    some = F.coalesce(marks, F.create_map().cast("map<string,boolean>"))
    return F.map_values(F.map_filter(some, lambda k, v: k.startswith(kind)))


def trial_tally(grades: DataFrame, unblind: DataFrame, protocol: str = "mark-failures-only") -> DataFrame:
    """grades (item_id, marks MAP<STRING,BOOLEAN>, verdict) and unblind (item_id, strategy, bands, b, p, e: numbers of
    marks) -> one row a strategy. mark-failures-only: what isn't marked false passes; mark-all: share of true marks."""
    met = grades.join(unblind, "item_id")
    aggs = [F.count("*").alias("n_items"), F.count_if("bands").alias("n_failure_band"), share(F.coalesce("bands", F.lit(False))).alias("failure_band_rate")]
    names = {"b": ("boundary_acceptance", "n_boundaries"), "p": ("phase_accuracy", "n_phases"), "e": ("evidence_factual_accuracy", "n_evidence")}
    for kind, (rate, n) in names.items():
        marks = marks_of(F.col("marks"), kind)
        true, false = F.sum(F.size(F.filter(marks, lambda v: v))), F.sum(F.size(F.filter(marks, lambda v: ~v)))
        count = F.sum(F.size(marks)) if protocol == "mark-all" else F.sum(F.coalesce(kind, F.lit(0)))
        value = true / F.nullif(count, F.lit(0)) if protocol == "mark-all" else 1 - false / F.nullif(count, F.lit(0))
        aggs += [value.alias(rate), count.cast("long").alias(n)]
    aggs += [F.count_if(F.col("verdict") == v).alias(v) for v in ("usable", "touchup", "garbage")]
    return met.groupBy(F.coalesce("strategy", F.lit("?")).alias("strategy")).agg(*aggs)


#: Price in USD for a million tokens, by the part of a model's name looked for in this order; fixed values.
PRICES = (("flash-lite", 0.10, 0.40), ("2.5-flash", 0.30, 2.50), ("2.5-pro", 1.25, 10.00))


def call_cost(model: Column, prompt_tokens: Column, output_tokens: Column) -> Column:
    """Estimated USD of a call; null for models without a price."""
    out = F.lit(None).cast("double")
    for part, price_in, price_out in reversed(PRICES):
        cost = F.coalesce(prompt_tokens, F.lit(0)) / F.lit(1e6) * price_in + F.coalesce(output_tokens, F.lit(0)) / F.lit(1e6) * price_out
        out = F.when(F.contains(F.lower(model), F.lit(part)), cost).otherwise(out)
    return out


def cost_summary(metadata: DataFrame, receipts: DataFrame | None = None) -> DataFrame:
    """One row: total cost (null if none is known), episodes with a cost, cost an episode (null if nothing was spent), receipts."""
    paid = metadata.agg(F.round(F.sum("cost_usd"), 6).alias("total_cost_usd"), F.count("cost_usd").alias("episodes_with_cost"), F.count("*").alias("episode_count"))
    out = paid.withColumn("cost_per_episode", F.round(F.nullif("total_cost_usd", F.lit(0.0)) / F.nullif("episode_count", F.lit(0)), 6))
    if receipts is None:
        return out.withColumn("receipt_count", F.lit(0).cast("long"))
    return out.join(F.broadcast(receipts.agg(F.count("*").alias("receipt_count"))), how="cross")  # one row each
