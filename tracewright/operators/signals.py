"""Motion signals of episodes: velocities, moving averages, active windows, excursions, gripper transitions.

``frames`` is (episode_id, frame_idx, action ARRAY<DOUBLE>), one row a frame. Every window is partitioned by episode, so
one shuffle by episode_id serves them all, and an episode is bounded by its recording.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import at, difference_norm, even_positions, let, weigh
from .intervals import interval_join

EPISODE = "episode_id"
#: A table of dimensions may be broadcast up to so many rows.
MAX_DIMS = 100_000


def by_frame(order: str = "frame_idx") -> Window:
    return Window.partitionBy(EPISODE).orderBy(order)


def number_frames(rows: DataFrame, order: list[str]) -> DataFrame:
    """frame_idx from an order of rows within each episode, 0-based."""
    return rows.withColumn("frame_idx", F.row_number().over(Window.partitionBy(EPISODE).orderBy(*order)) - 1)


def step_velocity(frames: DataFrame) -> DataFrame:
    """(episode_id, i, v): distance of each action to the next, i the earlier frame's place."""
    w = by_frame()
    steps = frames.select(EPISODE, (F.row_number().over(w) - 2).alias("i"), "action", F.lag("action").over(w).alias("__before"))
    return steps.where("i >= 0").select(EPISODE, "i", difference_norm(F.col("action"), F.col("__before")).alias("v"))


def moving_average_same(df: DataFrame, value: str, order: str, k: int, out: str) -> DataFrame:
    """Centred moving average with zeros beyond the ends and a fixed divisor; series shorter than k stay as they are."""
    near = by_frame(order).rowsBetween(-(k // 2), (k - 1) // 2)
    if k <= 1:
        return df.withColumn(out, F.col(value))
    n = F.count("*").over(Window.partitionBy(EPISODE))
    return df.withColumn(out, F.when(n >= k, F.sum(value).over(near) / k).otherwise(F.col(value)))


def moving_average_valid(df: DataFrame, value: str, order: str, k: int, out: str, keys: list[str]) -> DataFrame:
    """Moving average over full windows only, within ``keys``; series shorter than k (or k <= 1) stay as they are."""
    w = Window.partitionBy(*keys).orderBy(order)
    n, place = F.count("*").over(Window.partitionBy(*keys)), F.row_number().over(w)
    mean = F.sum(value).over(w.rowsBetween(1 - k, 0)) / k
    smooth = (n >= k) & F.lit(k > 1)
    return df.withColumns({"__n": n, "__place": place, out: F.when(smooth, mean).otherwise(F.col(value))}).where((F.col("__n") < k) | (F.col("__place") >= k) | F.lit(k <= 1)).drop("__n", "__place")


def with_quantile(df: DataFrame, value: str, p: float, out: str) -> DataFrame:
    """Add the exact quantile of a column over each episode, nulls aside, between two values as ``weigh`` gives it: that is what the
    SQL engine compares with. Spark's ``percentile`` rounds once more and may pass a value it stands beside."""
    whole = Window.partitionBy(EPISODE)
    rank = F.row_number().over(whole.orderBy(F.col(value).asc_nulls_last())) - 1
    ranked = df.withColumns({"__rank": rank, "__place": (F.count(value).over(whole) - 1) * F.lit(float(p))})
    at = lambda place: F.max(F.when(F.col("__rank") == place, F.col(value))).over(whole)
    ends = ranked.withColumns({"__a": at(F.floor("__place")), "__b": at(F.ceil("__place"))})
    return ends.withColumn(out, weigh(F.col("__a"), F.col("__b"), F.col("__place") - F.floor("__place"))).drop("__rank", "__place", "__a", "__b")


def speed_norms(frames: DataFrame) -> DataFrame:
    """(episode_id, n, speed_norm): mean step velocity, 0 for episodes of one frame."""
    n = frames.groupBy(EPISODE).agg(F.count("*").alias("n"))
    mean = step_velocity(frames).groupBy(EPISODE).agg(F.avg("v").alias("speed_norm"))
    return n.join(mean, EPISODE, "left").withColumn("speed_norm", F.coalesce("speed_norm", F.lit(0.0)))


def active_windows(frames: DataFrame, rel_threshold: float = 0.12, smooth: int = 5) -> DataFrame:
    """(episode_id, n, speed_norm, onset, offset, active_frames, active_fraction).

    The window is from the first to one past the last smoothed velocity above a share of the episode's 90th percentile
    (of the maximum if that is 0). Under 3 frames: offset n - 1 and nothing active; none above: 0 to 0.
    """
    v = moving_average_same(step_velocity(frames), "v", "i", smooth, "s")
    whole = Window.partitionBy(EPISODE)
    above = with_quantile(v, "s", 0.9, "__q")
    above = above.withColumn("__ref", F.coalesce(F.nullif("__q", F.lit(0.0)), F.max("s").over(whole)))
    above = above.withColumn("__i", F.when(F.col("s") > rel_threshold * F.col("__ref"), F.col("i")))
    per = above.groupBy(EPISODE).agg((F.count("*") + 1).alias("n"), F.avg("v").alias("speed_norm"), F.min("__i").alias("on"), (F.max("__i") + 1).alias("off"))
    single = frames.groupBy(EPISODE).agg(F.count("*").alias("n")).where("n < 2").select(EPISODE, "n", F.lit(0.0).alias("speed_norm"), F.lit(None).cast("int").alias("on"), F.lit(None).cast("int").alias("off"))
    per = per.unionByName(single)
    short = F.col("n") < 3
    onset = F.when(short, 0).otherwise(F.coalesce("on", F.lit(0)))
    offset = F.when(short, F.col("n") - 1).otherwise(F.coalesce("off", F.lit(0)))
    active = F.when(short, 0).otherwise(F.coalesce(F.col("off") - F.col("on"), F.lit(0)))
    return per.select(
        EPISODE, "n", "speed_norm", onset.cast("long").alias("onset"), offset.cast("long").alias("offset"), active.cast("long").alias("active_frames"),
        F.round(active / F.col("n").cast("double"), 4).alias("active_fraction"),
    )


def active_seconds(windows: DataFrame, episodes: DataFrame) -> DataFrame:
    """Add active_seconds from episodes' fps (3 places)."""
    return windows.join(episodes.select(EPISODE, "fps"), EPISODE, "left").withColumn("active_seconds", F.round(F.col("active_frames") / F.coalesce(F.nullif("fps", F.lit(0.0)), F.lit(30.0)), 3)).drop("fps")


def excursions(frames: DataFrame, segments: DataFrame, smooth: int = 5) -> DataFrame:
    """(episode_id, segment_idx, dim, n, excursion): range of the smoothed segment over the range of the episode.

    Frames meet the segments of their bin (``interval_join``) before their dimensions become rows; segments without frames
    are absent. Ends beyond the last frame are cut.
    """
    ranges = frames.select(EPISODE, F.posexplode("action").alias("dim", "x")).groupBy(EPISODE, "dim").agg((F.max("x") - F.min("x")).alias("range"))
    met = interval_join(frames.select(EPISODE, "frame_idx", "action"), segments.select(EPISODE, "segment_idx", "start_frame", "end_frame"), [EPISODE], "frame_idx", "start_frame", "end_frame")
    inside = met.select(EPISODE, "segment_idx", "frame_idx", F.posexplode("action").alias("dim", "x"))
    inside = inside.withColumn("n", F.count("*").over(Window.partitionBy(EPISODE, "segment_idx", "dim")))
    smoothed = moving_average_valid(inside, "x", "frame_idx", smooth, "y", [EPISODE, "segment_idx", "dim"])
    per = smoothed.groupBy(EPISODE, "segment_idx", "dim").agg(F.first("n").alias("n"), (F.max("y") - F.min("y")).alias("moved"))
    return per.join(ranges, [EPISODE, "dim"]).select(EPISODE, "segment_idx", "dim", "n", (F.col("moved") / F.greatest("range", F.lit(1e-6))).alias("excursion"))


def active_sets(frames: DataFrame, segments: DataFrame, dims: DataFrame, threshold: float = 0.25, smooth: int = 5) -> DataFrame:
    """segments with active_dof: the sorted groups of which a dimension moves by more than ``threshold``, or "none".

    ``dims`` is (dim, grp), one row a dimension of the action space. Episodes without two frames of actions get null.
    """
    few = dims.limit(MAX_DIMS + 1).count() <= MAX_DIMS  # dimensions of an action vector
    moved = excursions(frames, segments, smooth).join(F.broadcast(dims) if few else dims, "dim")
    active = moved.where((F.col("n") >= 2) & (F.col("excursion") > threshold)).groupBy(EPISODE, "segment_idx").agg(F.array_join(F.array_sort(F.collect_set("grp")), "+").alias("active_dof"))
    known = frames.groupBy(EPISODE).agg((F.count("*") >= 2).alias("__known"))
    out = segments.drop("active_dof").join(active, [EPISODE, "segment_idx"], "left").join(known, EPISODE, "left")
    return out.withColumn("active_dof", F.when(F.col("__known"), F.coalesce("active_dof", F.lit("none")))).drop("__known")


# --- gripper transitions


def transitions(series: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(episode_id, frame_idx, kind) where a series (episode_id, frame_idx, x) crosses the threshold.

    x is scaled to its range; below the threshold is closed. kind is close or open by the state at frame_idx. Flat
    series have none.
    """
    whole = Window.partitionBy(EPISODE)
    span = F.max("x").over(whole) - F.min("x").over(whole)
    closed = series.withColumns({"__span": span, "__closed": (F.col("x") - F.min("x").over(whole)) / span < threshold}).where("__span > 1e-9")
    flipped = closed.withColumn("__was", F.lag("__closed").over(by_frame()))
    return flipped.where("__was <> __closed").select(EPISODE, "frame_idx", F.when(F.col("__closed"), "close").otherwise("open").alias("kind"))


def keep_spaced(xs: Column, spacing: Column | int, key=lambda x: x) -> Column:
    """Of a sorted array keep each element at least ``spacing`` after the last kept one."""
    def step(kept, x):
        far = (F.size(kept) == 0) | (key(x) - key(F.element_at(kept, -1)) >= spacing)
        return F.when(far, F.concat(kept, F.array(x))).otherwise(kept)

    return F.aggregate(xs, F.slice(xs, 1, 0), step)


def debounced(events: DataFrame, min_spacing: int = 8) -> DataFrame:
    """Transitions with those closer than ``min_spacing`` to the last kept one left out; an ordered fold per episode."""
    per = events.groupBy(EPISODE).agg(F.array_sort(F.collect_list(F.struct("frame_idx", "kind"))).alias("all"))
    kept = keep_spaced(F.col("all"), F.lit(min_spacing), lambda x: x["frame_idx"])
    return per.select(EPISODE, F.inline(kept))


def end_effector_speed(frames: DataFrame, smooth: int = 5) -> DataFrame:
    """(episode_id, i, s): step velocity over all but the last dimension (over all if there is one), the last value
    repeated so that there is one a frame, then smoothed."""
    arm = F.when(F.size("action") > 1, F.slice("action", 1, F.greatest(F.size("action") - 1, F.lit(1)))).otherwise(F.col("action"))
    w = by_frame()
    rows = frames.select(EPISODE, (F.row_number().over(w) - 1).alias("i"), arm.alias("a"))
    nxt = rows.withColumn("v", difference_norm(F.lead("a").over(by_frame("i")), F.col("a")))
    filled = nxt.withColumn("v", F.coalesce("v", F.lag("v").over(by_frame("i")), F.lit(0.0)))
    return moving_average_same(filled, "v", "i", smooth, "s").select(EPISODE, "i", "s")


def pause_before(speed: DataFrame, events: DataFrame, window: int = 40) -> DataFrame:
    """events (episode_id, frame_idx, floor) with pause: the first frame of least speed in the ``window`` frames before
    each event and not before ``floor``; null if fewer than 2 frames are left."""
    lo = F.greatest(F.col("floor"), F.col("frame_idx") - window)
    asked = events.withColumns({"__lo": lo, "__hi": F.col("frame_idx") - 1}).where(F.col("frame_idx") - F.col("__lo") >= 2)
    met = interval_join(speed.select(EPISODE, "i", "s"), asked, [EPISODE], "i", "__lo", "__hi", width=max(1, window), short=True)
    best = met.groupBy(EPISODE, "frame_idx", "floor").agg(F.min_by("i", F.struct("s", "i")).alias("pause"))
    return events.join(best, [EPISODE, "frame_idx", "floor"], "left")


def pauses(speed: DataFrame) -> DataFrame:
    """(episode_id, frame_idx): centres of runs under the 25th percentile of speed that begin after the first frame.

    Runs that begin at the last frame, and series of fewer than 4 frames, give none.
    """
    whole = Window.partitionBy(EPISODE)
    low = with_quantile(speed, "s", 0.25, "__q").withColumns({"n": F.count("*").over(whole), "__low": F.col("s") < F.col("__q")})
    marked = low.withColumn("__run", F.sum(F.when(F.col("__low"), 0).otherwise(1)).over(by_frame("i")))
    runs = marked.where("__low and n >= 4").groupBy(EPISODE, "__run").agg(F.min("i").alias("a"), F.max("i").alias("b"), F.first("n").alias("n"))
    return runs.where("a >= 1 and a < n - 1").select(EPISODE, F.floor((F.col("a") + F.col("b") + 1) / 2).cast("int").alias("frame_idx"))


def proprioceptive_boundaries(frames: DataFrame, threshold: float = 0.5, min_spacing: int = 8, smooth: int = 5, window: int = 40, min_segment: int = 5) -> DataFrame:
    """(episode_id, n, boundaries): first and last gripper transition, each with the pause before it; without
    transitions the pauses alone; inside the episode and at least ``min_segment`` apart. The last dimension is the gripper."""
    n = frames.groupBy(EPISODE).agg(F.count("*").cast("int").alias("n"))
    grip = frames.select(EPISODE, "frame_idx", F.element_at("action", -1).alias("x"))
    firsts = debounced(transitions(grip, threshold), min_spacing).groupBy(EPISODE).agg(F.min("frame_idx").alias("g"), F.max("frame_idx").alias("r"))
    speed = end_effector_speed(frames, smooth)
    asked = firsts.select(EPISODE, F.inline(F.when(F.col("r") > F.col("g"), F.array(F.struct(F.col("g").alias("frame_idx"), F.lit(0).alias("floor")), F.struct(F.col("r").alias("frame_idx"), (F.col("g") + 1).alias("floor")))).otherwise(F.array(F.struct(F.col("g").alias("frame_idx"), F.lit(0).alias("floor"))))))
    found = pause_before(speed, asked, window).select(EPISODE, F.explode(F.array("pause", "frame_idx")).alias("b"))
    alone = pauses(speed).join(firsts.select(EPISODE), EPISODE, "left_anti").select(EPISODE, F.col("frame_idx").alias("b"))
    marks = found.union(alone).join(n, EPISODE).where("b > 0 and b < n - 1").groupBy(EPISODE).agg(F.array_sort(F.collect_set("b")).alias("bs"))
    return n.join(marks, EPISODE, "left").select(EPISODE, "n", keep_spaced(F.coalesce("bs", F.array().cast("array<int>")), F.lit(min_segment)).alias("boundaries"))


# --- keyframes


def keyframes(episodes: DataFrame, frames: DataFrame | None, n_keyframes: int, jump: float = 0.25) -> DataFrame:
    """(episode_id, keyframes): evenly spaced frames and those after a jump of the scaled last dimension."""
    even = even_positions(F.col("num_frames"), F.lit(n_keyframes))
    if frames is None:
        return episodes.select(EPISODE, even.alias("keyframes"))
    whole = Window.partitionBy(EPISODE)
    last = frames.select(EPISODE, "frame_idx", F.element_at("action", -1).alias("x"))
    scaled = last.withColumns({"__span": F.max("x").over(whole) - F.min("x").over(whole), "__n": F.count("*").over(whole)})
    jumps = scaled.withColumn("__d", F.abs(F.col("x") - F.lag("x").over(by_frame())) / F.col("__span")).where((F.col("__span") > 1e-6) & (F.col("__n") >= 4) & (F.col("__d") > jump))
    jumps = jumps.groupBy(EPISODE).agg(F.collect_set(F.col("frame_idx").cast("int")).alias("__jumps"))
    both = episodes.join(jumps, EPISODE, "left")
    inside = F.transform(F.coalesce("__jumps", F.array().cast("array<int>")), lambda i: F.least(F.greatest(i, F.lit(0)), F.col("num_frames").cast("int") - 1))
    return both.select(EPISODE, F.when(F.col("num_frames") <= 1, F.array(F.lit(0))).otherwise(F.array_sort(F.array_union(even, inside))).alias("keyframes"))


def sample_frames(episodes: DataFrame, frame_count: int) -> DataFrame:
    """(episode_id, frames): at least two evenly spaced frames for a contact sheet."""
    return episodes.select(EPISODE, even_positions(F.col("num_frames"), F.greatest(F.lit(2), F.lit(frame_count))).alias("frames"))


def dense_window(lo: Column, hi: Column, most: int) -> Column:
    """Frames lo..hi, thinned to about ``most`` with a fixed step; hi is always among them."""
    n = hi - lo + 1
    step = F.ceil(n / most).cast("int")
    thin = F.sequence(lo, hi, step)
    return F.when(n <= most, F.sequence(lo, hi)).otherwise(F.when(F.element_at(thin, -1) == hi, thin).otherwise(F.concat(thin, F.array(hi))))


def clamped_frame(frames: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (episode_id, idx) joined to the nearest existing frame: idx cut to 0..n-1."""
    n = frames.groupBy(EPISODE).agg(F.max("frame_idx").alias("__last"))
    cut = asked.join(n, EPISODE).withColumn("frame_idx", F.least(F.greatest("idx", F.lit(0)), "__last")).drop("__last")
    return cut.join(frames, [EPISODE, "frame_idx"])


def frame_embedding(gray: Column, height: Column, width: Column) -> Column:
    """Mean-free unit vector of a strided 12 x 12 pick from a gray image given as a row-major array."""
    gh, gw = F.greatest(F.lit(1), F.floor(height / 12)).cast("int"), F.greatest(F.lit(1), F.floor(width / 12)).cast("int")
    picks = F.flatten(F.transform(F.sequence(F.lit(0), F.least(F.lit(11), height - 1)), lambda y: F.transform(F.sequence(F.lit(0), F.least(F.lit(11), width - 1)), lambda x: at(gray, (y * gh * width + x * gw).cast("int")))))
    total = lambda v, f: F.aggregate(v, F.lit(0.0), lambda s, x: s + f(x))
    scaled = lambda c: let(F.sqrt(total(c, lambda x: x * x)), lambda n: F.when(n > 1e-6, F.transform(c, lambda x: x / n)).otherwise(c))
    return let(picks, lambda p: let(total(p, lambda x: x) / F.size(p), lambda mean: let(F.transform(p, lambda x: x - mean), scaled)))


def episode_embeddings(frames: DataFrame, n_samples: int = 5) -> DataFrame:
    """(episode_id, embedding): mean of up to ``n_samples`` evenly spaced frame embeddings."""
    n = frames.groupBy(EPISODE).agg((F.max("frame_idx") + 1).alias("num_frames"))
    picked = n.select(EPISODE, F.explode(even_positions(F.col("num_frames"), F.lit(n_samples))).alias("frame_idx"))
    dims = frames.join(picked, [EPISODE, "frame_idx"]).select(EPISODE, F.posexplode("embedding").alias("dim", "x"))
    mean = dims.groupBy(EPISODE, "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return mean.groupBy(EPISODE).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda d: d["x"]).alias("embedding"))
