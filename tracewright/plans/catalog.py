"""Registered queries over the supplied tables and their oracle SQL.

Every query is an operator of the engine applied to a whole table in the shape ``stand_ins`` gives it. Integers leave as
BIGINT, numbers that are sums of floats are rounded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, text
from ..functions.vectors import even_positions
from ..operators import corpus, export, gate, gold, metrics, segments, signals, views
from ..operators.ordering import number_rows
from . import providers
from . import stand_ins as s

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its oracle."""

    def register(fn):
        def run(spark: SparkSession, d: str) -> DataFrame:
            df = fn(spark, d)
            kinds = {"int": "bigint", "smallint": "bigint", "float": "double", "array<int>": "array<bigint>"}
            return df.select(*(F.col(f"`{c}`").cast(kinds[t]).alias(c) if t in kinds else F.col(f"`{c}`") for c, t in df.dtypes))

        run.__doc__ = fn.__doc__
        QUERIES[fn.__name__] = run
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return register


def r(c: str, places: int = 6) -> F.Column:
    return F.round(c, places).alias(c)


FR = "fr as (select user_id as episode_id, value as a, event_id, event_type, row_number() over (partition by user_id order by ts, event_id) - 1 as frame_idx from events)"
V = f"{FR}, v as (select episode_id, frame_idx - 1 as i, d as v from (select episode_id, frame_idx, abs(a - lag(a) over (partition by episode_id order by frame_idx)) as d from fr) where frame_idx >= 1)"
SM = f"{V}, sm as (select episode_id, i, v, case when count(*) over (partition by episode_id) >= 5 then sum(v) over (partition by episode_id order by i rows between 2 preceding and 2 following) / 5 else v end as s from v)"
CONV = "cv as (select conv_id as episode_id, turn as segment_idx, text, role, sum(length(text)) over (partition by conv_id order by turn) as e, length(text) as n from conversations), seg as (select episode_id, segment_idx, (e - n)::bigint as start_frame, (e - 1)::bigint as end_frame, text, role from cv)"
EVEN = f"{CONV}, ev as (select episode_id, segment_idx, floor(k * (l + 1) / n::double)::bigint as start_frame, (floor((k + 1) * (l + 1) / n::double) - 1)::bigint as end_frame from (select *, count(*) over (partition by episode_id) as n, max(end_frame) over (partition by episode_id) as l, row_number() over (partition by episode_id order by segment_idx) - 1 as k from seg))"
SC = "sc as (select d.doc_id as episode_id, (1 + 4 * quality)::bigint as quality, toxic = 1 as mistake, n_chars::double as novelty, text as reason, source from documents d left join labels l on d.doc_id = l.doc_id)"


# --- signals


@query(f"""with {SM},
st as (select episode_id, count(*) + 1 as n, avg(v) as speed_norm, quantile_cont(s, 0.9) as q, max(s) as mx from sm group by episode_id),
w as (select st.episode_id, st.n, st.speed_norm, min(sm.i) as onset, max(sm.i) + 1 as offs from st left join sm on sm.episode_id = st.episode_id and sm.s > 0.12 * coalesce(nullif(st.q, 0), st.mx) group by all),
c as (select count(*) as pop, count(distinct speed_norm) as dv, quantile_cont(speed_norm, 0.3333) as lo, quantile_cont(speed_norm, 0.6667) as hi from st)
select episode_id, n, round(speed_norm, 6) as speed_norm, coalesce(onset, 0) as onset, coalesce(offs, 0) as "offset", coalesce(offs - onset, 0) as active_frames,
  round(coalesce(offs - onset, 0) / n::double, 4) as active_fraction,
  case when pop < 15 or dv < 3 or hi - lo < 1e-9 then null when speed_norm <= lo then 'slow' when speed_norm >= hi then 'fast' else 'medium' end as speed from w cross join c""")
def active_window(spark, d):
    """Active window, mean speed and corpus-relative speed tier of every episode."""
    return corpus.speed_tiers(signals.active_windows(s.frames(spark, d)), (0.3333, 0.6667)).withColumn("speed_norm", F.round("speed_norm", 6))


@query(f"with {V} select f.episode_id, count(*) as n, round(coalesce(any_value(m), 0), 6) as speed_norm from fr f left join (select episode_id, avg(v) as m from v group by 1) x on f.episode_id = x.episode_id group by f.episode_id")
def speed_norm(spark, d):
    return signals.speed_norms(s.frames(spark, d)).select("episode_id", "n", r("speed_norm"))


@query(f"with {SM} select episode_id, i, round(s, 6) as s from sm")
def moving_avg_same(spark, d):
    return signals.moving_average_same(signals.step_velocity(s.frames(spark, d)), "v", "i", 5, "s").select("episode_id", "i", r("s"))


@query(f"""with {FR}, b as (select episode_id, frame_idx, floor(frame_idx / 12)::bigint as block, a, count(*) over (partition by episode_id, floor(frame_idx / 12)) as n,
  row_number() over (partition by episode_id, floor(frame_idx / 12) order by frame_idx) as p, avg(a) over (partition by episode_id, floor(frame_idx / 12) order by frame_idx rows between 4 preceding and current row) as m from fr)
select episode_id, frame_idx, block, round(case when n >= 5 then m else a end, 6) as y from b where n < 5 or p >= 5""")
def moving_avg_valid(spark, d):
    rows = s.frames(spark, d).select("episode_id", "frame_idx", F.floor(F.col("frame_idx") / 12).alias("block"), F.col("action")[0].alias("x"))
    return signals.moving_average_valid(rows, "x", "frame_idx", 5, "y", ["episode_id", "block"]).select("episode_id", "frame_idx", "block", r("y"))


RUNS = f"{FR}, rn as (select *, sum(case when event_type is distinct from p or frame_idx = 0 then 1 else 0 end) over (partition by episode_id order by frame_idx) - 1 as segment_idx from (select *, lag(event_type) over (partition by episode_id order by frame_idx) as p from fr)), runs as (select episode_id, segment_idx::bigint as segment_idx, min(frame_idx) as start_frame, max(frame_idx) as end_frame, any_value(event_type) as phase from rn group by episode_id, segment_idx)"


@query(f"with {RUNS} select * from runs")
def segment_runs(spark, d):
    return segments.runs(s.frames(spark, d))


@query(f"with {RUNS}, n as (select episode_id, max(frame_idx) as l from fr group by 1) select r.episode_id, segment_idx, least(greatest(end_frame, 0), l) as frame_idx from runs r join n on r.episode_id = n.episode_id")
def subgoals(spark, d):
    """Last frame of every run, cut to the episode."""
    fr = s.frames(spark, d)
    per = segments.runs(fr).groupBy("episode_id").agg(F.array_sort(F.collect_list(segments.segment(F.col("start_frame"), F.col("end_frame"), F.col("phase"), idx=F.col("segment_idx")))).alias("segs"), (F.max("end_frame") + 1).alias("n"))
    return per.select("episode_id", F.inline(segments.subgoals(F.col("segs"), F.col("n"))))


EXC = f"""{FR}, lg as (select episode_id, frame_idx, 0 as dim, a as x from fr union all select episode_id, frame_idx, 1, (event_id % 7)::double from fr),
rg as (select episode_id, dim, max(x) - min(x) as w from lg group by all),
b as (select *, count(*) over p as n, row_number() over (p order by frame_idx) as k, avg(x) over (p order by frame_idx rows between 4 preceding and current row) as m from (select *, floor(frame_idx / 12)::bigint as segment_idx from lg) window p as (partition by episode_id, dim, segment_idx)),
ex as (select b.episode_id, segment_idx, b.dim, n, (max(case when n >= 5 then m else x end) - min(case when n >= 5 then m else x end)) / greatest(any_value(w), 1e-6) as e from b join rg on b.episode_id = rg.episode_id and b.dim = rg.dim where n < 5 or k >= 5 group by b.episode_id, segment_idx, b.dim, n)"""


@query(f"with {EXC} select episode_id, segment_idx, dim::bigint as dim, n, round(e, 6) as excursion from ex")
def excursions(spark, d):
    return signals.excursions(s.frames_2d(spark, d), s.blocks(spark, d)).select("episode_id", "segment_idx", "dim", "n", r("excursion"))


@query(f"with {EXC} select episode_id, segment_idx, coalesce(string_agg(case when n >= 2 and e > 0.25 then case dim when 0 then 'arm' else 'gripper' end end, '+' order by dim), 'none') as active_dof from ex group by episode_id, segment_idx")
def active_sets(spark, d):
    dims = names.dims_table(spark, ["shoulder.pos", "gripper.pos"], 2)
    return signals.active_sets(s.frames_2d(spark, d), s.blocks(spark, d), dims).select("episode_id", "segment_idx", "active_dof")


TR = f"{FR}, cl as (select episode_id, frame_idx, (a - min(a) over p) / (max(a) over p - min(a) over p) < 0.5 as c, max(a) over p - min(a) over p as w from fr window p as (partition by episode_id)), tr as (select episode_id, frame_idx, case when c then 'close' else 'open' end as kind from (select *, lag(c) over (partition by episode_id order by frame_idx) as was from cl) where was <> c and w > 1e-9)"


def _series(spark, d):
    return s.frames(spark, d).select("episode_id", "frame_idx", F.col("action")[0].alias("x"))


@query(f"with {TR} select * from tr")
def gripper_transitions(spark, d):
    return signals.transitions(_series(spark, d))


@query(f"""with recursive {TR}, k as (select episode_id, min(frame_idx) as frame_idx from tr group by 1
union all select episode_id, n from (select k.episode_id, (select min(r.frame_idx) from tr r where r.episode_id = k.episode_id and r.frame_idx >= k.frame_idx + 8) as n from k) where n is not null)
select k.episode_id, k.frame_idx, kind from k join tr on k.episode_id = tr.episode_id and k.frame_idx = tr.frame_idx""")
def gripper_debounced(spark, d):
    return signals.debounced(signals.transitions(_series(spark, d)))


EE = f"{FR}, ee as (select episode_id, frame_idx as i, coalesce(d, lag(d) over (partition by episode_id order by frame_idx), 0) as v from (select *, abs(lead(a) over (partition by episode_id order by frame_idx) - a) as d from fr)), es as (select episode_id, i, case when count(*) over (partition by episode_id) >= 5 then sum(v) over (partition by episode_id order by i rows between 2 preceding and 2 following) / 5 else v end as s from ee)"


@query(f"with {EE} select episode_id, i, round(s, 6) as s from es")
def end_effector_speed(spark, d):
    return signals.end_effector_speed(s.frames(spark, d)).select("episode_id", "i", r("s"))


@query(f"with {TR}, {EE.removeprefix(FR + ', ')} select t.episode_id, t.frame_idx, (select arg_min(i, struct_pack(s := s, i := i)) from es where es.episode_id = t.episode_id and i >= greatest(0, t.frame_idx - 40) and i < t.frame_idx and t.frame_idx - greatest(0, t.frame_idx - 40) >= 2) as pause from tr t")
def pause_before_event(spark, d):
    events = signals.transitions(_series(spark, d)).select("episode_id", "frame_idx", F.lit(0).alias("floor"))
    return signals.pause_before(signals.end_effector_speed(s.frames(spark, d)), events).select("episode_id", "frame_idx", "pause")


@query(f"""with {EE}, lo as (select *, s < quantile_cont(s, 0.25) over (partition by episode_id) as low, count(*) over (partition by episode_id) as n from es),
g as (select *, sum(case when low then 0 else 1 end) over (partition by episode_id order by i) as run from lo)
select episode_id, floor((a + b + 1) / 2)::bigint as frame_idx from (select episode_id, run, min(i) as a, max(i) as b, any_value(n) as n from g where low and n >= 4 group by 1, 2) where a >= 1 and a < n - 1""")
def speed_pauses(spark, d):
    return signals.pauses(signals.end_effector_speed(s.frames(spark, d)))


@query()
def proprioceptive_segments(spark, d):
    """Segments from gripper transitions and pauses."""
    b = signals.proprioceptive_boundaries(s.frames_2d(spark, d))
    return b.select("episode_id", F.inline(segments.from_boundaries(F.col("boundaries"), F.col("n"))))


POS = "round_even(i * (n - 1) / greatest(least(k, n) - 1, 1)::double, 0)::bigint"


@query(f"with {FR}, e as (select episode_id, count(*) as n, 6 as k from fr group by 1) select episode_id, array_to_string(list_sort(list_distinct(list_transform(range(least(k, n)), lambda i: {POS}))), ',') as frames from e")
def sampled_frames(spark, d):
    n = s.frames(spark, d).groupBy("episode_id").agg(F.count("*").cast("int").alias("num_frames"))
    return signals.sample_frames(n, 6).select("episode_id", F.array_join(F.col("frames").cast("array<string>"), ",").alias("frames"))


@query(f"""with {FR}, j as (select episode_id, frame_idx from (select episode_id, frame_idx, abs(a - lag(a) over (partition by episode_id order by frame_idx)) / (max(a) over (partition by episode_id) - min(a) over (partition by episode_id)) as d from fr) where d > 0.25),
e as (select episode_id, count(*) as n, 6 as k from fr group by 1), p as (select episode_id, unnest(list_transform(range(least(k, n)), lambda i: {POS})) as f from e union select episode_id, frame_idx from j)
select episode_id, string_agg(f::varchar, ',' order by f) as keyframes from p group by 1""")
def keyframes(spark, d):
    fr = s.frames(spark, d)
    n = fr.groupBy("episode_id").agg(F.count("*").cast("int").alias("num_frames"))
    return signals.keyframes(n, fr, 6).select("episode_id", F.array_join(F.col("keyframes").cast("array<string>"), ",").alias("keyframes"))


@query(f"with {FR}, n as (select episode_id, max(frame_idx) as l from fr group by 1) select fr.episode_id, fr.frame_idx, x.idx::bigint as idx, round(a, 6) as x from (select *, unnest([-5, 3, 1000000]) as idx from n) x join fr on fr.episode_id = x.episode_id and fr.frame_idx = least(greatest(idx, 0), l)")
def clamped_frames(spark, d):
    fr = s.frames(spark, d)
    asked = fr.select("episode_id").distinct().withColumn("idx", F.explode(F.array(F.lit(-5), F.lit(3), F.lit(1_000_000))))
    return signals.clamped_frame(fr, asked).select("episode_id", "frame_idx", "idx", F.round(F.col("action")[0], 6).alias("x"))


# --- corpus measures

NOV = "nv as (select a.vec_id, list_distance(a.embedding::double[], b.embedding::double[]) as dist, a.label from embeddings a join embeddings b on a.vec_id <> b.vec_id)"


@query(f"with {NOV} select vec_id as episode_id, round(avg(dist), 5) as novelty from (select *, row_number() over (partition by vec_id order by dist) as k from nv) where k <= 5 group by 1")
def knn_novelty(spark, d):
    return corpus.novelty(s.vectors(spark, d))


RET = "sg as (select vec_id as episode_id, 0 as segment_idx, 0 as frame_idx, label::varchar as phase, embedding::double[] as e from embeddings)"


def _phased(spark, d):
    segs = s.vectors(spark, d).select("episode_id", F.lit(0).alias("segment_idx"), F.col("label").cast("string").alias("phase"), F.lit(0).alias("end_frame"))
    return segs.select("episode_id", "segment_idx", F.lit(0).alias("frame_idx")), segs


@query(f"with {RET}, x as (select a.episode_id, a.segment_idx, a.frame_idx, b.episode_id as o, row_number() over (partition by a.episode_id order by list_distance(a.e, b.e), b.episode_id::varchar) as k from sg a join sg b on a.phase = b.phase and a.episode_id <> b.episode_id) select episode_id, segment_idx::bigint as segment_idx, frame_idx::bigint as frame_idx, o::varchar as retrieved_subgoal_episode_id, 0::bigint as retrieved_subgoal_frame_idx from x where k = 1")
def retrieve_nearest(spark, d):
    return corpus.retrieve_nearest(*_phased(spark, d), s.vectors(spark, d))


SEED = f"""with {RET}, p as (select *, row_number() over (partition by phase order by substr(md5(episode_id::varchar), 1, 3), episode_id) - 1 as place, count(*) over (partition by phase) as n from sg),
q as (select *, case when n > 1 then ('0x' || substr(md5(concat_ws(':', 0, episode_id, segment_idx)), 1, 15))::bigint % (n - 1) end as j from p)
select q.episode_id, q.segment_idx::bigint as segment_idx, q.frame_idx::bigint as frame_idx, p.episode_id as retrieved_subgoal_episode_id, case when p.episode_id is not null then 0::bigint end as retrieved_subgoal_frame_idx
from q left join p on p.phase = q.phase and p.place = case when q.j >= q.place then q.j + 1 else q.j end"""


@query(SEED)
def retrieve_seeded(spark, d):
    """A same-phase frame of another episode, picked among all there are."""
    return corpus.retrieve_seeded(*_phased(spark, d))


@query(SEED)
def retrieve_seeded_all(spark, d):
    return corpus.retrieve_seeded(*_phased(spark, d))


CUR = f"{SC}, e as (select min(quality) as ql, max(quality) as qh, min(novelty) as nl, max(novelty) as nh from sc), cu as (select episode_id, round(0.5 * coalesce(case when qh - ql < 1e-9 then 0.5 else (quality - ql) / (qh - ql)::double end, 0.5) + 0.5 * coalesce(case when nh - nl < 1e-9 then 0.5 else (novelty - nl) / (nh - nl) end, 0.5), 4) as curation_value from sc cross join e), st as (select count(*) >= 15 and max(curation_value) - min(curation_value) >= 0.08 and count(distinct curation_value) >= 3 as ok, quantile_cont(curation_value, 1/3.0::double) as lo, quantile_cont(curation_value, 2/3.0::double) as hi, quantile_cont(curation_value, 0.8) as cut from cu)"


@query(f"with {CUR} select episode_id, curation_value, case when not ok then null when curation_value <= lo then 'minimal' when curation_value >= hi then 'full' else 'reduced' end as curation_tier from cu cross join st")
def curation_tiers(spark, d):
    return corpus.tiers(corpus.curation_values(s.scores(spark, d))).select("episode_id", "curation_value", "curation_tier")


@query(f"with {CUR} select episode_id, curation_value, case when not ok then null when curation_value >= cut then 'keep' else 'cut' end as curation_tier from cu cross join st")
def curation_top_cut(spark, d):
    return corpus.tiers(corpus.curation_values(s.scores(spark, d)), top_cut=0.2).select("episode_id", "curation_value", "curation_tier")


@query(f"with {SC}, e as (select min(quality) as lo, max(quality) as hi from sc) select episode_id, case when quality is not null then case when hi - lo < 1e-9 then 0.5 else round((quality - lo) / (hi - lo)::double, 6) end end as scaled from sc cross join e")
def minmax_quality(spark, d):
    return corpus.minmax(s.scores(spark, d), "quality", "scaled").select("episode_id", r("scaled"))


@query(f"""with {NOV}, n as (select vec_id, label, round(avg(dist), 5) as novelty from (select *, row_number() over (partition by vec_id order by dist) as k from nv) where k <= 8 group by 1, 2),
p as (select case when label < 5 then 'a' else 'b' end as dataset, vec_id as episode_id, (1 + label % 5)::double as quality, novelty, (vec_id % 97)::double as speed_norm from n),
e as (select min(quality) as ql, max(quality) as qh, min(novelty) as nl, max(novelty) as nh from p),
c as (select p.*, round(0.5 * (quality - ql) / (qh - ql) + 0.5 * (novelty - nl) / (nh - nl), 4) as curation_value from p cross join e),
t as (select quantile_cont(curation_value, 1/3.0::double) as lo, quantile_cont(curation_value, 2/3.0::double) as hi, quantile_cont(speed_norm, 1/3.0::double) as sl, quantile_cont(speed_norm, 2/3.0::double) as sh from c)
select dataset, episode_id, novelty, curation_value, case when curation_value <= lo then 'minimal' when curation_value >= hi then 'full' else 'reduced' end as curation_tier, case when speed_norm <= sl then 'slow' when speed_norm >= sh then 'fast' else 'medium' end as speed from c cross join t""")
def rescore_pooled(spark, d):
    v = s.vectors(spark, d)
    pool = v.select(F.when(F.col("label") < 5, "a").otherwise("b").alias("dataset"), "episode_id", "embedding", (1 + F.col("label") % 5).cast("double").alias("quality"), (F.col("episode_id") % 97).cast("double").alias("speed_norm"))
    return corpus.rescore(pool).select("dataset", "episode_id", "novelty", "curation_value", "curation_tier", "speed")


# --- gate

ORD = "oo as (select o_custkey as episode_id, o_orderpriority as t, floor(o_totalprice)::bigint as n from orders), os as (select episode_id, count(*) as k, avg(n) as m, stddev_pop(n) / nullif(avg(n), 0) as cv, count(t) as nt, count(distinct lower(trim(t))) as dt from oo group by 1)"


@query(f"with {ORD} select episode_id, k as n_segments, round(m, 4) as mean_length, round(cv, 6) as cv, nt as n_texts, dt as n_distinct_texts from os")
def segment_stats(spark, d):
    return gate.segment_stats(s.order_segments(spark, d)).select("episode_id", "n_segments", r("mean_length", 4), r("cv"), "n_texts", "n_distinct_texts")


@query(f"with {ORD} select c_custkey::varchar as episode_id, 'degenerate_single_segment' as \"check\", 'a single subtask spans the whole episode' as detail from customer left join os on c_custkey = episode_id where coalesce(k, 0) <= 1")
def gate_degenerate(spark, d):
    episodes = s.table(spark, d, "customer").select(F.col("c_custkey").alias("episode_id"))
    return gate.degenerate(episodes, gate.segment_stats(s.order_segments(spark, d)))


@query(f"with {ORD} select episode_id::varchar as episode_id, 'uniform_split' as \"check\", 'segment lengths are near-uniform (boundaries not grounded to frames)' as detail from os where k >= 3 and m > 0 and cv < 0.12")
def gate_uniform(spark, d):
    return gate.uniform(gate.segment_stats(s.order_segments(spark, d)))


@query(f"with {ORD} select episode_id::varchar as episode_id, 'repeated_subtask_text' as \"check\", 'duplicate subtask text within episode' as detail from os where dt < nt")
def gate_repeated(spark, d):
    return gate.repeated_text(gate.segment_stats(s.order_segments(spark, d)))


@query("select '__dataset__' as episode_id, 'collapsed_score_distribution' as \"check\", 'only ' || count(distinct quality) || ' distinct quality score(s) [' || string_agg(distinct quality::varchar, ', ') || '] across ' || count(*) || ' episodes' as detail from labels where quality = 1 having count(*) >= 8 and count(distinct quality) < 2")
def gate_collapsed(spark, d):
    good = s.table(spark, d, "labels").where("quality = 1").withColumnRenamed("doc_id", "episode_id")
    return gate.collapsed_scores(good)


OUT = f"{SC}, md as (select quantile_cont(quality, 0.5) as m, count(quality) as n from sc), ol as (select episode_id::varchar as episode_id, 'quality_outlier_needs_review' as \"check\", 'quality ' || quality || ' is >= 2 below the dataset median ' || regexp_replace(m::varchar, '\\.0$', '') || '; needs_review' as detail, quality, mistake from sc cross join md where n >= 3 and m - quality >= 2)"


@query(f"with {OUT} select episode_id, \"check\", detail from ol")
def gate_outliers(spark, d):
    return gate.quality_outliers(s.scores(spark, d))


@query(f"with {OUT} select episode_id, detail, quality, mistake from ol")
def needs_review(spark, d):
    scores = s.scores(spark, d)
    return gate.needs_review(gate.quality_outliers(scores), scores).select("episode_id", "detail", "quality", "mistake")


@query("select quality::bigint as quality, count(*) as n from labels where quality is not null group by 1")
def quality_counts(spark, d):
    return gate.quality_counts(s.table(spark, d, "labels"))


STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
TOK = f"list_filter(list_transform(regexp_split_to_array(%s, '\\s+'), lambda w: lower(regexp_replace(regexp_replace(w, '^[.,:;()\\[\\]{{}}]+', ''), '[.,:;()\\[\\]{{}}]+$', ''))), lambda w: length(w) >= 4 and not list_contains([{STOP}], w))"


@query(f"select conv_id as episode_id, turn as segment_idx, array_to_string({TOK % 'text'}, ' ') as tokens from conversations")
def object_tokens(spark, d):
    return s.conversations(spark, d).select("episode_id", F.col("segment_idx").cast("long").alias("segment_idx"), F.array_join(text.object_tokens(F.col("subtask_text")), " ").alias("tokens"))


@query(f"""with o as (select doc_id, lower(text) as o from documents), x as (select conv_id, list_filter({TOK % 'c.text'}, lambda w: not contains(o, w) and not contains('talk', w))[1] as w from conversations c join o on c.conv_id = o.doc_id)
select conv_id::varchar as episode_id, 'object_grounding' as \"check\", '''' || w || ''' not in stage-one observation' as detail from x where w is not null""")
def gate_grounding(spark, d):
    seen = s.table(spark, d, "documents").select(F.col("doc_id").alias("episode_id"), F.col("text").alias("observation"), F.lit("talk").alias("task"))
    return gate.object_grounding(s.conversations(spark, d), seen)


def _reasons(spark, d):
    """Source names as placeholder texts, words put in by the row's number for the others."""
    said = F.when(F.col("episode_id") % 5 == 0, "").when(F.col("episode_id") % 5 == 1, F.concat(F.lit("it was placed inside "), "source")).when(F.col("episode_id") % 5 == 2, F.concat(F.lit("it did not fail "), "source")).when(F.col("episode_id") % 5 == 3, F.concat(F.lit("wrong drop "), "source"))
    return s.scores(spark, d).withColumn("reason", said)


REA = f"{SC}, re as (select episode_id, quality, mistake, case when episode_id % 5 = 0 then '' when episode_id % 5 = 1 then 'it was placed inside ' || source when episode_id % 5 = 2 then 'it did not fail ' || source when episode_id % 5 = 3 then 'wrong drop ' || source end as reason from sc)"


@query(f"with {REA} select episode_id::varchar as episode_id, 'placeholder_reason' as \"check\", 'missing or templated reason' as detail from re where coalesce(trim(reason), '') = ''")
def gate_placeholder(spark, d):
    return gate.placeholder_reason(_reasons(spark, d))


@query(f"""with {REA}, f as (select *, episode_id % 5 = 1 as good, episode_id % 5 = 3 as bad from re where quality is not null)
select episode_id::varchar as episode_id, 'score_reason_contradiction' as \"check\", 'low quality with success reason' as detail from f where quality <= 2 and good and not bad
union all select episode_id::varchar, 'score_reason_contradiction', 'high quality with failure reason' from f where quality >= 4 and bad and not good
union all select episode_id::varchar, 'score_reason_contradiction', 'mistake=true with perfect quality' from f where mistake and quality >= 5""")
def gate_contradictions(spark, d):
    return gate.contradictions(_reasons(spark, d))


@query()
def gate_all(spark, d):
    """Every rule over conversations scored by labels, documents as observations."""
    segs = s.conversations(spark, d)
    seen = s.table(spark, d, "documents").select(F.col("doc_id").alias("episode_id"), F.col("text").alias("observation"), F.lit("talk").alias("task"))
    return gate.run_gate(segs.select("episode_id").distinct(), segs, s.scores(spark, d), seen)


@query(f"with {ORD} select episode_id from os where k >= 2 and not (k >= 3 and m > 0 and cv < 0.12)")
def gate_passed(spark, d):
    return gate.gate_passed(s.order_segments(spark, d))


# --- metrics

PAIR = f"{EVEN}, pr as (select a.episode_id, a.segment_idx, greatest(0, least(a.end_frame, g.end_frame) - greatest(a.start_frame, g.start_frame) + 1) / (greatest(a.end_frame, g.end_frame) - least(a.start_frame, g.start_frame) + 1)::double as iou from ev a join seg g on a.episode_id = g.episode_id and a.segment_idx = g.segment_idx)"


@query(f"with {PAIR} select episode_id, row_number() over (partition by episode_id order by segment_idx) as place, round(iou, 6) as iou from pr")
def temporal_iou(spark, d):
    return metrics.segment_ious(metrics.paired(s.even_tracks(spark, d), s.conversations(spark, d))).select("episode_id", "place", r("iou"))


@query(f"with {PAIR} select episode_id, round(avg(iou), 6) as iou from pr group by 1")
def episode_iou(spark, d):
    return metrics.episode_iou(s.even_tracks(spark, d), s.conversations(spark, d)).select("episode_id", r("iou"))


@query(f"with {CONV} select episode_id, row_number() over (partition by episode_id order by segment_idx) as place, end_frame as b from seg qualify lead(segment_idx) over (partition by episode_id order by segment_idx) is not null")
def boundaries(spark, d):
    return metrics.boundaries(s.conversations(spark, d))


@query()
def boundary_scores(spark, d):
    return metrics.boundary_scores(s.even_tracks(spark, d), s.conversations(spark, d), 40)


def _tracks(spark, d):
    one = s.conversations(spark, d).select("episode_id", "segment_idx", "start_frame", "end_frame")
    return one.withColumn("track", F.lit("gold")).unionByName(s.even_tracks(spark, d).withColumn("track", F.lit("even"))).unionByName(one.withColumn("track", F.lit("same")))


@query(f"with {PAIR}, n as (select episode_id, count(*) as n from seg group by 1) select n.episode_id, 'same' as track, 1.0::double as iou from n union all select episode_id, 'even', round(avg(iou), 4) from pr group by 1")
def track_metrics(spark, d):
    return metrics.track_metrics(_tracks(spark, d)).select("episode_id", "track", "iou")


def _gold(spark, d):
    """Even tracks as model labels, conversations as human ones; every third episode is not reviewed, every fifth accepted."""
    seg = lambda *extra: F.array_sort(F.collect_list(F.struct("segment_idx", "start_frame", "end_frame", *extra)))
    auto = s.even_tracks(spark, d).groupBy("episode_id").agg(seg().alias("a"))
    human = s.conversations(spark, d).groupBy("episode_id").agg(seg("subtask_text").alias("g"))
    j = auto.join(human, "episode_id")
    none, rev, acc = F.lit(None), F.col("episode_id") % 3 != 0, F.col("episode_id") % 5 == 0
    gseg = F.transform("g", lambda x: F.struct(x["segment_idx"].alias("segment_idx"), F.when(rev & ~acc, x["start_frame"]).alias("start_frame"), F.when(rev & ~acc, x["end_frame"]).alias("end_frame"), x["subtask_text"].alias("subtask_text"), acc.alias("accept_auto")))
    aseg = F.transform("a", lambda x: F.struct(x["segment_idx"].alias("segment_idx"), x["start_frame"].alias("start_frame"), x["end_frame"].alias("end_frame"), none.cast("string").alias("subtask_text")))
    ameta = F.struct((F.col("episode_id") % 5 + 1).cast("int").alias("quality"), none.cast("int").alias("task_success_quality"), (F.col("episode_id") % 2 == 0).alias("mistake"), none.cast("string").alias("boundary_clarity"), none.cast("string").alias("reason"))
    gmeta = F.struct(F.when(rev, (F.col("episode_id") % 4 + 1).cast("int")).alias("quality"), none.cast("boolean").alias("mistake"), none.cast("string").alias("reason"), none.cast("boolean").alias("accept_auto"))
    goals = F.transform("a", lambda x: F.struct(x["segment_idx"].alias("segment_idx"), x["end_frame"].alias("frame_idx")))
    ggoals = F.transform("g", lambda x: F.struct(x["segment_idx"].alias("segment_idx"), F.when(rev, x["end_frame"]).alias("frame_idx"), none.cast("boolean").alias("accept_auto")))
    return j.select("episode_id", F.lit("talk").alias("task"), F.lit(0).alias("num_frames"), F.struct(aseg.cast(gold.AUTO_SEG).alias("subtasks"), ameta.alias("metadata"), goals.cast(gold.AUTO_GOAL).alias("subgoals")).alias("auto"), F.struct(gseg.cast(gold.GOLD_SEG).alias("subtasks"), gmeta.alias("metadata"), ggoals.cast(gold.GOLD_GOAL).alias("subgoals")).alias("gold"), F.lit("").alias("review_notes"))


@query(f"""with {PAIR}, e as (select distinct episode_id from seg), q as (select episode_id, episode_id % 5 + 1 as a, case when episode_id % 3 <> 0 then episode_id % 4 + 1 end as g from e),
i as (select case when episode_id % 5 = 0 then 1.0 else iou end as iou from pr where episode_id % 5 = 0 or episode_id % 3 <> 0),
g as (select ev.end_frame = seg.end_frame as hit from ev join seg on ev.episode_id = seg.episode_id and ev.segment_idx = seg.segment_idx where ev.episode_id % 3 <> 0)
select (select count(*) from e) as episode_count, (select count(*) from e where episode_id % 3 <> 0 or episode_id % 5 = 0) as reviewed_episode_count, (select round(avg(iou), 6) from i) as boundary_iou_mean,
  (select round(avg((a = g)::int), 6) from q where g is not null) as quality_exact, (select round(avg((abs(a - g) <= 1)::int), 6) from q where g is not null) as quality_within_one, (select round(avg(hit::int), 6) from g) as subgoal_agreement""")
def reliability_report(spark, d):
    return metrics.reliability(_gold(spark, d)).select("episode_count", "reviewed_episode_count", *(r(c) for c in ("boundary_iou_mean", "quality_exact", "quality_within_one", "subgoal_agreement")))


def _trial(spark, d):
    lab = s.table(spark, d, "labels")
    marks = F.create_map(F.lit("b0"), F.col("quality") == 1, F.lit("b1"), F.col("toxic") == 1, F.lit("p0"), F.col("quality") == 0, F.lit("e0"), F.col("toxic") == 0)
    grades = lab.select(F.col("doc_id").alias("item_id"), marks.alias("marks"), F.when(F.col("quality") == 1, "usable").when(F.col("toxic") == 1, "garbage").alias("verdict"))
    return grades, s.table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.col("lang").alias("strategy"), (F.col("n_chars") > 1000).alias("bands"), F.lit(3).alias("b"), F.lit(2).alias("p"), F.lit(1).alias("e"))


@query("""with x as (select lang, n_chars > 1000 as bands, quality as q, toxic as t from labels l join documents d on l.doc_id = d.doc_id)
select lang as strategy, count(*) as n_items, count_if(bands)::bigint as n_failure_band, round(avg(bands::int), 6) as failure_band_rate, round(1 - sum((q = 0)::int + (t = 0)::int) / sum(3), 6) as boundary_acceptance, sum(3)::bigint as n_boundaries,
  round(1 - sum((q = 1)::int) / sum(2), 6) as phase_accuracy, sum(2)::bigint as n_phases, round(1 - sum((t = 1)::int) / sum(1), 6) as evidence_factual_accuracy, sum(1)::bigint as n_evidence, count_if(q = 1)::bigint as usable, 0::bigint as touchup, count_if(q <> 1 and t = 1)::bigint as garbage from x group by 1""")
def trial_tally(spark, d):
    out = metrics.trial_tally(*_trial(spark, d))
    return out.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))


@query("""with x as (select lang, quality as q, toxic as t from labels l join documents d on l.doc_id = d.doc_id)
select lang as strategy, round(sum(q + t) / (2.0::double * count(*)), 6) as boundary_acceptance, (2 * count(*))::bigint as n_boundaries, round(avg(1 - q), 6) as phase_accuracy, round(avg(1 - t), 6) as evidence_factual_accuracy from x group by 1""")
def trial_tally_all_marks(spark, d):
    out = metrics.trial_tally(*_trial(spark, d), protocol="mark-all")
    return out.select("strategy", r("boundary_acceptance"), "n_boundaries", r("phase_accuracy"), r("evidence_factual_accuracy"))


COST = "co as (select event_id, case event_type when 'click' then 'gemini-2.5-flash-lite' when 'view' then 'x-2.5-flash' when 'purchase' then 'Gemini-2.5-Pro' else 'other' end as model, coalesce((props->>'k')::bigint, 0) * 1000 as tokens from events)"


def _calls(spark, d):
    model = F.when(F.col("event_type") == "click", "gemini-2.5-flash-lite").when(F.col("event_type") == "view", "x-2.5-flash").when(F.col("event_type") == "purchase", "Gemini-2.5-Pro").otherwise("other")
    tokens = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)) * 1000
    return s.table(spark, d, "events").select("event_id", metrics.call_cost(model, tokens, tokens * 2).alias("cost_usd"))


@query(f"with {COST} select event_id, round(case when contains(lower(model), 'flash-lite') then tokens / 1e6::double * 0.1 + tokens * 2 / 1e6::double * 0.4 when contains(lower(model), '2.5-flash') then tokens / 1e6::double * 0.3 + tokens * 2 / 1e6::double * 2.5 when contains(lower(model), '2.5-pro') then tokens / 1e6::double * 1.25 + tokens * 2 / 1e6::double * 10 end, 6)::double as cost_usd from co")
def call_costs(spark, d):
    return _calls(spark, d).select("event_id", r("cost_usd"))


@query(f"with {COST}, c as (select case when contains(lower(model), 'flash-lite') then tokens / 1e6::double * 0.9 when contains(lower(model), '2.5-flash') then tokens / 1e6::double * 5.3 when contains(lower(model), '2.5-pro') then tokens / 1e6::double * 21.25 end as c from co) select round(coalesce(sum(c), 0), 3)::double as total_cost_usd, count(c) as episodes_with_cost, count(*) as episode_count, round(nullif(coalesce(sum(c), 0), 0) / count(*), 5)::double as cost_per_episode, 0::bigint as receipt_count from c")
def cost_summary(spark, d):
    return metrics.cost_summary(_calls(spark, d)).select(r("total_cost_usd", 3), "episodes_with_cost", "episode_count", r("cost_per_episode", 5), "receipt_count")


# --- export

VOC = f"{CONV}, vo as (select role as phrase, row_number() over (order by min((episode_id::varchar, segment_idx))) - 1 as subtask_index from seg where trim(role) <> '' group by role)"


@query(f"with {VOC} select * from vo")
def export_vocabulary(spark, d):
    return export.vocabulary(s.conversations(spark, d), "phase")


@query(f"with {VOC}, fr as (select episode_id, unnest(range(max(end_frame) + 1)) as frame_idx from seg group by 1) select f.episode_id, frame_idx, coalesce(subtask_index, 0) as subtask_index from fr f left join seg on seg.episode_id = f.episode_id and frame_idx between start_frame and end_frame left join vo on role = phrase")
def export_frames(spark, d):
    return export.frame_indices(s.conversations(spark, d), s.conversation_episodes(spark, d), "phase")


@query(f"with {VOC} select episode_id, string_agg(subtask_index::varchar, ',' order by segment_idx) as indices, string_agg(role, ',' order by segment_idx) as names, string_agg(start_frame::varchar, ',' order by segment_idx) as starts, string_agg(end_frame::varchar, ',' order by segment_idx) as ends, round(sum(round(end_frame / 10.0::double, 4)), 3) as time_sum from seg join vo on role = phrase group by 1")
def export_lists(spark, d):
    out = export.episode_lists(s.conversations(spark, d), s.conversation_episodes(spark, d), "phase")
    j = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return out.select("episode_id", j("subtask_indices").alias("indices"), j("subtask_names").alias("names"), j("subtask_start_frames").alias("starts"), j("subtask_end_frames").alias("ends"), F.round(F.aggregate("subtask_end_times", F.lit(0.0), lambda a, x: a + x), 3).alias("time_sum"))


def _annotations(spark, d):
    from ..schema import flatten

    segs, episodes = s.conversations(spark, d), s.conversation_episodes(spark, d)
    meta = s.scores(spark, d).select("episode_id", "quality", "mistake", "reason")
    goals = segs.select("episode_id", "segment_idx", F.col("end_frame").alias("subgoal_frame_idx"))
    return flatten(episodes, meta, segs, goals)


@query()
def export_json_lines(spark, d):
    return export.json_lines(_annotations(spark, d))


@query(f"""with {CONV}, e as (select distinct episode_id from seg) select episode_id::varchar as episode_id, 'episode_metadata' as record_type, null::bigint as segment_idx, null::bigint as start_frame, null as phase from e where episode_id in (select doc_id from documents)
union all select episode_id::varchar, 'subtask', segment_idx, start_frame, role from seg union all select episode_id::varchar, 'subgoal', segment_idx, null, null from seg""")
def annotations_long(spark, d):
    """The long table of three record types."""
    return _annotations(spark, d).select("episode_id", "record_type", "segment_idx", "start_frame", "phase")


# --- views, gold and review


@query(f"with {CONV} select episode_id, segment_idx, role as phase, null::varchar as target, start_frame, end_frame, floor((start_frame + end_frame) / 2)::bigint as mid_frame from seg where lower(trim(role)) = 'user'")
def phase_lookup(spark, d):
    return views.phase_segments(s.conversations(spark, d), " USER ")


@query(f"with {CONV}, e as (select episode_id, max(end_frame) + 1 as n from seg group by 1), g as (select episode_id, arg_min(end_frame, segment_idx) as f from seg group by 1) select e.episode_id, coalesce(f, floor(n / 2))::bigint as thumb_frame from e left join g on e.episode_id = g.episode_id")
def thumb_frames(spark, d):
    goals = s.conversations(spark, d).select("episode_id", "segment_idx", F.col("end_frame").alias("subgoal_frame_idx"))
    return views.thumb_frames(s.conversation_episodes(spark, d), goals)


@query()
def thumb_frames_all(spark, d):
    """With the subgoals of all episodes."""
    goals = s.conversations(spark, d).select("episode_id", "segment_idx", F.col("end_frame").alias("subgoal_frame_idx"))
    return views.thumb_frames(s.conversation_episodes(spark, d), goals)


@query(f"with {CONV}, {SC}, e as (select distinct episode_id from seg) select e.episode_id::varchar as episode_id, array_to_string(list_filter(['segmentation', case when quality is not null then 'quality' end, 'subgoals', 'novelty'], lambda x: x is not null), ',') as modules from e join sc on e.episode_id = sc.episode_id")
def enabled_modules(spark, d):
    from ..schema import conform, segments_of, subgoals_of

    a = _annotations(spark, d)
    meta = conform(s.scores(spark, d).select("episode_id", "quality", "novelty")).join(a.select("episode_id").distinct(), "episode_id", "left_semi")
    return views.enabled_modules(meta, segments_of(a), subgoals_of(a)).select("episode_id", F.array_join("modules", ",").alias("modules"))


PAY = f"""with {PAIR}, st as (select episode_id, count(*) as k, avg(end_frame - start_frame + 1) as m, stddev_pop(end_frame - start_frame + 1) / nullif(avg(end_frame - start_frame + 1), 0) as cv, count(nullif(text, '')) as nt, count(distinct lower(trim(nullif(text, '')))) as dt from seg group by 1),
io as (select episode_id, avg(iou) as iou from pr group by 1) select st.episode_id::varchar as episode_id, round(least(1.0, io.iou), 4) as sort_iou, ((k <= 1)::int + (k >= 3 and m > 0 and cv < 0.12)::int + (dt < nt)::int)::bigint as n_flags from st join io on st.episode_id = io.episode_id"""


@query(PAY)
def episode_payloads(spark, d):
    """With the flags of the rules over segments."""
    segs = s.conversations(spark, d)
    stats = gate.segment_stats(segs)
    flags = gate.degenerate(segs.select("episode_id").distinct(), stats).union(gate.uniform(stats)).union(gate.repeated_text(stats))
    return views.episode_payloads(s.conversation_episodes(spark, d), _tracks(spark, d), flags).select("episode_id", "sort_iou", "n_flags")


@query()
def episode_payloads_all(spark, d):
    """With the flags of all rules."""
    return views.episode_payloads(s.conversation_episodes(spark, d), _tracks(spark, d), gate_all(spark, d)).select("episode_id", "sort_iou", "n_flags")


@query(f"with {SC} select 'docs::' || episode_id as episode_id, row_number() over (order by quality desc nulls last, episode_id) as place from sc")
def gallery_sort(spark, d):
    merged = views.merge_galleries([("docs", s.scores(spark, d).select("episode_id", "quality"))])
    order = [F.col("quality").desc_nulls_last(), F.col("source_episode_id").cast("long")]
    return number_rows(merged, order, "place").select("episode_id", "place")


@query(f"""with {CONV}, e as (select distinct episode_id, episode_id % 3 <> 0 as reviewed from seg), o as (select *, row_number() over (order by episode_id) as k, count(*) over () as n from e)
select o.episode_id, coalesce(lag(o.episode_id) over (order by k), max(o.episode_id) over ()) as previous, coalesce(lead(o.episode_id) over (order by k), min(o.episode_id) over ()) as following,
  coalesce((select min(episode_id) from e where not reviewed and e.episode_id > o.episode_id), (select min(episode_id) from e where not reviewed and e.episode_id <= o.episode_id)) as next_unreviewed from o""")
def review_order(spark, d):
    g = _gold(spark, d)
    return gold.review_order(g.select("episode_id", F.col("episode_id").alias("ord"), gold.is_reviewed().alias("reviewed"))).select("episode_id", "previous", "following", "next_unreviewed")


@query(f"with {CONV}, e as (select distinct episode_id from seg) select episode_id, case when episode_id % 7 = 0 then 5 when episode_id % 3 <> 0 then episode_id % 4 + 1 end as quality, episode_id % 2 = 0 as mistake, 'seen' as reason from e")
def gold_update(spark, d):
    """Edits of every episode laid over the gold table; those that give a quality give one beyond the scale, which is cut."""
    g = _gold(spark, d)
    seg = "array<struct<segment_idx:int,fields:map<string,string>>>"
    edits = g.select("episode_id", F.when(F.col("episode_id") % 7 == 0, 9).alias("quality"), F.lit(None).cast("boolean").alias("mistake"), F.lit("seen").alias("reason"), F.lit(False).alias("accept_auto_metadata"), F.array().cast(seg).alias("subtasks"), F.array().cast(seg).alias("subgoals"), F.lit(None).cast("string").alias("review_notes"))
    return gold.update_reviews(g, edits).select("episode_id", F.col("gold.metadata.quality").alias("quality"), F.col("gold.metadata.mistake").alias("mistake"), F.col("gold.metadata.reason").alias("reason"))


@query(f"with {CONV}, e as (select distinct episode_id from seg) select episode_id, case when episode_id % 3 <> 0 then episode_id % 4 + 1 end as quality from e")
def gold_sync(spark, d):
    """Fresh template of all episodes; the human labels that there are stay."""
    g = _gold(spark, d)
    fresh = g.withColumn("gold", F.lit(None).cast(dict(g.dtypes)["gold"]))
    return gold.synchronise(fresh, g).select("episode_id", F.col("gold.metadata.quality").alias("quality"))


def _gold_labels(spark, d):
    """The whole gold table with the labels as human judgements; episodes whose labels are null are not reviewed."""
    lab = s.scores(spark, d).select("episode_id", F.col("quality").cast("int").alias("__q"), F.col("mistake").alias("__m"))
    none = F.lit(None)
    meta = F.struct(F.col("__q").alias("quality"), F.col("__m").alias("mistake"), none.cast("string").alias("reason"), none.cast("boolean").alias("accept_auto"))
    return _gold(spark, d).join(lab, "episode_id", "left").withColumn("gold", F.col("gold").withField("metadata", meta)).drop("__q", "__m")


@query()
def gold_update_all(spark, d):
    """The labels as edits, laid over a gold table without human labels."""
    g = _gold_labels(spark, d)
    seg = "array<struct<segment_idx:int,fields:map<string,string>>>"
    m = F.col("gold.metadata")
    edits = g.where(gold.is_reviewed()).select("episode_id", m["quality"].alias("quality"), m["mistake"].alias("mistake"), F.lit("seen").alias("reason"), F.lit(False).alias("accept_auto_metadata"), F.array().cast(seg).alias("subtasks"), F.array().cast(seg).alias("subgoals"), F.lit(None).cast("string").alias("review_notes"))
    empty = g.withColumn("gold", F.lit(None).cast(dict(g.dtypes)["gold"]))
    return gold.update_reviews(empty, edits).select("episode_id", F.col("gold.metadata.quality").alias("quality"), F.col("gold.metadata.mistake").alias("mistake"), F.col("gold.metadata.reason").alias("reason"))


@query()
def gold_sync_all(spark, d):
    """Fresh template of every episode; all human labels are kept."""
    g = _gold_labels(spark, d)
    fresh = g.withColumn("gold", F.lit(None).cast(dict(g.dtypes)["gold"]))
    return gold.synchronise(fresh, g).select("episode_id", F.col("gold.metadata.quality").alias("quality"))


# --- segmentation folds and providers


def _answers(spark, d):
    """Mock answers for every conversation."""
    episodes = s.conversation_episodes(spark, d)
    labels = even_positions(F.col("num_frames"), F.lit(12))
    asked = episodes.select(F.col("episode_id").cast("string").alias("episode_id"), F.lit("grounded/s0_a0").alias("stage"), text.manifest(labels, F.col("fps")).alias("question"), labels.alias("frame_labels"))
    return providers.call(asked, providers.MockProvider()).join(episodes.select(F.col("episode_id").cast("string").alias("episode_id"), "num_frames"), "episode_id")


@query()
def mock_answers(spark, d):
    return _answers(spark, d).select("episode_id", "stage", "status_code", "answer")


@query(f"""with {CONV}, e as (select episode_id, max(end_frame) as l from seg group by 1), b as (select *, unnest(range(4)) as i from e), x as (select episode_id, i, l, round_even(i * greatest(l, 3) / 4.0::double, 0)::bigint as a, round_even((i + 1) * greatest(l, 3) / 4.0::double, 0)::bigint - 1 as b from b)
select episode_id::varchar as episode_id, i as segment_idx, a as start_frame, case when i = 3 then l else b end as end_frame, ['approach', 'grasp', 'transport', 'retract'][i + 1] as phase, case when i < 3 then 'the mock object' end as target from x""")
def grounded_segments(spark, d):
    segs, _ = segments.grounded(segments.parse_answer(text.extract_json(F.col("answer"))), F.col("num_frames"))
    return _answers(spark, d).select("episode_id", F.inline(segs)).select("episode_id", "segment_idx", "start_frame", "end_frame", "phase", "target")


@query()
def snapped_segments(spark, d):
    """Mock segments over event frames, contact boundaries moved to gripper transitions."""
    fr = s.frames(spark, d)
    moves = signals.debounced(signals.transitions(_series(spark, d))).groupBy("episode_id").agg(F.array_sort(F.collect_list(F.struct("frame_idx", "kind"))).alias("moves"))
    n = fr.groupBy("episode_id").agg(F.count("*").cast("int").alias("n"))
    even = segments.even_segments(F.col("n") - 1, 4)
    phases = F.array(*map(F.lit, ("approach", "grasp", "release", "retract")))
    segs = F.transform(even, lambda e, i: segments.segment(e["start"], e["end"], F.get(phases, i), F.get(phases, i), idx=i))
    return n.join(moves, "episode_id").select("episode_id", F.inline(segments.snapped(segs, F.col("moves"))))


@query("with e as (select doc_id from documents), t as (select distinct conv_id from conversations) select doc_id as episode_id from e anti join t on e.doc_id = t.conv_id")
def resume_remaining(spark, d):
    from ..streaming.incremental import remaining

    return remaining(s.table(spark, d, "documents").select(F.col("doc_id").alias("episode_id")), s.conversations(spark, d))


@query(f"with {FR} select episode_id, frame_idx, 'f' || frame_idx || '  ' || printf('%.2f', frame_idx / 30.0::double) || 's' as caption from fr")
def frame_captions(spark, d):
    return s.frames(spark, d).select("episode_id", "frame_idx", text.caption(F.col("frame_idx"), F.lit(30.0)).alias("caption"))


@query("select date_trunc('hour', ts)::timestamp as hour, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def event_windows(spark, d):
    """Hourly windows per type; beyond the annotation rules."""
    from ..streaming.incremental import event_windows as windows

    ev = s.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windows(ev, "ts").select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", r("total", 4))


from . import catalog_files, catalog_more  # noqa: E402, F401 - register their queries under the same names
