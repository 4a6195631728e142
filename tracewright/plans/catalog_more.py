"""More registered queries: folds over segments, answers, texts, names, views and sources, each with oracle SQL.

Values that the tables don't hold (odd targets, answers, feature names) are put in by the row's number, the same way on
both sides; the SQL side never parses what the engine parses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import names, text
from ..functions.vectors import let
from ..operators import gold, segments, signals, views
from ..operators.ordering import number_rows
from ..schema import SCHEMA_VERSION, conform, episode_ids, episode_view, segments_of, sort_key, subgoals_of
from ..sources import episodes as src
from ..storage import materialize
from . import stand_ins as s
from .catalog import CONV, EE, EVEN, FR, ORACLE_SQL, OUT, PAIR, SC, TOK, TR, _annotations, _gold, query, r


def pick(values: list[str | None], by: str) -> tuple[Callable[[], F.Column], str]:
    """The value at ``by`` modulo their number, as a column and as SQL."""
    sql = "[" + ", ".join("null" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"
    return lambda: F.get(F.array(*map(F.lit, values)), (F.expr(by) % len(values)).cast("int")), f"({sql})[({by}) % {len(values)} + 1]"


# --- texts

_T, _T_SQL = pick(["none", "  N/A ", "the scene", "Object", "red cup ", " nan", "", None, "x" * 90], "doc_id")


@query(f"""with t as (select doc_id, {_T_SQL} as v from documents) select doc_id, case when lower(trim(coalesce(v, ''))) not in ('', 'none', 'n/a', 'na', '-', 'null', 'the scene', 'scene', 'object') then substr(trim(v), 1, 80) end as target,
case when lower(trim(coalesce(v, ''))) not in ('', 'nan', 'none') then trim(v) end as asked, case when lower(trim(v)) not in ('', 'nan') then trim(v) end as shown from t""")
def target_texts(spark, d):
    """Targets as labels, as query answers and as the viewer shows them."""
    return s.table(spark, d, "documents").select("doc_id", text.clean_target(_T()).alias("target"), text.query_target(_T()).alias("asked"), text.blank_to_null(_T()).alias("shown"))


_P, _P_SQL = pick(["grasp cup", "Release it", "go home", "retract", "PICK up and place", "set down", "transport", "", None, "Back away", "clamp", "let go"], "o_orderkey")


def _has(column: str, parts: list[str]) -> str:
    return "(" + " or ".join(f"contains(lower(coalesce({column}, '')), '{p}')" for p in parts) + ")"


@query(f"""with p as (select o_orderkey, {_P_SQL} as p from orders) select o_orderkey, {_has('p', text.WIND_DOWN)} as wind_down, {_has('p', text.CONTACT)} as contact,
case when {_has('p', text.GRASP)} then 'grasp' when {_has('p', text.RELEASE)} then 'release' else 'other' end as kind, coalesce(p, '') = 'retract' or {_has('p', text.WIND_DOWN)} as optional_open, coalesce(p, '') = 'retract' as optional_closed from p""")
def phase_kinds(spark, d):
    return s.table(spark, d, "orders").select("o_orderkey", text.is_wind_down(_P()).alias("wind_down"), text.is_contact(_P()).alias("contact"), text.contact_kind(_P()).alias("kind"), text.target_optional(_P(), True).alias("optional_open"), text.target_optional(_P(), False).alias("optional_closed"))


_N, _N_SQL = pick(["3", "4.7", "abc", "", " 2 ", "-1", "9", None, "1e1", "nan"], "doc_id")


@query(f"with t as (select doc_id, try_cast({_N_SQL} as double) as x from documents) select doc_id, case when not isnan(x) then trunc(x)::bigint end as whole, case when not isnan(x) then greatest(1, least(5, trunc(x)))::bigint end as quality from t")
def safe_numbers(spark, d):
    """Numbers read from texts, and cut to the scale of quality."""
    return s.table(spark, d, "documents").select("doc_id", text.safe_int(_N()).alias("whole"), text.clamp_quality(_N()).alias("quality"))


@query("""select conv_id, turn, case when lower(trim(coalesce(text, ''))) not in ('', 'none', 'n/a', 'na', '-', 'null', 'the scene', 'scene', 'object') then substr(trim(text), 1, 80) end as target,
case when lower(trim(coalesce(role, ''))) not in ('', 'nan', 'none') then trim(role) end as asked, case when lower(trim(text)) not in ('', 'nan') then trim(text) end as shown from conversations""")
def targets_of_turns(spark, d):
    """Texts and roles of turns as labels of targets, as answers of queries and as the viewer shows them."""
    turns = s.table(spark, d, "conversations")
    return turns.select("conv_id", "turn", text.clean_target(F.col("text")).alias("target"), text.query_target(F.col("role")).alias("asked"), text.blank_to_null(F.col("text")).alias("shown"))


@query(f"""select doc_id, {_has('text', text.WIND_DOWN)} as wind_down, {_has('text', text.CONTACT)} as contact, case when {_has('text', text.GRASP)} then 'grasp' when {_has('text', text.RELEASE)} then 'release' else 'other' end as kind,
coalesce(source, '') = 'retract' or {_has('source', text.WIND_DOWN)} as optional_open, coalesce(lang, '') = 'retract' as optional_closed from documents""")
def kinds_of_documents(spark, d):
    """Whole texts, sources and languages through the classifiers of phases."""
    docs = s.table(spark, d, "documents")
    t, source, lang = F.col("text"), F.col("source"), F.col("lang")
    return docs.select("doc_id", text.is_wind_down(t).alias("wind_down"), text.is_contact(t).alias("contact"), text.contact_kind(t).alias("kind"), text.target_optional(source, True).alias("optional_open"), text.target_optional(lang, False).alias("optional_closed"))


@query("""with t as (select o_orderkey, try_cast(concat_ws('.', o_custkey, o_orderkey) as double) as a, try_cast(o_orderpriority as double) as b, try_cast(substr(o_orderpriority, 1, 1) as double) as c, try_cast('-' || o_custkey as double) as e from orders)
select o_orderkey, trunc(a)::bigint as customer, trunc(b)::bigint as priority, greatest(1, least(5, trunc(c)))::bigint as quality, greatest(1, least(5, trunc(e)))::bigint as least_quality from t""")
def numbers_of_orders(spark, d):
    """Numbers read from keys and priorities, and cut to the scale of quality."""
    key, first = F.concat_ws(".", "o_custkey", "o_orderkey"), F.substring("o_orderpriority", 1, 1)
    own = [text.safe_int(key).alias("customer"), text.safe_int(F.col("o_orderpriority")).alias("priority"), text.clamp_quality(first).alias("quality"), text.clamp_quality(F.concat(F.lit("-"), F.col("o_custkey").cast("string"))).alias("least_quality")]
    return s.table(spark, d, "orders").select("o_orderkey", *own)


_F, _F_SQL = pick(["frame", "frame_index", "end_frame", "transition_frame", "other", ""], "doc_id")


@query(f"with t as (select doc_id, {_F_SQL} as k, n_chars % 500 as v from documents) select doc_id, case when k <> 'other' then v end::bigint as frame from t")
def refine_answers(spark, d):
    """The frame of a refinement answer under any of its names, or bare, in a code fence or not."""
    value = (F.col("n_chars") % 500).cast("string")
    bare = F.when(_F() == "", value).otherwise(F.concat(F.lit('{"'), _F(), F.lit('": '), value, F.lit("}")))
    said = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("```json\n"), bare, F.lit("\n```"))).otherwise(bare)
    return s.table(spark, d, "documents").select("doc_id", text.frame_answer(text.extract_json(said)).alias("frame"))


@query("""with t as (select doc_id, quality as q, toxic as x, doc_id % 4 as k from labels)
select doc_id, case when k = 3 then null when k = 2 then greatest(1, least(5, 9 * q)) else 1 + 4 * q end::bigint as quality, case when k = 3 then null when k = 1 then greatest(1, least(5, 2 + x)) when k = 2 then greatest(1, least(5, 9 * q)) else 1 + 4 * q end::bigint as task_success_quality,
  case when k in (0, 1) then x = 1 end as mistake, case when k = 0 then 'clear' end as boundary_clarity, case when k = 3 then 'unparseable answer' when k = 0 then 'said: ' || doc_id else '' end as reason from t""")
def metadata_answers(spark, d):
    """Quality answers with fields under other names, without some of them, with talk around, and none."""
    lab = s.table(spark, d, "labels")
    q, x, k = F.col("quality"), F.col("toxic"), F.col("doc_id") % 4
    word = F.when(x == 1, "YES").otherwise("no")
    full = F.concat(F.lit('Sure! {"curation_quality": '), 1 + 4 * q, F.lit(', "mistake": '), F.when(x == 1, "true").otherwise("false"), F.lit(', "boundary_clarity": " Clear ", "reason": " said: '), F.col("doc_id"), F.lit(' "} Done.'))
    other = F.concat(F.lit('{"quality_1_to_5": "'), 1 + 4 * q, F.lit('", "task_success_quality_1_to_5": '), 2 + x, F.lit(', "mistake_boolean": "'), word, F.lit('"}'))
    wide = F.concat(F.lit('```\n{"quality": '), 9 * q, F.lit(', "boundary_clarity": ""}\n```'))
    said = F.when(k == 0, full).when(k == 1, other).when(k == 2, wide).otherwise("I can't tell.")
    m = text.metadata_answer(text.extract_json(said))
    return lab.select("doc_id", m.alias("m")).select("doc_id", "m.quality", "m.task_success_quality", "m.mistake", "m.boundary_clarity", "m.reason")


@query("""select conv_id, turn, case turn % 2 when 0 then role || chr(10) || length(text) else role end as a, case turn % 3 when 0 then role when 1 then role || chr(10) || length(text) else '' end as b from conversations""")
def provider_texts(spark, d):
    """Texts of answers in the two shapes that providers send."""
    c = s.table(spark, d, "conversations")
    part = lambda x: F.struct(x.cast("string").alias("text"))
    n = F.length("text")
    first = F.to_json(F.struct(F.array(F.struct(F.struct(F.when(F.col("turn") % 2 == 0, F.array(part(F.col("role")), part(F.lit("")), part(n))).otherwise(F.array(part(F.col("role")))).alias("parts")).alias("content"))).alias("candidates")))
    item = lambda kind, x: F.struct(F.lit(kind).alias("type"), x.cast("string").alias("text"))
    listed = F.to_json(F.struct(F.array(F.struct(F.array(item("output_text", F.col("role")), item("thought", F.lit("hidden"))).alias("content")), F.struct(F.array(item("text", n)).alias("content"))).alias("output")))
    second = F.when(F.col("turn") % 3 == 0, F.to_json(F.struct(F.col("role").alias("output_text")))).when(F.col("turn") % 3 == 1, listed).otherwise("{}")
    return c.select("conv_id", "turn", text.candidates_text(first).alias("a"), F.coalesce(text.output_text(second), F.lit("")).alias("b"))


# --- names of features

_NAMES = [["shoulder.pos", "elbow.pos", "gripper.pos"], ["x", "y", "z", "roll", "left_gripper", "right_gripper"], ["ee_x", "joint1"], ["foo", "bar"], ["Gripper_open", "TCP_x", "tcp_y"]]
_NAMES_SQL = "([" + ", ".join("[" + ", ".join(f"'{n}'" for n in v) + "]" for v in _NAMES) + "])[c_custkey % 5 + 1]"


@query(f"""with t as (select c_custkey, list_transform({_NAMES_SQL}, lambda n: lower(n)) as ns from customer),
v as (select *, len(list_filter(ns, lambda n: {_has('n', text.EFFECTOR_TOKENS)} or list_has_any(string_split(replace(n, '_', '.'), '.'), {text.EFFECTOR_AXES!r}))) as e, len(list_filter(ns, lambda n: list_contains(string_split(replace(n, '_', '.'), '.'), 'pos') or contains(n, 'joint'))) as j,
  list_filter(range(len(ns)), lambda i: contains(ns[i + 1], 'gripper')) as g from t)
select c_custkey, case when e > j then 'end-effector' when j > 0 then 'joint' when e > 0 then 'end-effector' end as modality, array_to_string(case when len(g) > 0 then g else [len(ns) - 1] end, ',') as gripper, array_to_string(list_transform(ns, lambda n: case when contains(n, 'gripper') then 'gripper' else 'arm' end), ',') as groups from v""")
def feature_names(spark, d):
    """Control modality, gripper dimensions and groups by the names of a vector's dimensions."""
    n = F.get(F.array(*(F.array(*map(F.lit, v)) for v in _NAMES)), (F.col("c_custkey") % 5).cast("int"))
    join = lambda c: F.array_join(c.cast("array<string>"), ",")
    return s.table(spark, d, "customer").select("c_custkey", names.control_modality(n).alias("modality"), join(names.gripper_dims(n, F.size(n))).alias("gripper"), join(names.component_groups(n, F.size(n))).alias("groups"))


# --- frames and embeddings


@query("""with t as (select o_orderkey, (o_orderkey % 50)::bigint as lo, (o_orderkey % 50 + o_custkey % 60)::bigint as hi from orders), u as (select *, hi - lo + 1 as n, ceil((hi - lo + 1) / 25.0::double)::bigint as st from t)
select o_orderkey, array_to_string(case when n <= 25 then range(lo, hi + 1) when list_contains(range(lo, hi + 1, st), hi) then range(lo, hi + 1, st) else list_append(range(lo, hi + 1, st), hi) end, ',') as frames from u""")
def dense_windows(spark, d):
    """Frames around a boundary, thinned to 25."""
    lo = (F.col("o_orderkey") % 50).cast("int")
    hi = (lo + F.col("o_custkey") % 60).cast("int")
    return s.table(spark, d, "orders").select("o_orderkey", F.array_join(signals.dense_window(lo, hi, 25).cast("array<string>"), ",").alias("frames"))


@query("""with f as (select label as episode_id, row_number() over (partition by label order by vec_id) - 1 as i, count(*) over (partition by label) as n, embedding from embeddings),
p as (select distinct episode_id, round_even(k * (n - 1) / greatest(least(5, n) - 1, 1)::double, 0)::bigint as i from (select distinct episode_id, n from f), range(5) as t(k) where k < n),
x as (select f.episode_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as dim from f join p on f.episode_id = p.episode_id and f.i = p.i)
select episode_id::bigint as episode_id, dim::bigint as dim, round(avg(x), 6) as x from x group by 1, 2""")
def episode_vectors(spark, d):
    """Mean of five evenly spaced frame embeddings of every episode; labels as episodes, vectors as frames."""
    rows = signals.number_frames(s.table(spark, d, "embeddings").select(F.col("label").alias("episode_id"), "vec_id", "embedding"), ["vec_id"])
    return signals.episode_embeddings(rows).select(F.col("episode_id").cast("long").alias("episode_id"), F.posexplode("embedding").alias("dim", "x")).select("episode_id", "dim", r("x"))


@query("""with g as (select vec_id, list_transform(range(16 * 14), lambda i: embedding[(i % 64) + 1]::double) as gray from embeddings),
p as (select vec_id, list_transform(range(12 * 12), lambda k: gray[((k // 12) * 1 * 14 + (k % 12) * 1) + 1]) as v from g), m as (select vec_id, v, list_avg(v) as m from p),
c as (select vec_id, list_transform(v, lambda x: x - m) as c from m), u as (select vec_id, c, sqrt(list_sum(list_transform(c, lambda x: x * x))) as n from c)
select vec_id, round(c[1] / n, 6) as first, round(c[100] / n, 6) as middle, round(list_sum(list_transform(c, lambda x: x * x / (n * n))), 6) as norm, len(c)::bigint as size from u""")
def frame_vectors(spark, d):
    """Embeddings of gray images of 16 x 14 points, made of the given vectors."""
    gray = F.transform(F.sequence(F.lit(0), F.lit(16 * 14 - 1)), lambda i: F.get("embedding", i % 64).cast("double"))
    e = s.table(spark, d, "embeddings").select("vec_id", let(gray, lambda g: signals.frame_embedding(g, F.lit(16), F.lit(14))).alias("e"))
    return e.select("vec_id", F.round(F.get("e", F.lit(0)), 6).alias("first"), F.round(F.get("e", F.lit(99)), 6).alias("middle"), F.round(F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm"), F.size("e").alias("size"))


# --- folds over segments


def _lists(spark, d, text_of=None, phase=None):
    """(episode_id, segs, n): conversations as arrays of segments."""
    one = segments.segment(F.col("start_frame"), F.col("end_frame"), F.col("subtask_text") if text_of is None else text_of, F.col("phase") if phase is None else phase, F.lit("seen"), None, F.col("segment_idx"))
    return s.conversations(spark, d).groupBy("episode_id").agg(F.array_sort(F.collect_list(one)).alias("segs"), (F.max("end_frame") + 1).cast("int").alias("n"))


ENDS = "nn as (select episode_id, max(end_frame) as l, count(*) as k from seg group by 1)"


@query(f"""with {CONV}, {ENDS}, t as (select *, row_number() over (partition by episode_id order by segment_idx) as p from seg),
f as (select episode_id, end_frame, text, p from t where p <= 6 and segment_idx % 5 <> 4)
select f.episode_id, row_number() over w - 1 as segment_idx, coalesce(lag(end_frame) over w + 1, 0) as start_frame, case when p = max(p) over (partition by f.episode_id) then l else end_frame end as end_frame, substr(trim(text), 1, 160) as subtask_text from f join nn on f.episode_id = nn.episode_id window w as (partition by f.episode_id order by p)""")
def validated_segments(spark, d):
    """Free-text answers made of each conversation: six items at most, those without text skipped, gaps closed."""
    item = F.struct(F.col("segment_idx"), F.when(F.col("segment_idx") % 2 == 0, F.col("end_frame").cast("string")).otherwise(F.concat(F.col("end_frame"), F.lit(".7"))).alias("end_step"), F.when(F.col("segment_idx") % 5 != 4, F.col("subtask_text")).otherwise(" ").alias("subtask_text"))
    per = s.conversations(spark, d).groupBy("episode_id").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("json"), (F.max("end_frame") + 1).cast("int").alias("n"))
    segs = segments.validated(segments.parse_answer(F.col("json")), F.col("n"))
    return per.select("episode_id", F.inline(segs)).select("episode_id", "segment_idx", "start_frame", "end_frame", "subtask_text")


@query(f"""with {CONV}, {ENDS}, t as (select *, row_number() over (partition by episode_id order by segment_idx) as p from seg), q as (select t.*, k, l, p >= 3 as tail from t join nn on t.episode_id = nn.episode_id)
select episode_id, row_number() over (partition by episode_id order by start_frame) - 1 as segment_idx, start_frame, end_frame, phase from (
  select episode_id, start_frame, end_frame, role || p as phase from q where not tail union all select episode_id, min(start_frame), max(end_frame), 'retract' from q where tail group by 1)""")
def tail_merged(spark, d):
    """Trailing withdrawals become one segment; from the third on every turn counts as one."""
    place = F.row_number().over(Window.partitionBy("episode_id").orderBy("segment_idx"))
    named = s.conversations(spark, d).withColumn("p", place)
    one = segments.segment(F.col("start_frame"), F.col("end_frame"), F.lit("t"), F.when(F.col("p") < 3, F.concat("phase", "p")).when(F.col("p") == 3, "retract").otherwise("go home"), None, None, F.col("segment_idx"))
    per = named.groupBy("episode_id").agg(F.array_sort(F.collect_list(one)).alias("segs"))
    return per.select("episode_id", F.inline(segments.numbered(segments.deduped_tail(F.col("segs"))))).select("episode_id", "segment_idx", "start_frame", "end_frame", "phase")


@query(f"""with recursive {CONV}, {ENDS}, t as (select seg.*, row_number() over (partition by seg.episode_id order by segment_idx) as p, lead(end_frame) over (partition by seg.episode_id order by segment_idx) as e2, l, k from seg join nn on seg.episode_id = nn.episode_id),
m as (select episode_id, p, k, start_frame as a, case when e2 is null then end_frame else least(greatest(start_frame + 1, least(greatest(greatest(0, end_frame - 15), end_frame + 9), least(l, end_frame + 15))), e2 - 1) end as b from t where p = 1
union all select t.episode_id, t.p, t.k, m.b + 1, case when t.e2 is null then t.end_frame else least(greatest(m.b + 2, least(greatest(greatest(0, t.end_frame - 15), t.end_frame + 9), least(t.l, t.end_frame + 15))), t.e2 - 1) end from m join t on t.episode_id = m.episode_id and t.p = m.p + 1)
select episode_id, p - 1 as segment_idx, a as start_frame, b as end_frame from m""")
def refined_segments(spark, d):
    """Every boundary moved nine frames on by an answer, in order and inside both segments."""
    per = _lists(spark, d).withColumn("segs", segments.numbered(F.col("segs")))
    answers = F.transform("segs", lambda x: (x["end_frame"] + 9).cast("int"))
    return per.select("episode_id", F.inline(segments.refined(F.col("segs"), answers, 15, F.col("n")))).select("episode_id", "segment_idx", "start_frame", "end_frame")


@query(f"""with recursive {CONV}, {ENDS}, t as (select seg.*, row_number() over (partition by seg.episode_id order by segment_idx) as p, l, k from seg join nn on seg.episode_id = nn.episode_id),
b as (select episode_id, p, k, l, text, case when p < k then greatest(1, least(end_frame + 1, l - 1)) else l end as b from t where p = 1
union all select t.episode_id, t.p, t.k, t.l, t.text, case when t.p < t.k then greatest(b.b + 1, least(t.end_frame + 1, t.l - 1)) else t.l end from b join t on t.episode_id = b.episode_id and t.p = b.p + 1)
select episode_id, p - 1 as segment_idx, case when p = 1 then 0 else lag(b) over w + 1 end as start_frame, case when k = 1 then l else b end as end_frame, text as subtask_text from b window w as (partition by episode_id order by p)""")
def consistent_samples(spark, d):
    """Of four samples an episode, three agree on the number of segments: medians of their boundaries."""
    per = _lists(spark, d).withColumn("segs", segments.numbered(F.col("segs")))
    moved = per.withColumn("sample", F.explode(F.array(*map(F.lit, range(4)))))
    segs = F.transform("segs", lambda x: x.withField("end_frame", (x["end_frame"] + F.when(F.col("sample") == 1, 0).when(F.col("sample") == 2, 1).otherwise(2)).cast("int")))
    longer = F.concat(segs, segs)
    samples = moved.select("episode_id", "sample", F.col("n").alias("num_frames"), F.when(F.col("sample") == 0, longer).otherwise(segs).alias("segments"))
    return segments.combined_samples(samples).select("episode_id", F.inline("segments")).select("episode_id", "segment_idx", "start_frame", "end_frame", "subtask_text")


@query(f"with {FR}, n as (select episode_id, greatest(count(*) - 1, 2) as l from fr group by 1), e as (select *, unnest(range(3)) as i from n) select episode_id, i as segment_idx, round_even(i * l / 3.0::double, 0)::bigint as start_frame, greatest(round_even(i * l / 3.0::double, 0), case when i < 2 then round_even((i + 1) * l / 3.0::double, 0) - 1 else l end)::bigint as end_frame from e")
def even_thirds(spark, d):
    n = s.frames(spark, d).groupBy("episode_id").agg(F.count("*").cast("int").alias("n"))
    return n.select("episode_id", F.posexplode(segments.even_segments(F.col("n") - 1, 3)).alias("segment_idx", "e")).select("episode_id", "segment_idx", F.col("e.start").alias("start_frame"), F.col("e.end").alias("end_frame"))


@query(f"with {CONV}, {ENDS} select seg.episode_id, q.f as frame_idx, segment_idx, role as phase from seg join (select episode_id, unnest([0, l // 2, l]) as f from nn) q on q.episode_id = seg.episode_id and f between start_frame and end_frame")
def segment_at_playhead(spark, d):
    """The segment that holds the first, the middle and the last frame."""
    n = s.conversation_episodes(spark, d)
    last = F.col("num_frames") - 1
    asked = n.select("episode_id", F.explode(F.array(F.lit(0), F.floor(last / 2).cast("int"), last)).alias("frame_idx"))
    return segments.segment_at(s.conversations(spark, d), asked).select("episode_id", "frame_idx", "segment_idx", "phase")


# --- annotations, views, gold


@query(f"""with {CONV}, e as (select distinct episode_id from seg), x as (select episode_id, 0 as k, -1 as i from e where episode_id in (select doc_id from documents) union all select episode_id, 1, segment_idx from seg union all select episode_id, 2, segment_idx from seg)
select row_number() over (order by episode_id::varchar, k, i) as place, episode_id::varchar as episode_id, ['episode_metadata', 'subtask', 'subgoal'][k + 1] as record_type, case when i >= 0 then i end as segment_idx from x""")
def canonical_order(spark, d):
    """The place of every row in canonical order."""
    df = conform(_annotations(spark, d)).select("episode_id", "record_type", "segment_idx")
    return number_rows(df, sort_key(), "place").select("place", "episode_id", "record_type", "segment_idx")


@query(f"""with {CONV}, {SC}, {ENDS} select nn.episode_id::varchar as episode_id, 'talk' as task, l + 1 as num_frames, sc.quality, sc.mistake, k as n_subtasks, k as n_subgoals, (select string_agg(end_frame::varchar, ',' order by segment_idx) from seg where seg.episode_id = nn.episode_id) as ends from nn left join sc on nn.episode_id = sc.episode_id""")
def episode_views(spark, d):
    v = episode_view(_annotations(spark, d))
    return v.select("episode_id", "task", "num_frames", F.col("metadata.quality").alias("quality"), F.col("metadata.mistake").alias("mistake"), F.size("subtasks").alias("n_subtasks"), F.size("subgoals").alias("n_subgoals"), F.array_join(F.transform("subtasks", lambda x: x["end_frame"].cast("string")), ",").alias("ends"))


@query(f"with {CONV} select distinct episode_id::varchar as episode_id from seg")
def annotated_ids(spark, d):
    return episode_ids(_annotations(spark, d))


@query(f"with {CONV} select episode_id::varchar as episode_id, segment_idx, start_frame as start, end_frame as \"end\", trim(role) as phase, null::varchar as target, case when lower(trim(text)) not in ('', 'nan') then trim(text) end as text, null::varchar as evidence from seg")
def viewer_rows(spark, d):
    return views.viewer_segments(segments_of(_annotations(spark, d)))


@query(f"with {SC} select episode_id, quality, case novelty::bigint % 3 when 0 then 'slow' when 1 then 'fast' end as speed, round(novelty / 7, 5) as novelty, null::double as curation_value, null::varchar as curation_tier, 'joint' as control_modality from sc")
def module_rows(spark, d):
    m = s.scores(spark, d).withColumns({"speed": F.when(F.col("novelty").cast("long") % 3 == 0, "slow").when(F.col("novelty").cast("long") % 3 == 1, "fast"), "curation_value": F.lit(None).cast("double"), "curation_tier": F.lit(None).cast("string"), "control_modality": F.lit("joint")})
    return views.module_block(m.withColumn("novelty", F.col("novelty") / 7))


@query(f"with {CONV} select episode_id::varchar as episode_id, segment_idx, end_frame as frame_idx, null::varchar as retrieved_episode_id, null::bigint as retrieved_frame_idx from seg")
def subgoal_rows(spark, d):
    return views.subgoal_block(subgoals_of(_annotations(spark, d)))


def _gallery(spark, d):
    scores = s.scores(spark, d)
    speed = F.when(F.col("episode_id") % 4 == 0, "slow").when(F.col("episode_id") % 4 == 1, "medium").when(F.col("episode_id") % 4 == 2, "fast")
    one = scores.select("episode_id", "quality", "novelty", F.when(F.col("quality") == 5, "full").otherwise("minimal").alias("curation_tier"), speed.alias("speed"), (F.col("novelty") / 3).alias("curation_value"), (F.col("episode_id") % 7).alias("n_flags"), (1 / (1 + F.col("novelty"))).alias("sort_iou"))
    two = s.conversation_episodes(spark, d).select("episode_id", F.lit(3).alias("quality"))
    return views.merge_galleries([("docs", one), ("talk", two)])


GAL = f"{SC}, {CONV}, gal as (select 'docs::' || episode_id as episode_id, 'docs' as task, 0 as ord, quality, novelty, case when quality = 5 then 'full' else 'minimal' end as tier, ['slow', 'medium', 'fast', null][episode_id % 4 + 1] as speed, novelty / 3 as value, episode_id % 7 as flags, 1 / (1 + novelty) as iou from sc union all select distinct 'talk::' || episode_id, 'talk', 1, 3, null, null, null, null, null, null from seg)"


@query(f"with {GAL} select episode_id from gal where task = 'docs' and tier = 'full'")
def gallery_filter(spark, d):
    return views.filtered_gallery(_gallery(spark, d), "docs", "full").select("episode_id")


_ORDERS = {
    "id": "episode_id", "iou": "iou nulls last, episode_id", "flags": "flags desc nulls last, episode_id", "quality": "quality desc nulls last, episode_id", "novelty": "novelty desc nulls last, episode_id",
    "value": "value desc nulls last, episode_id", "speed": "case speed when 'slow' then 0 when 'medium' then 1 when 'fast' then 2 else -1 end desc, episode_id",
}


@query(" union all ".join(f"(with {GAL} select '{k}' as by, string_agg(episode_id, ',' order by {'ord, ' if i % 2 else ''}{o}) as ids from gal)" for i, (k, o) in enumerate(_ORDERS.items())))
def gallery_orders(spark, d):
    """Every order of the viewer over two galleries, every other one grouped by task."""
    g, out = materialize(_gallery(spark, d), "gallery"), None
    for i, by in enumerate(_ORDERS):
        ordered = views.places(g, by, grouped=bool(i % 2)).withColumnRenamed("place", "k")
        one = ordered.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "episode_id"))), lambda x: x["episode_id"]), ",").alias("ids")).select(F.lit(by).alias("by"), "ids")
        out = one if out is None else out.union(one)
    return out


@query(" union all ".join(f"(with {GAL} select '{k}' as by, row_number() over (order by {'ord, ' if i % 2 else ''}{o}) as place, episode_id from gal)" for i, (k, o) in enumerate(_ORDERS.items())))
def gallery_places(spark, d):
    """The place of every episode in every order of the viewer over two galleries."""
    g, out = materialize(_gallery(spark, d), "gallery"), None
    for i, by in enumerate(_ORDERS):
        one = views.places(g, by, grouped=bool(i % 2)).select(F.lit(by).alias("by"), "place", "episode_id")
        out = one if out is None else out.union(one)
    return out


@query(f"with {CONV}, e as (select distinct episode_id from seg) select 'flagged' as kind, count(*) as n from e where episode_id % 7 > 0 union all select 'ungraded', count(*) from e where episode_id not in (select doc_id from labels) union all select 'all', count(*) from e")
def review_queues(spark, d):
    """How many episodes each queue holds."""
    payloads = s.conversation_episodes(spark, d).withColumn("n_flags", F.col("episode_id") % 7)
    grades = s.table(spark, d, "labels").select(F.col("doc_id").alias("item_id"))
    out = None
    for only in ("flagged", "ungraded", "all"):
        one = views.queue(payloads, grades, only).agg(F.count("*").alias("n")).select(F.lit(only).alias("kind"), "n")
        out = one if out is None else out.union(one)
    return out


@query(f"with {CONV}, e as (select distinct episode_id from seg) select count(*) as episode_count, count_if(episode_id % 3 <> 0)::bigint as reviewed_count from e")
def review_states(spark, d):
    return gold.review_state(_gold(spark, d))


@query(f"""with {CONV}, {ENDS}, {SC} select nn.episode_id::varchar as episode_id, sc.quality as auto_quality, k as n_subtasks, (select string_agg(start_frame || '-' || end_frame, ',' order by segment_idx) from seg where seg.episode_id = nn.episode_id) as auto_spans, true as human_empty, '' as review_notes from nn left join sc on nn.episode_id = sc.episode_id""")
def gold_templates(spark, d):
    """A fresh gold table: model labels in, human labels empty."""
    t = gold.template(episode_view(_annotations(spark, d)))
    empty = F.col("gold.metadata").isNull() & F.forall("gold.subtasks", lambda x: x["start_frame"].isNull() & x["end_frame"].isNull() & x["accept_auto"].isNull()) & F.forall("gold.subgoals", lambda x: x["frame_idx"].isNull())
    return t.select("episode_id", F.col("auto.metadata.quality").alias("auto_quality"), F.size("gold.subtasks").alias("n_subtasks"), F.array_join(F.transform("auto.subtasks", lambda x: F.concat_ws("-", x["start_frame"], x["end_frame"])), ",").alias("auto_spans"), empty.alias("human_empty"), "review_notes")


# --- sources


@query("with e as (select unnest(range(5)) as e), f as (select e, unnest(range(24)) as f from e) select 'synthetic_0' || e as episode_id, f as frame_idx, round(f * 1 / 24.0::double, 6) as first, case when f >= 12 then 1.0 else 0.0 end::double as last from f")
def synthetic_source(spark, d):
    """Frames of five generated episodes."""
    _, frames = src.synthetic(spark, 5)
    return frames.select("episode_id", "frame_idx", F.round(F.get("action", F.lit(0)), 6).alias("first"), F.element_at("action", -1).cast("double").alias("last"))


@query("select doc_id as episode_id from documents order by doc_id::varchar limit 10")
def first_ten(spark, d):
    """The first ten episodes in canonical order, as a probe takes them."""
    return src.first_episodes(s.table(spark, d, "documents").select(F.col("doc_id").alias("episode_id")), 10)


# --- oracles of queries that had none


def _unnegated(words: list[str]) -> str:
    return f"len(list_filter(range(1, len(t) + 1), lambda i: list_contains({words!r}, t[i]) and not list_has_any(t[greatest(i - 10, 1) : i - 1], {text.NEGATORS!r}))) > 0"


_EVEN4 = "round_even(i * greatest(l, 3) / 4.0::double, 0)::bigint"
ORACLE_SQL |= {
    "mock_answers": f"""with {CONV}, e as (select episode_id, max(end_frame) as l from seg group by 1), b as (select *, unnest(range(4)) as i from e),
x as (select episode_id, i, {_EVEN4} as a, case when i = 3 then greatest(l, 3) else greatest({_EVEN4}, {_EVEN4.replace('i *', '(i + 1) *')} - 1) end as b, ['approach', 'grasp', 'transport', 'retract'][i + 1] as p from b)
select episode_id::varchar as episode_id, 'grounded/s0_a0' as stage, 200::bigint as status_code, '{{"segments": [' || string_agg('{{"start_frame": ' || a || ', "end_frame": ' || b || ', "phase": "' || p || '", "target": "' || case when i = 3 then 'none' else 'the mock object' end || '", "subtask_text": "' || p || ' step", "evidence": "stand-in evidence at frame ' || b || '"}}', ', ' order by i) || ']}}' as answer from x group by 1""",
    "thumb_frames_all": f"with {CONV} select episode_id, arg_min(end_frame, segment_idx) as thumb_frame from seg group by 1",
    "gold_update_all": f"with {CONV}, {SC}, e as (select distinct episode_id from seg) select e.episode_id, sc.quality, case when sc.quality is not null then coalesce(sc.mistake, e.episode_id % 2 = 0) end as mistake, case when sc.quality is not null then 'seen' end as reason from e left join sc on e.episode_id = sc.episode_id",
    "gold_sync_all": f"with {CONV}, {SC}, e as (select distinct episode_id from seg) select e.episode_id, sc.quality from e left join sc on e.episode_id = sc.episode_id",
    "boundary_scores": f"""with recursive {EVEN}, {ENDS},
p as (select episode_id, list(end_frame order by segment_idx) as ps from ev group by 1), g as (select episode_id, list_sort(list(end_frame order by segment_idx)[:-2]) as gs from seg group by 1),
j as (select p.episode_id, ps[:-2] as ps, gs from p join g on p.episode_id = g.episode_id),
r as (select episode_id, 0 as k, ps as rest, []::bigint[] as errors, gs, ps from j
union all select episode_id, k + 1, case when best is null then rest else list_filter(rest, lambda x, i: i <> best.i) end, case when best is null then errors else list_append(errors, best.d) end, gs, ps
  from (select *, list_sort(list_filter(list_transform(rest, lambda x, i: struct_pack(d := abs(x - gs[k + 1]), i := i)), lambda b: b.d <= 40))[1] as best from r where k < len(gs)))
select episode_id, len(errors)::bigint as matched, len(ps)::bigint as n_pred, len(gs)::bigint as n_gold, case when len(ps) > 0 then len(errors) / len(ps)::double end as precision, case when len(gs) > 0 then len(errors) / len(gs)::double end as recall,
  case when len(errors) > 0 then list_sum(errors) / len(errors)::double end as mae from r where k = len(gs)""",
    "snapped_segments": f"""with recursive {TR}, k as (select episode_id, min(frame_idx) as frame_idx from tr group by 1
union all select episode_id, n from (select k.episode_id, (select min(r.frame_idx) from tr r where r.episode_id = k.episode_id and r.frame_idx >= k.frame_idx + 8) as n from k) where n is not null),
m as (select k.episode_id, k.frame_idx as f, kind from k join tr on k.episode_id = tr.episode_id and k.frame_idx = tr.frame_idx),
n as (select episode_id, greatest(count(*) - 1, 3) as l from fr where episode_id in (select episode_id from m) group by 1),
e as (select episode_id, l, [round_even(i * l / 4.0::double, 0)::bigint for i in range(4)] as s from n),
b as (select episode_id, s, [greatest(s[1], s[2] - 1), greatest(s[2], s[3] - 1), greatest(s[3], s[4] - 1), l] as e from e),
x as (select *, (select min(struct_pack(d := abs(f - e[1]), f := f)) from m where m.episode_id = b.episode_id and kind = 'close') as c from b),
y as (select *, case when c.d <= 8 and c.f > s[1] and c.f < e[2] then c.f end as c0, (select min(struct_pack(d := abs(f - e[2]), f := f)) from m where m.episode_id = x.episode_id and kind = 'open') as o from x),
z as (select *, case when o.d <= 8 and o.f > coalesce(c0 + 1, s[2]) and o.f < e[3] then o.f end as o1 from y),
w as (select episode_id, [s[1], coalesce(c0 + 1, s[2]), coalesce(o1 + 1, s[3]), s[4]] as s, [coalesce(c0, e[1]), coalesce(o1, e[2]), e[3], e[4]] as e from z)
select episode_id, i as segment_idx, s[i + 1] as start_frame, e[i + 1] as end_frame, p[i + 1] as subtask_text, p[i + 1] as phase, null::varchar as evidence, null::varchar as target from w, (select ['approach', 'grasp', 'release', 'retract'] as p), (select unnest(range(4)) as i)""",
    "proprioceptive_segments": f"""with recursive {EE}, cl as (select episode_id, frame_idx, (x - min(x) over p) / (max(x) over p - min(x) over p) < 0.5 as c, max(x) over p - min(x) over p as w from (select *, (event_id % 7)::double as x from fr) window p as (partition by episode_id)),
tr as (select episode_id, frame_idx from (select *, lag(c) over (partition by episode_id order by frame_idx) as was from cl) where was <> c and w > 1e-9),
k as (select episode_id, min(frame_idx) as frame_idx from tr group by 1
union all select episode_id, n from (select k.episode_id, (select min(r.frame_idx) from tr r where r.episode_id = k.episode_id and r.frame_idx >= k.frame_idx + 8) as n from k) where n is not null),
fi as (select episode_id, min(frame_idx) as g, max(frame_idx) as r from k group by 1),
a as (select episode_id, g as f, 0 as floor from fi union all select episode_id, r, g + 1 from fi where r > g),
pz as (select a.episode_id, f, arg_min(es.i, struct_pack(s := es.s, i := es.i)) as b from a join es on es.episode_id = a.episode_id and es.i >= greatest(floor, f - 40) and es.i < f and f - greatest(floor, f - 40) >= 2 group by 1, 2),
lo as (select *, s < quantile_cont(s, 0.25) over (partition by episode_id) as low, count(*) over (partition by episode_id) as n from es),
lr as (select *, sum(case when low then 0 else 1 end) over (partition by episode_id order by i) as run from lo),
al as (select episode_id, floor((a + b + 1) / 2)::bigint as b from (select episode_id, run, min(i) as a, max(i) as b, any_value(n) as n from lr where low and n >= 4 group by 1, 2) where a >= 1 and a < n - 1 and episode_id not in (select episode_id from fi)),
n as (select episode_id, count(*) as n from fr group by 1),
mk as (select distinct x.episode_id, b from (select episode_id, f as b from a union all select episode_id, b from pz union all select episode_id, b from al) x join n on n.episode_id = x.episode_id where b > 0 and b < n - 1),
kp as (select episode_id, min(b) as b from mk group by 1 union all select episode_id, x from (select kp.episode_id, (select min(m.b) from mk m where m.episode_id = kp.episode_id and m.b >= kp.b + 5) as x from kp) where x is not null),
ed as (select episode_id, -1 as b from n union all select * from kp),
sg as (select ed.episode_id, b, row_number() over w - 1 as i, lead(b) over w as nx, n from ed join n on n.episode_id = ed.episode_id window w as (partition by ed.episode_id order by b)),
ph as (select *, coalesce(['approach', 'grasp', 'transport', 'release-place', 'retract'][i + 1], 'other') as p from sg)
select episode_id, i as segment_idx, b + 1 as start_frame, coalesce(nx, n - 1) as end_frame, case when n <= 1 then 'complete the task' else p || ' (proprioceptive)' end as subtask_text, case when n <= 1 then 'other' else p end as phase, case when n > 1 then 'gripper/end-effector event' end as evidence, null::varchar as target from ph""",
    "gate_all": f"""with {OUT}, {CONV}, st as (select episode_id, count(*) as k, avg(end_frame - start_frame + 1) as m, stddev_pop(end_frame - start_frame + 1) / nullif(avg(end_frame - start_frame + 1), 0) as cv, count(nullif(text, '')) as nt, count(distinct lower(trim(nullif(text, '')))) as dt from seg group by 1),
o as (select doc_id, lower(text) as o from documents where text is not null), gr as (select seg.episode_id, list_filter({TOK % 'seg.text'}, lambda w: not contains(o, w) and not contains('talk', w))[1] as w from seg join o on seg.episode_id = o.doc_id),
tk as (select episode_id, quality as q, coalesce(mistake, false) as mistake, regexp_extract_all(lower(coalesce(reason, '')), '[a-z0-9_]+') as t from sc where quality is not null), wd as (select *, {_unnegated(text.SUCCESS_WORDS)} as good, {_unnegated(text.FAILURE_WORDS)} as bad from tk),
dq as (select count(quality) as n, count(distinct quality) as d, string_agg(distinct quality::varchar, ', ') as qs from sc)
select episode_id::varchar as episode_id, 'repeated_subtask_text' as "check", 'duplicate subtask text within episode' as detail from st where dt < nt
union all select episode_id::varchar, 'object_grounding', chr(39) || w || chr(39) || ' not in stage-one observation' from gr where w is not null
union all select episode_id::varchar, 'placeholder_reason', 'missing or templated reason' from sc where list_contains({['', *text.PLACEHOLDER_REASONS]!r}, lower(trim(coalesce(reason, ''))))
union all select episode_id::varchar, 'score_reason_contradiction', 'low quality with success reason' from wd where q <= 2 and good and not bad
union all select episode_id::varchar, 'score_reason_contradiction', 'high quality with failure reason' from wd where q >= 4 and bad and not good
union all select episode_id::varchar, 'score_reason_contradiction', 'mistake=true with perfect quality' from wd where mistake and q >= 5
union all select episode_id::varchar, 'degenerate_single_segment', 'a single subtask spans the whole episode' from st where k <= 1
union all select episode_id::varchar, 'uniform_split', 'segment lengths are near-uniform (boundaries not grounded to frames)' from st where k >= 3 and m > 0 and cv < 0.12
union all select '__dataset__', 'collapsed_score_distribution', 'only ' || d || ' distinct quality score(s) [' || qs || '] across ' || n || ' episodes' from dq where n >= 8 and d < 2
union all select episode_id, "check", detail from ol""",
}
ORACLE_SQL["episode_payloads_all"] = f"""with ga as ({ORACLE_SQL['gate_all']}), n as (select episode_id, count(*) as n from ga group by 1), {PAIR}, io as (select episode_id::varchar as episode_id, avg(iou) as iou from pr group by 1)
select io.episode_id, round(least(1.0, iou), 4) as sort_iou, coalesce(n.n, 0)::bigint as n_flags from io left join n on n.episode_id = io.episode_id"""
ORACLE_SQL["export_json_lines"] = f"""with {CONV}, {SC}, {ENDS}, li as (select episode_id, list(struct_pack(segment_idx := segment_idx, frame_idx := end_frame, image_path := null::varchar) order by segment_idx) as goals,
  list(struct_pack(segment_idx := segment_idx, active_dof := null::varchar, end_frame := end_frame, start_frame := start_frame, subtask_text := text) order by segment_idx) as segs from seg group by 1)
select nn.episode_id::varchar as episode_id, json_object('boundary_clarity', null, 'control_modality', null, 'control_mode', null, 'cost_usd', null, 'episode_id', nn.episode_id::varchar, 'fps', 10.0::double, 'mistake', sc.mistake, 'model', null, 'num_frames', l + 1,
  'provider', null, 'quality', sc.quality, 'reason', sc.reason, 'schema_version', '{SCHEMA_VERSION}', 'source', null, 'subgoals', goals, 'subtasks', segs, 'task', 'talk', 'task_success_quality', null)::varchar as json
from nn join li on nn.episode_id = li.episode_id left join sc on nn.episode_id = sc.episode_id"""
