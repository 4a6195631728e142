"""Column functions over texts, labels and JSON answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the rules.
SUCCESS_WORDS = ["success", "successfully", "completed", "clean", "placed", "resting", "inside"]
FAILURE_WORDS = ["fail", "failed", "failing", "unfinished", "wrong", "incomplete", "mistake", "incorrect", "drop"]
NEGATORS = ["no", "not", "without", "none", "never"]
STOP_WORDS = [
    "after", "across", "above", "and", "before", "beside", "from", "into", "onto", "over", "that", "the", "toward", "towards", "with", "without",
    "then", "while", "back", "down", "approach", "approaches", "align", "aligns", "ascend", "bring", "brings", "carry", "carries", "complete",
    "completes", "completed", "descend", "drop", "drops", "finish", "finishes", "grasp", "grasps", "grasping", "grip", "grips", "hold", "holds",
    "hover", "hovers", "insert", "inserts", "leave", "lift", "lifts", "lower", "lowers", "lowered", "move", "moves", "moving", "pick", "picks",
    "pickup", "place", "places", "placing", "position", "positions", "positioned", "pull", "pulls", "push", "pushes", "raise", "raises", "raised",
    "reach", "reaches", "reaching", "relocate", "relocates", "release", "releases", "retract", "retracts", "retreat", "retreats", "return", "returns",
    "rotate", "rotates", "scoop", "set", "sets", "settle", "slide", "slides", "stabilize", "stabilizes", "steady", "transport", "transports",
    "transporting", "turn", "turns", "withdraw", "arm", "gripper", "robot", "hand", "effector", "manipulator", "wrist", "claw", "clear",
    "destination", "edge", "empty", "object", "objects", "partial", "task", "target", "black", "blue", "green", "gray", "grey", "metal", "orange",
    "pink", "purple", "red", "silver", "sink", "white", "yellow",
]
PLACEHOLDER_REASONS = ["one short sentence", "specific evidence consistent with both scores", "mock: placeholder reason, not derived from the frames"]
NO_TARGET = ["", "none", "n/a", "na", "-", "null", "the scene", "scene", "object"]
WIND_DOWN = ["retract", "withdraw", "retreat", "return", "go home", "home", "reset", "back away"]
CONTACT = ["grasp", "release", "place", "pick", "grip", "contact", "lift", "drop", "set down"]
GRASP = ["grasp", "grip", "pick", "pinch", "clamp"]
RELEASE = ["release", "place", "drop", "deposit", "let go", "set down", "put down"]
EFFECTOR_TOKENS = ["pose", "eef", "tcp", "cartesian", "ee_", "_ee"]
EFFECTOR_AXES = ["x", "y", "z", "roll", "pitch", "yaw", "qx", "qy", "qz", "qw"]
NEGATION_REACH = 10


def words_array(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def contains_any(text: Column, parts: list[str]) -> Column:
    """True if lower-cased text holds any of the parts; null and blank hold none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(False)
    for p in parts:
        out |= low.contains(p)
    return out


def object_tokens(text: Column) -> Column:
    """Lower-cased words of 4 letters or more without edge punctuation, stop words left out, in order."""
    words = F.transform(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: F.lower(F.regexp_replace(w, r"^[.,:;()\[\]{}]+|[.,:;()\[\]{}]+$", "")))
    stop = words_array(STOP_WORDS)
    return F.filter(words, lambda w: (F.length(w) >= 4) & ~F.array_contains(stop, w))


def has_unnegated(text: Column, words: list[str]) -> Column:
    """One of the words occurs with no negation among the 10 words before it."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_]+"), 0)
    wanted, negators = words_array(words), words_array(NEGATORS)

    def holds(pair):
        i = pair["i"]
        first = F.greatest(i - NEGATION_REACH, F.lit(0))
        return F.array_contains(wanted, pair["t"]) & ~F.arrays_overlap(F.slice(tokens, first + 1, i - first), negators)

    return F.exists(F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.alias("i"))), holds)


def clean_target(value: Column) -> Column:
    s = F.trim(F.coalesce(value, F.lit("")))
    return F.when(F.lower(s).isin(NO_TARGET), None).otherwise(F.substring(s, 1, 80))


def query_target(value: Column) -> Column:
    s = F.trim(F.coalesce(value, F.lit("")))
    return F.when(F.lower(s).isin("", "nan", "none"), None).otherwise(s)


def blank_to_null(value: Column) -> Column:
    s = F.trim(value)
    return F.when(F.lower(s).isin("", "nan"), None).otherwise(s)


def is_wind_down(phase: Column) -> Column:
    return contains_any(phase, WIND_DOWN)


def is_contact(phase: Column) -> Column:
    return contains_any(phase, CONTACT)


def contact_kind(phase: Column) -> Column:
    """grasp, release or other; grasp is looked for first."""
    return F.when(contains_any(phase, GRASP), "grasp").when(contains_any(phase, RELEASE), "release").otherwise("other")


def target_optional(phase: Column, open_vocabulary: bool) -> Column:
    exact = F.coalesce(phase, F.lit("")) == "retract"
    return exact | is_wind_down(phase) if open_vocabulary else exact


def caption(i: Column, fps: Column) -> Column:
    """f{frame}  {seconds}s"""
    return F.format_string("f%d  %.2fs", i, i / F.greatest(fps.cast("double"), F.lit(1e-6)))


def captions(frames: Column, fps: Column) -> Column:
    return F.transform(frames, lambda i: caption(i, fps))


def manifest(frames: Column, fps: Column) -> Column:
    return F.array_join(F.transform(frames, lambda i: F.format_string("frame %d (%.2fs)", i, i / F.greatest(fps.cast("double"), F.lit(1e-6)))), ", ")


def clamp_quality(value: Column) -> Column:
    """Whole part cut to 1..5; null if it isn't a number."""
    whole = safe_int(value).cast("int")
    return F.when(whole.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(5), whole)))  # both skip nulls


def safe_int(value: Column) -> Column:
    return F.nanvl(value.cast("string").try_cast("double"), F.lit(None).cast("double")).cast("long")


def extract_json(text: Column) -> Column:
    """The JSON in an answer as text: code fences stripped; else the first bracket up to the last; null if invalid."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", "")
    inner = F.coalesce(F.nullif(F.regexp_extract(bare, r"(?s)[\{\[].*[\}\]]", 0), F.lit("")), bare)
    valid = lambda s: F.when(F.try_parse_json(s).isNotNull(), s)
    return F.coalesce(valid(bare), valid(inner))


def frame_answer(json: Column) -> Column:
    """The frame a refinement answers with: the first key present, else the value itself."""
    keys = ("frame", "frame_index", "end_frame", "transition_frame")
    found = F.coalesce(*(F.get_json_object(json, f"$.{k}") for k in keys), json)
    return found.try_cast("double").cast("int")


def metadata_answer(json: Column) -> Column:
    """Struct of the quality answer; keys have aliases. The success score falls back to the quality. An answer that is
    no JSON object gives nulls and a reason that says so."""
    get = lambda *names: F.coalesce(*(F.get_json_object(json, f"$.{n}") for n in names))
    both = lambda n: clamp_quality(get(n, f"{n}_1_to_5"))
    quality = F.coalesce(both("curation_quality"), both("quality"))
    mistake = F.lower(F.trim(get("mistake", "mistake_boolean")))
    return F.struct(
        quality.alias("quality"),
        F.coalesce(both("task_success_quality"), quality).alias("task_success_quality"),
        F.when(mistake.isNotNull(), mistake.isin("true", "yes", "1")).alias("mistake"),
        F.nullif(F.lower(F.trim(get("boundary_clarity"))), F.lit("")).alias("boundary_clarity"),
        F.nullif(F.trim(get("control_mode")), F.lit("")).alias("control_mode"),
        F.when(F.coalesce(F.trim(json), F.lit("")).startswith("{"), F.trim(F.coalesce(get("reason"), F.lit("")))).otherwise("unparseable answer").alias("reason"),
    )


def candidates_text(json: Column) -> Column:
    """Text of an answer of candidates with content parts, a line each."""
    parts = F.from_json(json, "candidates array<struct<content:struct<parts:array<struct<text:string>>>>>")["candidates"]
    return F.array_join(F.filter(F.flatten(F.transform(parts, lambda c: F.transform(c["content"]["parts"], lambda p: p["text"]))), lambda t: t != ""), "\n")


def output_text(json: Column) -> Column:
    """Text of an answer with output_text, or with output items of text parts, a line each."""
    items = F.from_json(json, "output array<struct<content:array<struct<type:string,text:string>>>>")["output"]
    wanted = F.filter(F.flatten(F.transform(items, lambda o: o["content"])), lambda p: p["type"].isin("output_text", "text") & (p["text"] != ""))
    return F.coalesce(F.get_json_object(json, "$.output_text"), F.array_join(F.transform(wanted, lambda p: p["text"]), "\n"))


def fill(template: str, **values: object) -> str:
    """Put values for {name} in a template; other braces stay."""
    for k, v in values.items():
        template = template.replace("{" + k + "}", str(v))
    return template
