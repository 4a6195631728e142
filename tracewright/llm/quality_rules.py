"""Quality rules with risk-controlled cutoffs; DataFrame functions only.

Each rule is "measure > cutoff rejects". For every stratum (language, null is one of its own), rule and cutoff of a
fixed grid, the labelled documents of good quality that pass the base rules are a holdout: with n of them, k rejected,
the exact binomial tail P(Bin(n, alpha) <= k) is the p-value of "this cutoff rejects a share alpha or more of good
documents". A cutoff is valid if the p-value is at most delta over the number of tests (Bonferroni over strata, rules
and cutoffs), so with confidence 1 - delta no valid cutoff in any stratum rejects more than alpha of the good documents;
alpha is ``total_alpha`` shared among the rules, so neither do the rules together. Of the valid cutoffs of a stratum
and rule the one with the largest gain (poor documents rejected less ``good_cost`` times good ones) acts; with no
positive gain, or too few labels for any cutoff to be valid, the rule is off there.

Definitions: a null text is empty (no words, base_failed). Labels of a doc_id that disagree, or are null, are not
used; equal repeats count once. Repeated documents each get a row. Documents without labels are judged by the cutoffs
of their stratum. Columns with clashing names are replaced by the measures; others pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_WORDS, content_key, materialize, maybe_broadcast

#: measure and its grid of cutoffs
RULES: dict[str, tuple[float, ...]] = {
    "symbol_share": (0.005, 0.01, 0.02, 0.04, 0.06, 0.08, 0.1, 0.15, 0.2, 0.3),
    "dup_line_share": (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8),
    "repeat_share": (0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45),
    "word_length": (6.0, 6.5, 7.0, 7.5, 8.0, 9.0, 10.0, 12.0),
}
TOTAL_ALPHA = 0.08
DELTA = 0.05
GOOD_COST = 10
STRATUM = "lang"
BASE = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def with_measures(documents: DataFrame) -> DataFrame:
    """Add the base counts (long) and base_failed. Three-word windows are compared within the row: sorted by hash with
    their places, equal neighbours are checked word by word."""
    text = F.coalesce(F.col("text"), F.lit(""))
    cols = documents.columns
    df = documents.drop(*BASE, "base_failed").withColumns({"__w": F.regexp_extract_all(text, F.lit(f"({SPACE_WORDS})"), 1), "__l": F.filter(F.split(text, "\n"), lambda x: x.rlike(SPACE_WORDS))})
    m = F.greatest(F.size("__w") - 2, F.lit(0))
    triples = F.arrays_zip(*(F.slice("__w", i, m).alias(n) for i, n in ((1, "a"), (2, "b"), (3, "c"))))
    hashed = F.transform(triples, lambda x, i: F.struct(F.xxhash64(x["a"], x["b"], x["c"]).alias("h"), i.alias("i")))
    df = df.withColumn("__s", F.sort_array(hashed))
    k = F.greatest(F.size("__s") - 1, F.lit(0))

    def equal(p):
        a, b = p["a"]["i"], p["b"]["i"]
        same = p["a"]["h"] == p["b"]["h"]
        for j in (1, 2, 3):
            same &= F.element_at("__w", a + j) == F.element_at("__w", b + j)
        return same

    pairs = F.filter(F.arrays_zip(F.slice("__s", 1, k).alias("a"), F.slice("__s", 2, k).alias("b")), equal)
    df = df.withColumn("__p", F.sort_array(F.array_distinct(F.flatten(F.transform(pairs, lambda p: F.array(p["a"]["i"], p["b"]["i"]))))))
    r = F.greatest(F.size("__p") - 1, F.lit(0))
    gaps = F.arrays_zip(F.slice("__p", 1, r).alias("a"), F.slice("__p", 2, r).alias("b"))
    covered = F.aggregate(gaps, F.lit(0), lambda s, g: s + F.least(F.lit(3), g["b"] - g["a"])) + F.when(F.size("__p") > 0, 3).otherwise(0)
    df = df.withColumns(
        {
            "n_words": F.size("__w").cast("long"),
            "word_chars": F.length(F.array_join("__w", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_lines": F.size("__l").cast("long"),
            "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
            "n_repeat_words": covered.cast("long"),
        }
    )
    df = df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return df.select(*[c for c in cols if c not in (*BASE, "base_failed")], *BASE, "base_failed")


def measure(rule: str) -> F.Column:
    """A rule's measure as a double from the base counts; 0 where its divisor is 0."""
    top, bottom = {
        "symbol_share": ("n_symbols", "word_chars"),
        "dup_line_share": ("n_dup_lines", "n_lines"),
        "repeat_share": ("n_repeat_words", "n_words"),
        "word_length": ("word_chars", "n_words"),
    }[rule]
    return F.when(F.col(bottom) > 0, F.col(top).cast("double") / F.col(bottom)).otherwise(F.lit(0.0))


def binomial_tail(n: F.Column, k: F.Column, p: float) -> F.Column:
    """P(Bin(n, p) <= k), summed exactly term by term in log space from term 0 upward.

    The running state is (log of the term, sum divided by the largest term so far, log of that largest term).
    """
    odds = F.log(F.lit(p / (1 - p)))
    first = n * F.log(F.lit(1 - p))

    def step(s, i):
        term = s["t"] + F.log((n - i + 1) / i) + odds
        top = F.greatest(s["m"], term)
        return F.struct(term.alias("t"), (s["s"] * F.exp(s["m"] - top) + F.exp(term - top)).alias("s"), top.alias("m"))

    zero = F.struct(first.alias("t"), F.lit(1.0).alias("s"), first.alias("m"))
    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    return F.aggregate(terms, zero, step, lambda s: s["s"] * F.exp(s["m"]))


def choose_cutoffs(measured: DataFrame, labels: DataFrame, total_alpha: float = TOTAL_ALPHA, delta: float = DELTA, good_cost: float = GOOD_COST) -> DataFrame:
    """(stratum, rule, cutoff) of the rules that act. ``measured`` has doc_id, ``STRATUM``, base counts, base_failed.

    Only counts per stratum, rule and cutoff are shuffled: every task adds up its own labelled documents first.
    """
    agreed = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("__max")).where("quality = __max").drop("__max")
    holdout = measured.where("not base_failed").join(agreed, "doc_id").select(F.col(STRATUM).alias("stratum"), "quality", *(measure(r).alias(r) for r in RULES))
    counts = [F.sum((F.col("quality") == 1).cast("long")).alias("good")]
    for r, grid in RULES.items():
        for i, cut in enumerate(grid):
            for q, name in ((1, "g"), (0, "b")):
                counts.append(F.sum(((F.col("quality") == q) & (F.col(r) > cut)).cast("long")).alias(f"{name}_{r}_{i}"))
    table = materialize(holdout.groupBy("stratum").agg(*counts), "holdout")
    n_tests = table.count() * sum(map(len, RULES.values()))
    cells = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(cut).alias("cutoff"), F.col(f"g_{r}_{i}").alias("g"), F.col(f"b_{r}_{i}").alias("b")) for r, grid in RULES.items() for i, cut in enumerate(grid)))
    tests = table.select("stratum", "good", F.inline(cells)).withColumns({"p_value": binomial_tail(F.col("good"), F.col("g"), total_alpha / len(RULES)), "gain": F.col("b") - good_cost * F.col("g")})
    valid = tests.where((F.col("p_value") <= delta / max(1, n_tests)) & (F.col("gain") > 0))
    return valid.groupBy("stratum", "rule").agg(F.max_by("cutoff", F.struct("gain", "cutoff")).alias("cutoff"))


def judge(measured: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Add kept: passes the base rules and no acting rule of its stratum rejects it."""
    wide = cutoffs.groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cutoff"))
    wide = maybe_broadcast(wide.select(F.col("stratum").alias("__stratum"), *(F.col(r).alias(f"__{r}") for r in RULES)), 100)
    bad = F.col("base_failed")
    for r in RULES:
        bad |= F.coalesce(measure(r) > F.col(f"__{r}"), F.lit(False))
    joined = measured.join(wide, F.col(STRATUM).eqNullSafe(F.col("__stratum")), "left").withColumn("kept", ~bad)
    return joined.drop("__stratum", *(f"__{r}" for r in RULES))


def judged(spark, sf_dir: str, **risk) -> DataFrame:
    """(doc_id, the base counts of the contract, base_failed, kept) of every document."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", STRATUM, "text")
    measured = materialize(with_measures(documents).drop("text"), "measures")
    cutoffs = choose_cutoffs(measured, spark.read.parquet(f"{sf_dir}/labels.parquet"), **risk)
    return judge(measured, cutoffs).select("doc_id", *[c for c in BASE if c != "n_lines"], "base_failed", "kept")


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Contract query: counts and verdict of every document."""
    return judged(spark, sf_dir)


#: A lenient risk, at which cutoffs act even on a few hundred labels.
LENIENT = {"total_alpha": 0.2, "delta": 0.2, "good_cost": 1}


def quality_rules_lenient(spark, sf_dir: str) -> DataFrame:
    """The same verdict at a lenient risk."""
    return judged(spark, sf_dir, **LENIENT)


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Pipeline stage: documents that the rules keep, unchanged. Rejected texts are named by content and stratum."""
    keyed = documents.select("doc_id", STRATUM, content_key("text").alias("__key"), "text")
    measured = materialize(with_measures(keyed).drop("text"), "measures")
    bad = judge(measured, choose_cutoffs(measured, labels)).where("not kept").select(F.col("__key").alias("__bad"), F.col(STRATUM).alias("__lang")).distinct()
    same = (F.col("__key") == F.col("__bad")) & F.col(STRATUM).eqNullSafe(F.col("__lang"))
    return documents.withColumn("__key", content_key("text")).join(bad, same, "left_anti").drop("__key")


def _oracle(data: str = "documents", total_alpha: float = TOTAL_ALPHA, delta: float = DELTA, good_cost: float = GOOD_COST) -> str:
    grid = ", ".join(f"('{r}', {cut!r}::double)" for r, g in RULES.items() for cut in g)
    m = {"symbol_share": ("n_symbols", "word_chars"), "dup_line_share": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words"), "word_length": ("word_chars", "n_words")}
    shares = ", ".join(f"case when {b} > 0 then {a}::double / {b} else 0 end as {r}" for r, (a, b) in m.items())
    value = "case g.rule " + " ".join(f"when '{r}' then {r}" for r in RULES) + " end"
    return f"""
with d as (select row_number() over () as rid, doc_id, lang, coalesce(text, '') as t from {data}),
w as (select rid, doc_id, lang, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from d),
x as (select rid, unnest(w) as a, generate_subscripts(w, 1) as i from w),
tri as (select rid, i, a, lead(a) over z as b, lead(a, 2) over z as c from x window z as (partition by rid order by i)),
rep as (select rid, i from (select rid, i, count(*) over (partition by rid, a, b, c) as n from tri where c is not null) where n > 1),
cov as (select rid, count(distinct i + j)::bigint as n_repeat_words from rep, (select unnest([0, 1, 2]) as j) group by rid),
f as (select w.rid, doc_id, lang, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols, len(l)::bigint as n_lines,
        (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words
      from w left join cov on w.rid = cov.rid),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, {shares} from f),
lab as (select doc_id, min(quality) as quality from labels where quality is not null group by doc_id having min(quality) = max(quality)),
h as (select b.*, quality from b join lab on b.doc_id = lab.doc_id where not base_failed),
g(rule, cutoff) as (values {grid}),
s as (select lang, count(*) filter (quality = 1) as n from h group by lang),
k as (select h.lang, g.rule, g.cutoff, count(*) filter (quality = 1 and {value} > g.cutoff) as k,
        count(*) filter (quality = 0 and {value} > g.cutoff) as bad from h cross join g group by all),
p as (select k.*, s.n, (select sum(exp(lgamma(s.n + 1) - lgamma(i + 1) - lgamma(s.n - i + 1) + i * ln({total_alpha / len(RULES)!r}) + (s.n - i) * ln(1 - {total_alpha / len(RULES)!r})))
        from unnest(range(k.k + 1)) as r(i)) as p_value
      from k join s on k.lang is not distinct from s.lang where bad - {good_cost} * k > 0),
c as (select lang, rule, arg_max(cutoff, (bad - {good_cost} * k) * 1e6 + cutoff) as cutoff from p
      where p_value <= {delta!r} / ((select count(*) from s) * (select count(*) from g)) group by lang, rule)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not exists (select 1 from c as g where g.lang is not distinct from b.lang and {value} > g.cutoff) as kept
from b"""


ORACLE_SQL = {"op7_quality_rules": _oracle(), "quality_rules_lenient": _oracle(**LENIENT)}
