"""Base counts, exact binomial tails, chosen cutoffs and the bound on false rejections, each by brute force."""

import math
import random
import re
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from tracewright.llm import quality_rules as q

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    w = SPACE.findall(text or "")
    lines = [x for x in (text or "").split("\n") if SPACE.search(x)]
    triples = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(triples)
    covered = {i + j for i, t in enumerate(triples) if often[t] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines), len(lines) - len(set(lines)), len(covered)


def tail(n, k, p):
    """P(Bin(n, p) <= k) in whole numbers."""
    a, b = Fraction(str(p)).as_integer_ratio()
    return float(Fraction(sum(math.comb(n, i) * a**i * (b - a) ** (n - i) for i in range(k + 1)), b**n))


def test_counts_of_odd_texts(spark):
    texts = [None, "", " \n\t", "a", "a b c a b c a b c", "x\nx\n\nx\n y\n y", "é 漢字 🙂 # * $", "a b a b a b", "one\r\ntwo\r\none\r", "w " * 5000 + "end", " ".join(f"w{i % 7}" for i in range(90)), "a\x1cb c"]
    docs = spark.createDataFrame([(i, t, "en", 7, "k") for i, t in enumerate(texts)], "doc_id long, text string, lang string, n_words int, kept string")
    got = {r["doc_id"]: r for r in q.with_measures(docs).collect()}
    for i, t in enumerate(texts):
        want = counts(t)
        assert tuple(got[i][c] for c in q.BASE) == want, (i, want)
        assert got[i]["base_failed"] == (want[0] < 50 or 100 * want[5] > 50 * want[0]) and got[i]["kept"] == "k"


def test_binomial_tail_is_exact(spark):
    cells = [(n, k) for n in (1, 2, 39, 236, 307, 5000) for k in (0, 1, 5, 30, 200) if k <= n]
    for p in (0.02, 0.3):
        df = spark.createDataFrame(cells, "n long, k long")
        for r in df.withColumn("t", q.binomial_tail(df["n"], df["k"], p)).collect():
            want = tail(r["n"], r["k"], p)
            assert math.isclose(r["t"], want, rel_tol=1e-9), (r, want)


def planted(seed, n, share):
    """Measures and labels: of the good, a share lies beyond the cutoff 0.1 of repeat_share; all of the poor do."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        bad_looking = not good or rng.random() < share
        rows.append((i, "en", 100, 500, 0, 10, 0, 42 if bad_looking else 0, False))
        labels.append((i, int(good)))
    return rows, labels


KINDS = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def test_planted_cutoffs_act_and_ties_go_to_the_largest(spark):
    rows, labels = planted(1, 2000, 0.0)
    m, lab = spark.createDataFrame(rows, KINDS), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {(r["stratum"], r["rule"]): r["cutoff"] for r in q.choose_cutoffs(m, lab).collect()}
    assert got == {("en", "repeat_share"): 0.4}  # all cutoffs below 0.42 reject the same: the largest of them acts
    out = q.judge(m, q.choose_cutoffs(m, lab))
    assert out.where("kept").count() == 1500 and out.columns == [*m.columns, "kept"]
    # labels that disagree, are null or repeat; none at all; a null stratum of its own
    odd = lab.union(spark.createDataFrame([(0, 1), (4, None), (8, 0), (8, 0)], lab.schema))
    assert q.judge(m, q.choose_cutoffs(m, odd)).where("kept").count() == 1500
    assert q.choose_cutoffs(m, lab.where("false")).count() == 0 and q.choose_cutoffs(m.where("false"), lab).count() == 0
    none = m.withColumn("lang", q.F.lit(None).cast("string"))
    assert q.judge(none, q.choose_cutoffs(none, lab)).where("kept").count() == 1500


def test_bound_on_false_rejections_holds(spark):
    """Where the true share of falsely rejected is just above alpha, hardly a holdout lets the cutoff act."""
    alpha, acted = q.TOTAL_ALPHA / len(q.RULES), 0
    for seed in range(2):
        rows, labels = planted(seed, 1200, alpha * 1.05)
        m, lab = spark.createDataFrame(rows, KINDS), spark.createDataFrame(labels, "doc_id long, quality int")
        acted += q.choose_cutoffs(m, lab, good_cost=0).count() > 0
    assert acted <= 1  # delta / 34 a cutoff


@pytest.mark.parametrize("name,sf", [("op7_quality_rules", "sf0.01"), ("quality_rules_lenient", "sf0.01")])
def test_given_documents_against_sql(spark, name, sf):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '/root/testdata/{sf}/{t}.parquet'")
    want = Counter(con.sql(q.ORACLE_SQL[name]).fetchall())
    got = Counter(map(tuple, getattr(q, name)(spark, f"/root/testdata/{sf}").collect()))
    assert got == want
    by_method = sum(n for r, n in got.items() if not r[-2] and not r[-1])
    assert (by_method > 0) == (name == "quality_rules_lenient")


def test_lenient_sql_by_numpy(spark):
    """The cutoffs that act, chosen again from measures by the definition."""
    d = "/root/testdata/sf0.01"
    m = q.with_measures(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "text")).drop("text").toPandas()
    lab = spark.read.parquet(f"{d}/labels.parquet").where("quality is not null").toPandas().groupby("doc_id")["quality"].agg(["min", "max"])
    lab = lab[lab["min"] == lab["max"]]["min"]
    h = m[~m["base_failed"] & m["doc_id"].isin(lab.index)].assign(quality=lambda x: x["doc_id"].map(lab))
    parts = {"symbol_share": ("n_symbols", "word_chars"), "dup_line_share": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words"), "word_length": ("word_chars", "n_words")}
    n_tests, want = h["lang"].nunique(dropna=False) * sum(map(len, q.RULES.values())), {}
    for lang, g in h.groupby("lang", dropna=False):
        for rule, grid in q.RULES.items():
            top, bottom = (g[c].to_numpy(float) for c in parts[rule])
            x = np.divide(top, bottom, out=np.zeros_like(top), where=bottom > 0)
            good = g["quality"].to_numpy() == 1
            best = [(int((~good & (x > c)).sum()) - q.LENIENT["good_cost"] * int((good & (x > c)).sum()), c) for c in grid if tail(int(good.sum()), int((good & (x > c)).sum()), q.LENIENT["total_alpha"] / 4) <= q.LENIENT["delta"] / n_tests]
            if best and max(best)[0] > 0:
                want[lang, rule] = max(best)[1]
    got = q.choose_cutoffs(q.with_measures(spark.read.parquet(f"{d}/documents.parquet")).drop("text"), spark.read.parquet(f"{d}/labels.parquet"), **q.LENIENT)
    assert {(r["stratum"], r["rule"]): r["cutoff"] for r in got.collect()} == want and want
