"""Factorisation machine: scores against the sum over all pairs, held-out accuracy, what may and may not teach."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import factorization as m

D = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    documents = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    return documents, spark.read.parquet(f"{D}/labels.parquet").select("doc_id", "quality")


def scores(df):
    return {r["doc_id"]: r["score"] for r in df.collect()}


def test_score_is_the_sum_over_all_pairs():
    texts = [b"The the CAT! a1 b#\n\nthe cat! x", b"", b"\xc3\xa9 \xc3\xa9 \xc3\xa9 | |\nq\nq", b" z "]
    f = m.Features(texts, np.array([30.0, np.nan, 9.0, np.nan]))
    model = m.Model(f.numbers.mean(axis=0), f.numbers.std(axis=0) + 1, 3)
    rng = np.random.default_rng(1)
    model.weight, model.bias = rng.normal(0, 0.3, len(model.weight)), 0.2
    model.factor = rng.normal(0, 0.3, model.factor.shape)
    for i, got in enumerate(model.score(f)):
        x = dict(zip(f.place[f.text == i].tolist(), f.value[f.text == i].tolist()))
        x |= {m.DIM + j: v for j, v in enumerate(model.scaled(f.numbers)[i])}
        keys = list(x)
        y = model.bias + sum(model.weight[k] * x[k] for k in keys)
        y += sum(float(model.factor[a] @ model.factor[b]) * x[a] * x[b] for n, a in enumerate(keys) for b in keys[n + 1 :])
        assert math.isclose(got, 1 / (1 + math.exp(-y)), rel_tol=1e-9)


def test_features_of_a_text():
    text = "The the CAT! a1 b#\n\nThe cat! | \nThe cat! | \nlong" + "x" * 30
    f = m.Features([b"other text", text.encode()], np.array([np.nan, 12.0]))
    words = Counter(w.lower() for w in re.findall(r"\S+", text))
    own = f.value[f.text == 1]
    norm = math.sqrt(sum(math.log1p(n) ** 2 for n in words.values()))
    assert np.allclose(sorted(own), sorted(math.log1p(n) / norm for n in words.values()))
    n, letters = sum(words.values()), sum(len(w) * c for w, c in words.items())
    got = dict(zip(m.STRUCTURE + m.METADATA, f.numbers[1]))
    root = lambda a, b: math.sqrt(a / b)
    want = {
        "log_words": math.log1p(n), "word_length": letters / n, "symbols": root(1, letters), "shouts": root(3, letters), "bars": root(2, letters), "digits": root(1, letters),
        "capitals": root(6, letters), "capital_words": root(1, n), "other_bytes": 0, "distinct_words": len(words) / n, "repeated_words": root(1, n), "repeated_lines": root(1, 4),
        "line_ends": root(4, n), "long_words": root(1, n), "n_chars": math.log1p(12),
    }
    for name, value in want.items():
        assert math.isclose(got[name], value, abs_tol=1e-12), name


def test_held_out_accuracy(spark, tables):
    got = m.op11_quality_classifier(spark, D)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(tables[1], "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    right = sum(r["predicted"] == r["quality"] for r in rows) / len(rows)
    good, bad = [r["score"] for r in rows if r["quality"] == 1], [r["score"] for r in rows if r["quality"] == 0]
    ranked = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert len(rows) > 100 and right >= 0.97 and ranked >= 0.97
    assert got.count() == tables[0].count()


def test_what_teaches(spark, tables):
    documents, labels = tables
    some = documents.where("doc_id < 300")
    base = scores(m.classify(some, m.train(some, labels)))
    assert scores(m.classify(some.repartition(7), m.train(some.repartition(5), labels))) == base
    flipped = labels.withColumn("quality", F.when(m.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert scores(m.classify(some, m.train(some, flipped))) == base
    blind = some.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("x")})
    assert scores(m.classify(blind, m.train(blind, labels))) == base
    doubtful = labels.union(labels.where("doc_id < 150").withColumn("quality", 1 - F.col("quality"))).union(labels.withColumn("quality", F.lit(None).cast("int")))
    assert scores(m.classify(some, m.train(some, doubtful))) == scores(m.classify(some, m.train(some, labels.where("doc_id >= 150"))))
    fewer = m.train(some, labels, rows=20)
    assert fewer is not None and scores(m.classify(some, fewer)) != base


def test_edges(spark, tables):
    labels = tables[1]
    odd = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "\n \t", "c"), (None, "x y", "d"), (None, "x y", "d"), (4, "w " * 200_000, "e")], "doc_id long, text string, score string")
    model = m.train(tables[0].where("doc_id < 200"), labels)
    got = m.classify(odd, model)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.where("score between 0 and 1").count() == 6
    assert got.where("doc_id is null and held_out").count() == 0
    assert m.train(odd, labels.where("false")) is None
    assert {r["score"] for r in m.classify(odd, None).collect()} == {0.5}
    assert m.classify(odd.where("false"), model).count() == 0
    one = m.train(tables[0], labels.where("quality = 1"))
    assert one is not None and m.classify(odd, one).count() == 6
