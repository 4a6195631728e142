"""Importance resampling against a plain model: features by dict, buckets by crc32, sorted draw."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tracewright.llm import importance as m

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def model(documents, targets, share=m.SHARE, min_words=m.MIN_WORDS):
    bucket = lambda f: zlib.crc32(f.encode()) % m.BUCKETS
    s = Counter(bucket(f) for _, t in documents for f in features(t)[1])
    t = Counter(bucket(f) for x in targets for f in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (all_s + 10000.0) / ((s[b] + 1.0) * (all_t + 10000.0))))
    rows = []
    for i, (key, text) in enumerate(documents):
        words, f = features(text)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append([key, len(words), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), i])
    drawn = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    n = len(drawn) * share[0] // share[1]
    rank = {r[5]: i + 1 for i, r in enumerate(drawn[:n])}
    return sorted(((r[0], r[2], r[3], r[4], rank.get(r[5])) for r in rows), key=str)


def ran(spark, documents, targets):
    docs = spark.createDataFrame([(k, t, "x") for k, t in documents], "doc_id long, text string, weight string")
    items = spark.createDataFrame([(t,) for t in targets], "text string")
    got = m.resample(docs, items)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    return sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in got.collect()), key=str)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    words = ["the", "of", "Été", "naïve", "x1", "42", "ΩMEGA", "a", "b", "zz"]
    out = [(i, " ".join(r.choice(words) + r.choice(["", "", ",", ".\n", "\0", "\t-"]) for _ in range(r.randrange(60)))) for i in range(120)]
    out += [(200, None), (201, ""), (202, " .,;\n"), (203, "Ab aB AB ab"), (204, "the " * 50_000), (None, "of the " * 15), (None, "of the " * 15), (7, out[7][1])]
    return out


def test_equals_a_plain_model(spark, texts, monkeypatch):
    targets = [t for _, t in texts[:20]] + [None, "", "only here"]
    want = model(texts, targets)
    assert ran(spark, texts, targets) == want
    monkeypatch.setattr(m, "GROUP_BYTES", 900)  # many groups, whose dictionaries must meet
    assert ran(spark, texts, targets) == want


def test_empty_tables(spark, texts):
    assert ran(spark, [], ["a b"]) == []
    assert ran(spark, texts[:30], []) == model(texts[:30], [])


def test_features_of_a_group():
    names, code, n_words = m.code_words([b"b a b", b"", b"A  b"])
    assert names.to_pylist() == ["b", "a"] and list(code) == [0, 1, 0, 1, 0] and list(n_words) == [3, 0, 2]
    assert list(m.unpack_numbers(m.pack_numbers(code))) == list(code)
    group = m.Group(names, code, n_words, 3)
    dictionary = list(group.dictionary())
    strings = [x for _, s, _ in dictionary for x in s.to_pylist()]
    of = [sorted(strings[w] for w in group.which[group.owner == i]) for i in range(3)]
    assert of == [["a", "a b", "b", "b", "b a"], [], ["a", "a b", "b"]]
    for _, s, c in dictionary:
        again, counts = m.unpack_strings(m.pack_strings(s, c))
        assert again.equals(s) and (counts == c).all()


def test_distinct_by_both_ways():
    x = np.random.default_rng(1).integers(0, 50, 1000)
    for top in (50, 1 << 62):
        value, which = m.distinct(x, top)
        assert (value == np.unique(x)).all() and (value[which] == x).all()
