"""Periodic runs against brute force over all periods."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tracewright.llm import periodic as m

D = "/root/testdata/sf0.001"


def brute(w):
    best = {}
    for p in range(1, len(w) // 4 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(6, 4 * p):
                best.setdefault((i, j + p - 1), p)  # the smallest comes first
            i = j + 1
    return sorted(((a, b, p) for (a, b), p in best.items()), key=lambda r: (r[0], r[2]))


def factors(w):
    same = lambda i, j: next((k for k in range(len(w) - i) if w[i + k] != w[j + k]), len(w) - i)
    return [max((same(i, j) for j in range(i)), default=0) for i in range(len(w))]


def periodic_words(r):
    n, letters, kind = r.randrange(60), r.choice([1, 2, 3, 8]), r.randrange(5)
    w = [r.randrange(letters) for _ in range(n)]
    if kind == 1:
        w += w[: r.randrange(1, 9)] * r.randrange(3, 9) + w[: r.randrange(20)]
    if kind == 2:
        w = ([r.randrange(letters) for _ in range(r.randrange(1, 6))] * r.randrange(3, 7) + [r.randrange(letters)]) * r.randrange(1, 6) + w
    if kind == 3:
        a, w = [0], [0, 1]
        while len(w) < n:
            a, w = w, w + a
    if kind == 4:
        w = w + [9] + w + [8] + w[3:] * 4
    return w


@pytest.mark.parametrize("seed", range(6))
def test_steps_and_runs_of_many_texts(seed):
    r = random.Random(seed)
    for _ in range(25):
        texts = [periodic_words(r) for _ in range(r.randrange(1, 8))]
        edges, code = np.cumsum([0, *map(len, texts)]), np.array([x for t in texts for x in t], np.int64)
        sa = m.suffix_array(code, edges)
        assert sa.tolist() == [int(e) + i for t, e in zip(texts, edges) for i in sorted(range(len(t)), key=lambda i: t[i:])]
        got, source = m.previous_factors(sa, m.common_prefixes(code, edges, sa))
        assert got == [x for t in texts for x in factors(t)]
        flat = code.tolist()
        assert all(j < i and flat[i : i + got[i]] == flat[j : j + got[i]] for i, j in source.items())
        runs = m.runs_of_texts(code, edges)
        assert [runs.get(i, []) for i in range(len(texts))] == [brute(t) for t in texts]


def expected(rows, reshape):
    out = []
    for key, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        if reshape and w and (how := reshape(key, len(w))):
            w = [w[i if i < how[0] else how[0] + (i - how[0]) % how[1]] for i in range(len(w))]
        runs = brute(w)
        gone = {i for a, b, q in runs for i in range(a + q, b + 1)}
        best = max(runs, key=lambda x: (Fraction(x[1] - x[0] + 1, x[2]), -x[0], -x[2]), default=None)
        own = (best[0], best[1] - best[0] + 1, best[2], 1000 * (best[1] - best[0] + 1) // best[2]) if best else (None,) * 4
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((key, len(runs), *own, sha("".join(f"{a},{b - a + 1},{q}\n" for a, b, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r[c] for c in ["doc_id", *m.OWN]) for r in df.collect()), key=str)


def test_contract_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{D}/documents.parquet").collect()]
    want = expected(rows, m.planted)
    assert sum(r[1] for r in want) > 20
    assert result(m.op13_periodic_runs(spark, D)) == want


def test_edges_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(m, "GROUP_BYTES", 300)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, "é " * 6), (6, "a b " * 4 + "a"), (None, "x y z " * 5), (None, "x y z " * 5), (7, "A a " * 9), (8, "w" * 5000 + " b" * 7)]
    df = spark.createDataFrame([(k, t, "other", 5) for k, t in rows], "doc_id long, text string, start string, kept int")
    got = m.with_runs(df)
    assert got.columns == ["doc_id", "kept", *m.OWN] and got.where("kept <> 5").count() == 0
    assert result(got) == expected(rows, None)
    assert m.with_runs(df.where("false")).count() == 0


def test_a_text_without_an_id_is_not_reshaped():
    assert m.planted(None, 50) is None
    key = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 10 == 0)
    assert m.planted(key, 50) is not None


def test_long_repetitive_texts_stay_linear(spark):
    import time

    texts = ["a " * 300_000, "a b " * 150_000, " ".join(str(i % 30_011) for i in range(300_000))]
    began = time.time()
    got = m.with_runs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r["n_runs"], r["start"], r["length"], r["period"]) for r in got] == [(1, 0, 300_000, 1), (1, 0, 300_000, 2), (1, 0, 300_000, 30_011)]
    assert time.time() - began < 60
