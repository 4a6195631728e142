import hashlib
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tracewright.llm import suffix_dedup as s


def brute(texts, length):
    """(removed, runs, kept) of each text by a table of all windows."""
    count, out = {}, []
    for t in texts:
        for i in range(len(t) - length + 1):
            count[t[i : i + length]] = count.get(t[i : i + length], 0) + 1
    for t in texts:
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = True
        runs = int(((~gone[:-1]) & gone[1:]).sum())
        out.append((int(gone.sum()), runs, bytes(b for b, g in zip(t, gone[1:-1]) if not g)))
    return out


def check(spark, rows, length, gram, hot=s.HOT):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    cut = s.removals(docs, length, gram, hot)
    found = {(r["k1"], r["k2"]): r for r in cut.collect()}
    keyed = docs.select("doc_id", "text", *(c.alias(k) for k, c in s.key_halves().items())).collect()
    texts = [(r["text"] or "").encode() for r in keyed]
    for r, t, (n, runs, kept) in zip(keyed, texts, brute(texts, length)):
        got = found.get((r["k1"], r["k2"]))
        assert (got is None) == (n == 0), (r["doc_id"], n)
        if got:
            assert (sum(x["b"] - x["a"] for x in got["removed"]), len(got["removed"]), bytes(got["kept"])) == (n, runs, kept)


def random_rows(seed):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice("abcé ") for _ in range(k))
    shared = [word(rng.randint(10, 120)) for _ in range(8)]
    rows = [(i, "".join(rng.choice([word(rng.randint(1, 40)), rng.choice(shared)]) for _ in range(rng.randint(0, 8)))) for i in range(60)]
    return rows + [(100, "a" * 300), (101, "ab" * 200), (102, "xy" + "ab" * 60), (103, None), (104, ""), (105, rows[0][1]), (105, rows[0][1]), (None, rows[1][1] + "!"), (106, "z" * 29), (107, "z" * 30), (108, "q" * 31)]


@pytest.mark.parametrize("seed,gram,hot", [(1, 10, s.HOT), (2, 30, s.HOT), (3, 4, 2)])
def test_against_brute_force(spark, seed, gram, hot):
    check(spark, random_rows(seed), 30, gram, hot)


def test_long_texts_are_cut_into_segments(spark, monkeypatch):
    monkeypatch.setattr(s, "SEGMENT", 200)
    texts = [t.encode() for _, t in random_rows(4) if t]
    for t in texts:
        starts = sorted(x for _, rows, _ in s.pieces_of([t], 30, 10) for off, n, *_ in rows.T.tolist() for x in range(off, off + n))
        assert starts == list(range(len(t) - 29))


def test_columns_find_equal_windows():
    rng = np.random.default_rng(2)
    pieces = [b"L" * int(rng.integers(0, 5)) + b"anchor" + bytes(rng.integers(97, 99, 6, dtype=np.uint8)) for _ in range(200)]
    pieces = sorted({p[-12 - k :] for p in pieces for k in (0, 2)})
    rel = np.array([p.index(b"anchor") for p in pieces])
    flags = s.repeated_columns(pieces, rel, 9)
    where = {}
    for i, p in enumerate(pieces):
        for a in range(len(p) - 8):
            where.setdefault((a - rel[i], p[a : a + 9]), []).append((i, a))
    assert {(i, a) for v in where.values() if len(v) > 1 for i, a in v} == set(zip(*(x.tolist() for x in np.nonzero(flags))))


def test_clashing_columns_and_many_copies(spark):
    text = "".join(chr(97 + i * i % 23) for i in range(700))
    rows = [(i, text, i, "x") for i in range(600)] + [(1000, text[:450] + "é" * 300, 1, "y"), (1001, None, 2, "z"), (1002, "short", 3, "s"), (1003, "short", 3, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k1 long, anchors string")
    got = {r["doc_id"]: r for r in s.dedup(docs).collect()}
    texts = [(r[1] or "").encode() for r in rows]
    for (i, *_), t, (n, runs, kept) in zip(rows, texts, brute(texts, 400)):
        assert (sum(x["b"] - x["a"] for x in got[i]["removed"]), len(got[i]["removed"]), bytes(got[i]["kept"]), got[i]["n_bytes"]) == (n, runs, kept, len(t))


def test_no_rows(spark):
    assert s.removals(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_given_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()]
    got = {r["doc_id"]: tuple(r)[1:] for r in s.op8_suffix_dedup(spark, "/root/testdata/sf0.001").collect()}
    texts = [(t or "").encode() for _, t in rows]
    want = {i: (len(t), n, runs, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")) for (i, _), t, (n, runs, kept) in zip(rows, texts, brute(texts, 400))}
    assert got == want and any(x[1] for x in want.values())
