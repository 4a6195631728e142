import hashlib
import re

import pyarrow.parquet as pq
import pytest

from tracewright.llm import decontamination as d

W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return W.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(documents, items):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[a : a + n]), set()).add(str(i))
    lengths = {len(x) for x in windows}
    out = []
    for i, t in documents:
        w, hit, found = words(t), set(), set()
        for n in lengths:
            for a in range(len(w) - n + 1):
                if (x := tuple(w[a : a + n])) in windows:
                    hit.update(range(a, a + n))
                    found |= windows[x]
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def check(spark, documents, items):
    docs = spark.createDataFrame(documents, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = d.judge(docs, bench).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert sorted(map(tuple, got.collect()), key=str) == brute(documents, items)


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(40))
    documents = [(1, long), (2, None), (3, ""), (4, "... --- !!!"), (5, long.upper().replace(" ", ",, ")), (5, long), (None, "Élan vital über w1 w2"), (7, "élan VITAL"), (8, "a " * 500 + long), (9, "w3 w4"), (10, "a a a a a a a a a a a a a a"), (11, "Élan vital Élan vital")]
    items = [(1, long), (10, " ".join(f"w{i}" for i in range(5, 19))), (2, "w3 w4"), (3, None), (4, ""), (5, "Élan vital"), (6, "a " * 13), (6, "w0"), (7, "ÉLAN VITAL")]
    check(spark, documents, items)
    check(spark, documents, [])
    check(spark, [], items)
    check(spark, documents, [(1, long)])


def test_shuffle_join_equals_broadcast(spark):
    documents = [(i, " ".join(f"x{(i * j) % 50}" for j in range(60))) for i in range(20)]
    docs = spark.createDataFrame(documents, "doc_id long, text string")
    items = docs.selectExpr("doc_id as item_id", "substr(text, 1, 90) as text")
    a = d.contamination(docs, items).collect()
    b = d.contamination(docs, items, broadcast_bytes=0).collect()
    assert sorted(map(str, a)) == sorted(map(str, b)) and a


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_given_tables(spark, sf):
    read = lambda t, *c: [tuple(r.values()) for r in pq.read_table(f"/root/testdata/{sf}/{t}.parquet", columns=list(c)).to_pylist()]
    check(spark, read("documents", "doc_id", "text"), read("benchmark", "item_id", "text"))


def test_clashing_columns_are_kept(spark):
    docs = spark.createDataFrame([(1, "a b", 5, "x")], "doc_id long, text string, n_hit int, key string")
    row = d.judge(docs, spark.createDataFrame([(1, "a b")], "item_id long, text string")).first()
    assert row["key"] == "x" and row["n_hit"] == 2
