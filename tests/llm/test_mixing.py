import re
from collections import defaultdict

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tracewright.llm import mixing as m

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(size):
    """Water filling by repetition."""
    order = sorted((s for s in size if s is not None)) + [None] * (None in size)
    w = {s: m.WEIGHTS[i % 3] for i, s in enumerate(order)}
    full, out = {}, {}
    while True:
        free = [s for s in order if s not in full]
        rest = sum(size.values()) - sum(full.values())
        out = full | {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if out[s] >= 3 * size[s]]
        if not over:
            return out
        full |= {s: 3.0 * size[s] for s in over}


def check(spark, rows, **how):
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, size string")
    mixed, slots, _ = m.mix(docs, **how)
    got, size = mixed.collect(), defaultdict(int)
    for _, s, t, _ in rows:
        size[s] += len(SPACE.findall(t or ""))
    want, taken = brute_targets(size) if sum(size.values()) else dict.fromkeys(size, 0.0), defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        assert r["source_size"] == size[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in size)
    spread = sorted((r["source"] or "", r["taken"] // max(1, r["size"])) for r in got if r["size"])
    assert sorted(map(str, m.mix(docs, **how)[0].collect())) == sorted(map(str, got))
    return slots.orderBy("slot").collect(), want, spread


def test_given_documents(spark):
    rows = [(r["doc_id"], r["source"], r["text"], None) for r in pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()]
    slots, want, _ = check(spark, rows, block=256)
    # any prefix of the schedule is close to the targets while no source has ended
    seen, number, total = defaultdict(int), {s: i for i, s in enumerate(sorted(want))}, sum(want.values())
    for k, r in enumerate(slots[: len(slots) // 2], 1):
        seen[r["source_no"]] += 1
        if k % 50 == 0:
            assert all(abs(seen[number[s]] - k * want[s] / total) < 8 for s in want)


def test_slots_hold_the_words_that_are_taken(spark):
    rows = [(i, "abc"[i % 3] if i % 5 else None, " ".join(["w"] * (i * 37 % 211)), None) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, size string")
    mixed, slots, targets = m.mix(docs, block=50)
    got = m.slot_words(mixed, slots, targets, block=50).collect()
    per_doc, per_slot, seen = defaultdict(int), defaultdict(int), set()
    for r in got:
        per_doc[r["doc_id"]] += r["last"] - r["first"]
        per_slot[r["slot"]] += r["last"] - r["first"]
        words = {(r["doc_id"], r["epoch"], x) for x in range(r["first"], r["last"])}
        assert not words & seen  # a word is taken once an epoch
        seen |= words
    assert {r["doc_id"]: r["taken"] for r in mixed.collect() if r["taken"]} == dict(per_doc)
    assert {r["slot"]: r["end"] - r["begin"] for r in slots.collect()} == dict(per_slot)


def test_edges(spark):
    words = lambda n: " ".join(["w"] * n)
    rows = [(1, "b", words(5000), "x"), (2, "a", words(3), "x"), (2, "a", words(3), "x"), (None, None, words(700), None), (4, None, None, None), (5, "c", "", None), (6, "é", " \n ", None), (7, "d", words(1), None)]
    check(spark, rows, block=64)
    check(spark, [(1, "a", None, None)])
    check(spark, [])
    many = [(i, "hot" if i % 3 else f"s{i % 7}", words(i % 90), None) for i in range(1500)]
    check(spark, many, block=100)


def test_repeats_are_whole_rows(spark):
    rows = [(i, "ab"[i % 2], " ".join(["w"] * (10 + 40 * (i % 2))), "x") for i in range(60)] + [(3, "b", "again", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, extra string")
    out = m.repeat_documents(docs, block=16)
    assert out.columns == docs.columns and out.exceptAll(docs.crossJoin(spark.range(3)).select(docs.columns)).count() == 0
    per = out.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()
    assert {r["source"] for r in per} == {"a", "b"}
