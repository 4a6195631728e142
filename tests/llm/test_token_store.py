import hashlib
import itertools
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from tracewright.llm import token_store as t

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, " ", "The the THE.", "don't stop'll ''s", "a.b,c..d", "x<|endoftext|>y", "A<|ENDOFTEXT|>.", "ΑΣ Σ. İI", "é. ñ, ≮.", "1,234.5 a1.b2", "漢字。かな 🙂🙂.", "a b　c\x0bd\x1ce", "THIS!! is&&& it.***", "word " * 9000, "Ünïcödé."]


def test_words_equal_the_library():
    tokenizer, enc = Tokenizer.from_file(PATH), t.WordEncoder(PATH)
    texts = [x or "" for x in ODD] + pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()
    for x, ids in zip(texts, enc.encode(texts)):
        assert ids.tolist() == tokenizer.encode(x, add_special_tokens=False).ids, repr(x[:80])


def test_cuts_and_crc():
    ids = np.random.default_rng(1).integers(0, 40_000, 100_000).astype(np.uint32)
    cuts = t.cut_points(ids)
    assert cuts[-1] == len(ids) and all(t.LEAST <= b - a <= t.MOST for a, b in itertools.pairwise([0, *cuts][:-1]))
    moved = t.cut_points(np.concatenate([ids[:777], ids]))
    assert len({c - 777 for c in moved} & set(cuts)) > 0.8 * len(cuts)
    data = ids.astype("<u4").tobytes()
    crc = np.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip([0, *cuts], cuts)])
    after = np.array([len(data) - 4 * b for b in cuts])
    assert np.bitwise_xor.reduce(t.shift_crc(crc, after)) == zlib.crc32(data)


def test_round_trip(spark):
    tokenizer = Tokenizer.from_file(PATH)
    rows = [(100 - i, x, "w") for i, x in enumerate(ODD)] + [(100, "twice", "w"), (None, "no id", "w")]
    rows += [(200 + r["doc_id"], r["text"], None) for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(5)
    path = t.write_store(docs, PATH)
    got = sorted(map(tuple, t.read_documents(spark, path).collect()), key=lambda r: r[1])
    ids = {}
    for i, x, _ in rows:
        ids.setdefault(i, []).append(tokenizer.encode(x or "", add_special_tokens=False).ids + [1])
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    assert [r[1] for r in got] == [0, *itertools.accumulate(r[2] for r in got)][:-1]
    assert all(r[3] in ids[r[0]] and len(r[3]) == r[2] for r in got) and sorted(map(len, (r[3] for r in got))) == sorted(len(y) for x in ids.values() for y in x)
    short = {r["start"]: (r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in t.read_summaries(spark, path).collect()}
    assert short == {r[1]: (r[0], r[2], zlib.crc32(np.array(r[3], "<u4").tobytes())) for r in got}
    chunks = t.read_kind(spark, path, "chunk")
    assert chunks.count() == chunks.select("digest").distinct().count()
    empty = t.write_store(docs.where("false"), PATH)
    assert t.read_summaries(spark, empty).count() == 0


def test_clashing_columns_and_a_very_long_text(spark):
    tokenizer = Tokenizer.from_file(PATH)
    long = " ".join(f"w{i % 5003}, é{i}" for i in range(150_000))
    rows = [(2, long, "x", b"r", [1]), (1, "a b", "chunk", None, None), (1, "a b", "doc", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string, root binary, digests array<int>")
    got = sorted(map(tuple, t.read_summaries(spark, t.write_store(docs, PATH)).collect()), key=lambda r: r[1])
    start = 0
    for (i, begin, n, crc), text in zip(got, ("a b", "a b", long)):
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [1]
        assert (begin, n, crc) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += n
    assert [r[0] for r in got] == [1, 1, 2]


def test_shard_roots_over_many_levels(spark, monkeypatch):
    monkeypatch.setattr(t, "FAN", 4)
    leaves = [hashlib.blake2b(bytes([i]), digest_size=32).digest() for i in range(37)]
    df = spark.createDataFrame([(0, i, x) for i, x in enumerate(leaves)] + [(1, 0, leaves[0])], "shard int, place long, root binary")
    level = leaves
    while True:
        level = [t.merkle_root(level[a : a + 4]) for a in range(0, len(level), 4)]
        if len(level) == 1:
            break
    one = t.merkle_root([t.merkle_root([t.merkle_root([leaves[0]])])])
    assert {r["shard"]: bytes(r["root"]) for r in t.shard_roots(df).collect()} == {0: level[0], 1: one}


def test_a_changed_chunk_is_found(spark):
    docs = spark.createDataFrame([(1, "some text here")], "doc_id long, text string")
    path = t.write_store(docs, PATH)
    blocks = spark.read.parquet(f"{path}/blocks")
    wrong = [r.asDict() | {"digest": b"\0" * 32} for r in t.read_kind(spark, path, "chunk").collect()]
    spark.createDataFrame([tuple(r[c] for c in blocks.columns) for r in wrong], blocks.schema).write.mode("append").parquet(f"{path}/blocks")
    with pytest.raises(Exception, match="does not match its name"):
        t.verified_chunks(spark, path).collect()
