"""The pipeline's stages against brute force, and their edges."""

import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as p
from tests.llm.test_decontamination import brute as contaminated
from tests.llm.test_mixing import SPACE, brute_targets
from tests.llm.test_wide_simhash import exact_components
from tracewright.llm import quality_rules

D = "/root/testdata/sf0.001"


def ids(df):
    return Counter(r["doc_id"] for r in df.collect())


@pytest.fixture(scope="module")
def documents():
    return {r["doc_id"]: r for r in pq.read_table(f"{D}/documents.parquet").to_pylist()}


def test_every_stage(spark, documents):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    docs = spark.read.parquet(f"{D}/documents.parquet")
    kept = p.materialize(p.quality(spark, docs, D), "a")
    want = {r[0] for r in con.sql(f"select doc_id from ({quality_rules.ORACLE_SQL['op7_quality_rules']}) where kept").fetchall()}
    assert ids(kept) == Counter(want) and len(want) < len(documents)

    single = p.materialize(p.near_duplicates(spark, kept, D), "b")
    want = set(exact_components([(i, documents[i]["text"]) for i in want]).values())
    assert ids(single) == Counter(want)

    clean = p.materialize(p.decontaminate(spark, single, D), "c")
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{D}/benchmark.parquet").to_pylist()]
    want = {r[0] for r in contaminated([(i, documents[i]["text"]) for i in want], items) if not r[5]}
    assert ids(clean) == Counter(want)

    mixed = p.materialize(p.mix(spark, clean, D), "d")
    size, taken, times = {i: len(SPACE.findall(documents[i]["text"])) for i in want}, defaultdict(int), ids(mixed)
    totals = defaultdict(int)
    for i in want:
        totals[documents[i]["source"]] += size[i]
    for i, n in times.items():
        assert n <= 3 and i in want
        taken[documents[i]["source"]] += n * size[i]
    # a source's blocks are one line of words: of whole documents only the last of the line is more than the target
    for s, target in brute_targets(totals).items():
        longest = max(size[i] for i in want if documents[i]["source"] == s)
        assert target - 0.5 <= taken[s] <= min(3 * totals[s], target + longest)
    assert {tuple(r) for r in mixed.collect()} <= {tuple(documents[i][c] for c in p.COLUMNS) for i in want}

    tok, start, out = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for i in sorted(times.elements()):
        e = tok.encode(documents[i]["text"], add_special_tokens=False).ids + [1]
        out.append((i, start, len(e), zlib.crc32(np.array(e, "<u4").tobytes())))
        start += len(e)
    assert sorted(map(tuple, p.tokens(spark, mixed, D).collect())) == out
    assert sorted(map(tuple, p.run(spark, D).collect())) == out


def test_edges(spark):
    kinds = "doc_id long, text string, lang string, source string, n_chars long, __key string, n_hit int, size int"
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(1, None, None, None, None, "x", 1, 1), (2, "", "en", "a", 0, None, None, None), (3, long, None, "a", 1, None, None, None), (3, long, None, "a", 1, None, None, None), (None, "a b c " * 30, "en", None, None, "x", 1, 2), (4, "good words " + " ".join(f"v{i}" for i in range(80)), "en", "b", 5, "", 0, 0)]
    docs = spark.createDataFrame(rows, kinds)
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, docs, D)
        assert out.columns == p.COLUMNS and out.count() > 0
        assert stage(spark, docs.where("false"), D).count() == 0
    assert p.tokens(spark, docs, D).count() == len(rows)
    assert p.tokens(spark, docs.where("false"), D).count() == 0
    assert p.near_duplicates(spark, docs, D).where("doc_id = 3").count() == 1
    kept = ids(p.quality(spark, docs, D))
    assert kept[4] == 1 and not kept[1] and not kept[2] and not kept[None]
