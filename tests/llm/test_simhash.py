import re

import numpy as np
import pytest
import xxhash

from tracewright.llm import simhash as s
from tracewright.llm.common import connected_components

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def print_of(t):
    w = SPACE.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def label(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_extra_columns_and_a_long_text(spark):
    long = " ".join(f"w{i}" for i in range(100_000))
    docs = spark.createDataFrame([(1, long, 5, "x"), (2, long + " end", 6, "y"), (3, "other words", 7, None)], "doc_id long, text string, fp int, node string")
    assert [tuple(r)[::2] for r in sorted(s.components(docs).collect())] == [(1, 1), (2, 1), (3, 3)]
    assert sorted(s.keep_one(docs).collect()) == [(1, long, 5, "x"), (3, "other words", 7, None)]


def brute(rows):
    fps = [print_of(t) for _, t in rows]
    edges = [(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4]
    c = label({i for i, _ in rows}, edges)
    return sorted((i, f"{f:016x}", c[i]) for (i, _), f in zip(rows, fps))


def test_components_against_brute_force(spark):
    base = [" ".join(f"t{(i * 7 + j * j) % 97}" for j in range(300)) for i in range(30)]
    near = [b.replace("t5 ", "zz ", 1) for b in base] + [b + " tail" for b in base[:9]] + [base[3].upper()]
    texts = base + near + ["", None, " \n ", "a", "A", "a b c", "a b c d", "é É", "x y"]
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, s.components(docs).collect())) == brute(rows)
    assert s.components(docs.where("false")).count() == 0
    kept = {r["doc_id"] for r in s.keep_one(docs.union(docs)).collect()}
    assert kept == {c for _, _, c in brute(rows)}


@pytest.mark.parametrize("hot_key", [3, 200_000])
def test_every_close_pair_is_connected(spark, hot_key):
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 2**63, 40)
    fps = {int(c) ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 6), replace=False)) for c in centre for _ in range(12)}
    fps |= {1 << i for i in range(60)} | {(1 << i) | (1 << (i + 1)) for i in range(60)}
    want = label(fps, [(a, b) for a in fps for b in fps if a < b and bin(a ^ b).count("1") <= 4])
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = dict(map(tuple, connected_components(s.close_pairs(df, len(fps), 4, hot_key)).collect()))
    assert all(got.get(x, x) == want[x] for x in fps)


def test_components_of_a_path(spark):
    ids = np.random.default_rng(3).permutation(200).tolist()
    edges = spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long")
    assert {r["root"] for r in connected_components(edges).collect()} == {0}
