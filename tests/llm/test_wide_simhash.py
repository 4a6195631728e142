"""Near duplicates by wide fingerprints against exact similarities of all pairs."""

from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from tests.llm.test_simhash import SPACE, label
from tracewright.llm import wide_simhash as w


def shingles(text):
    words = SPACE.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1))) if words else frozenset()


def exact_components(rows, similarity=0.8):
    """Component of each doc_id by the Jaccard similarity of every pair that shares a shingle; equal sets belong together."""
    sets = {i: shingles(t) for i, t in rows}
    first, holders, edges = {}, defaultdict(list), []
    for i in sorted(sets):
        if sets[i] in first:
            edges.append((first[sets[i]], i))
        else:
            first[sets[i]] = i
            for x in sets[i]:
                holders[x].append(i)
    for i in first.values():
        common = defaultdict(int)
        for x in sets[i]:
            for j in holders[x]:
                common[j] += j < i
        edges += [(j, i) for j, c in common.items() if j < i and c >= similarity * (len(sets[i]) + len(sets[j]) - c) - 1e-9]
    return label(sets, edges)


def got(spark, rows, **kw):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: r["component_id"] for r in w.near_components(docs, **kw).collect()}


def test_supplied_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    have = {r["doc_id"]: r["component_id"] for r in w.near_components(docs).collect()}
    want = exact_components(rows)
    gone, asked = {i for i in have if have[i] != i}, {i for i in want if want[i] != i}
    assert len(asked) > 50 and len(asked - gone) <= 0.02 * len(asked) and len(gone - asked) <= 0.02 * len(asked)


def edited(rng, words, changes):
    out = list(words)
    for at in rng.choice(len(words) // 6, changes, replace=False):
        out[at * 6 + 2] = f"x{rng.integers(1 << 40)}"
    return " ".join(out)


@pytest.mark.parametrize("hot_key", [5, 20_000])
def test_planted_pairs(spark, hot_key):
    """600 words: 13 changed words leave 0.80 of the shingles' union, 18 leave 0.74; a family of 150 near copies is one component."""
    rng, rows, near, far = np.random.default_rng(8), [], [], []
    for i in range(120):
        base = [f"b{i}_{j}" for j in range(600)]
        changes = int(rng.integers(1, 14)) if i < 80 else int(rng.integers(18, 30))
        rows += [(2 * i, " ".join(base)), (2 * i + 1, edited(rng, base, changes))]
        (near if i < 80 else far).append((2 * i, 2 * i + 1))
    family = [f"f{j}" for j in range(600)]
    rows += [(1000 + i, edited(rng, family, 4)) for i in range(150)]
    c = got(spark, rows, hot_key=hot_key)
    assert sum(c[a] == c[b] for a, b in near) >= 0.95 * len(near)
    assert all(c[a] != c[b] for a, b in far)
    assert {c[1000 + i] for i in range(150)} == {1000}
    want = exact_components(rows)
    assert sum(c[i] != want[i] for i in c) <= 4


def test_pairs_about_the_limit_are_decided_by_their_sets(spark):
    rng, rows = np.random.default_rng(3), []
    for i in range(60):
        base = [f"c{i}_{j}" for j in range(600)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, edited(rng, base, 13 if i % 2 else 15))]
    c, want = got(spark, rows), exact_components(rows)
    assert all(want[2 * i + 1] == (2 * i if i % 2 else 2 * i + 1) for i in range(60))
    assert all(c[2 * i + 1] == 2 * i + 1 for i in range(0, 60, 2)), "less similar pairs stay apart"
    assert sum(c[2 * i + 1] == 2 * i for i in range(1, 60, 2)) >= 27


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(100_000))
    kinds = "doc_id long, text string, fp int, node string, root string, first long, hashes string"
    rest = (1, "n", "r", 2, "h")
    rows = [(1, long, *rest), (2, long.upper() + " end", *rest), (3, "other words", *rest), (4, None, *rest), (5, "", *rest), (6, " \n", *rest), (7, "Other\tWORDS", *rest), (7, "Other\tWORDS", *rest), (None, "a b c", *rest), (None, None, *rest), (8, "one", None, None, None, None, None)]
    docs = spark.createDataFrame(rows, kinds)
    assert {r["doc_id"]: r["component_id"] for r in w.near_components(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 4, 7: 3, 8: 8}
    kept = w.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, docs.where("doc_id in (1, 3, 4, 8) or doc_id is null").collect()))
    assert w.keep_one(docs.where("false")).count() == 0 and w.near_components(docs.where("doc_id is null")).count() == 0


def test_forests_and_short_runs_connect_the_same():
    rng = np.random.default_rng(4)
    centre = rng.integers(0, 1 << 63, (6, 2)).astype(np.uint64)
    sketch = np.concatenate([centre ^ (np.uint64(1) << rng.integers(0, 63, (6, 2)).astype(np.uint64)) for _ in range(9)])
    group = np.zeros(len(sketch), np.int64)
    want = label(range(len(sketch)), [(i, j) for i in range(len(sketch)) for j in range(i) if int(w._distance(sketch[i], sketch[j])) <= 8])
    for long_run in (100, 5):
        a, b = w.pairs_of_runs(group, sketch, (4, 8), long_run)
        assert label(range(len(sketch)), list(zip(a.tolist(), b.tolist()))) == want


def test_blocks_follow_the_number_of_fingerprints():
    for n in (0, 1, 1000, 10**6, 10**9):
        p = w.block_positions(n, 0.8)
        miss = (1 - (1 - w.bit_rate(0.8)) ** p.shape[1]) ** p.shape[0]
        assert miss <= 0.03 and all(len(set(x)) == p.shape[1] for x in p.tolist())


def verified_links(texts):
    """Every pair that shares a block and is close by 128 bits and by all bits, and surely similar or similar by its shingles."""
    sets = [np.unique(np.array(w.shingle_hashes(t.encode(), 5), np.uint64)) for t in texts]
    fps = np.stack([np.frombuffer(w.wide_fingerprint(x), "<u8") for x in sets])
    bits = np.unpackbits(fps.view(np.uint8), axis=1, bitorder="little")
    meet = np.zeros((len(sets), len(sets)), bool)
    for at in w.block_positions(len(sets), 0.8):
        key = np.unique(bits[:, at], axis=0, return_inverse=True)[1].ravel()
        meet |= key[:, None] == key
    out = []
    for x, y in np.argwhere(np.triu(meet, 1)):
        d = int(w._distance(fps[x], fps[y]))
        if int(w._distance(fps[x, :2], fps[y, :2])) > w.limit_of(0.8, 128, 3) or d > w.limit_of(0.8, w.WIDTH, 2.5):
            continue
        common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
        if d <= w.limit_of(0.8, w.WIDTH, -2.5) or common >= 0.8 * (len(sets[x]) + len(sets[y]) - common) - 1e-9:
            out.append((int(x), int(y)))
    return out


@pytest.mark.parametrize("hot_key", [50, 20_000])
def test_no_link_is_lost_among_many_near_texts(spark, hot_key):
    """500 texts of one template, mutually too different, of which 100 have a partner at about the limit, all under long keys."""
    rng, texts = np.random.default_rng(6), []
    template = [f"t{j}" for j in range(600)]
    for i in range(500):
        texts.append(edited(rng, template, 14))
        if i < 100:
            texts.append(edited(rng, texts[-1].split(), 11))
    links = verified_links(texts)
    assert len(links) > 80
    c = got(spark, list(enumerate(texts)), hot_key=hot_key)
    lost = [x for x in links if c[x[0]] != c[x[1]]]
    assert not lost
    want = label(range(len(texts)), links)
    assert sum(c[i] != want[i] for i in c) <= 4, "a group may hold pairs that share no block"


def test_rows_of_a_group_grow_with_its_size(spark):
    """Groups of near copies leave a row a member, not a row a pair, under short and long keys."""
    for size in (20, 40, 80):
        texts = [edited(np.random.default_rng(i), [f"f{j}" for j in range(600)], 2) for i in range(size)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        nodes = w.with_wide_fingerprint(docs).selectExpr("xxhash64(fp) as node", "fp", "doc_id as first").cache()
        found = w.close_groups(nodes, size, 0.8)
        keys = len(w.block_positions(size, 0.8))
        assert found.count() <= size * keys
        members = found.distinct().join(nodes.select("node", "fp"), "node").cache()
        assert w.sure_links(members, 2, w.limit_of(0.8, w.WIDTH, -2.5)).count() <= members.count()


def test_links_of_sets_connect_what_similar_sets_connect():
    rng = np.random.default_rng(2)
    for _ in range(30):
        base = rng.integers(0, 1 << 63, (3, 40)).astype(np.uint64)
        sets = [np.unique(np.concatenate([rng.permutation(base[i % 3])[: rng.integers(33, 41)], rng.integers(0, 99, 2).astype(np.uint64)])) for i in range(20)]
        sets += [np.zeros(0, np.uint64), np.unique(base[0])]
        root = rng.integers(0, 15, len(sets))
        same = [(i, j) for i in range(len(sets)) for j in range(i) if root[i] == root[j]]
        near = [(i, j) for i in range(len(sets)) for j in range(i) if (c := len(np.intersect1d(sets[i], sets[j]))) and c >= 0.8 * (len(sets[i]) + len(sets[j]) - c) - 1e-9]
        links = w.links_of_sets(root, sets, 0.8)
        assert all((max(x), min(x)) in near for x in links) and len(links) < len(set(root.tolist()))
        assert label(range(len(sets)), same + links) == label(range(len(sets)), same + near)


def test_long_sets_are_dealt_in_pairs_of_chunks(spark):
    rng = np.random.default_rng(5)
    base = [f"g{j}" for j in range(600)]
    texts = [edited(rng, base, 6) for _ in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes = w.with_wide_fingerprint(docs).selectExpr("xxhash64(fp) as node", "fp", "doc_id as first").cache()
    unsure = nodes.selectExpr("1L as cluster", "node", "node as root").cache()
    first = {r["node"]: r["first"] for r in nodes.collect()}
    want = {i: exact_components(list(enumerate(texts)))[i] for i in range(12)}
    for chunk in (1500, w.SET_CHUNK):
        links = w.similar_links(docs, nodes, unsure, 5, 0.8, chunk).collect()
        assert label(range(12), [(first[r["a"]], first[r["b"]]) for r in links]) == want
