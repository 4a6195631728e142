"""Nearest neighbours by broadcast and by pivots against all distances; how many blocks meet."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewright.operators import neighbours as nb

KIND = "id long, grp string, owner long, vector array<double>"


def brute(queries, candidates, k):
    out = []
    for i, g, o, v in queries:
        near = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), j) for j, h, p, w in candidates if h == g and p != o and g is not None)
        out += [(i, round(d, 9), j) for d, j in near[:k]]
    return sorted(out)


def found(spark, queries, candidates, k, few):
    q = spark.createDataFrame(queries, KIND)
    c = q if queries is candidates else spark.createDataFrame(candidates, KIND)
    return sorted((r["id"], round(r["dist"], 9), r["other"]) for r in nb.nearest(q, c, k, few).collect())


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    centre = rng.normal(0, 20, (6, 5))
    return [(i, [None, "a", "b", "b"][i % 4], i // 3, (centre[i % 6] + rng.normal(0, 1, 5)).round(1).tolist()) for i in range(240)]


@pytest.mark.parametrize("few", [0, 1 << 20])
@pytest.mark.parametrize("k", [1, 4])
def test_equals_all_distances(spark, rows, few, k, monkeypatch):
    monkeypatch.setattr(nb, "BLOCK", 16)
    monkeypatch.setattr(nb, "PIVOTS", 5)
    assert found(spark, rows, rows, k, few) == brute(rows, rows, k)
    asked = [(1000 + i, g, o, v) for i, (_, g, o, v) in enumerate(rows[::7])]
    assert found(spark, asked, rows, k, few) == brute(asked, rows, k)


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_fewer_than_k_ties_and_empty(spark, few):
    same = [(i, "g", i, [1.0, 2.0]) for i in range(7)]
    assert found(spark, same, same, 2, few) == brute(same, same, 2)
    two = [(1, "g", 1, [0.0]), (2, "g", 2, [3.0]), (3, "h", 3, [0.0]), (4, "g", 1, [1.0])]
    assert found(spark, two, two, 3, few) == brute(two, two, 3)
    none = spark.createDataFrame([], KIND)
    assert nb.nearest(none, none, 2, few).count() == 0


def test_under_half_of_the_blocks_meet_on_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(nb, "BLOCK", 50)
    rng = np.random.default_rng(5)
    centre = rng.normal(0, 10, (12, 16))
    v = np.concatenate([c + rng.normal(0, 1, (100, 16)) for c in centre])
    df = spark.createDataFrame([(i, "g", i, x.tolist()) for i, x in enumerate(v)], KIND)
    blocks = nb._pack(df, v[rng.permutation(len(v))[:32]], 5)
    n, met = blocks.count(), nb.meetings(blocks, blocks, 5, True).count()
    assert n >= 24 and met < 0.5 * n * n
    got = {(r["id"], r["other"]) for r in nb.nearest(df, df, 5, 0).collect()}
    d = np.linalg.norm(v[:, None] - v[None], axis=2)
    np.fill_diagonal(d, np.inf)
    assert got == {(i, int(j)) for i in range(len(v)) for j in np.argsort(d[i])[:5]}


def test_one_group_holds_most_vectors(spark, monkeypatch):
    monkeypatch.setattr(nb, "BLOCK", 8)
    rng = np.random.default_rng(1)
    rows = [(i, "hot" if i % 5 else f"g{i}", i, rng.normal(size=3).tolist()) for i in range(150)]
    assert found(spark, rows, rows, 2, 0) == brute(rows, rows, 2)
    assert spark.createDataFrame(rows, KIND).where(F.col("grp") == "hot").count() == 120


def test_candidates_are_sent_once_a_tile(spark, monkeypatch):
    """All blocks meet: each is sent once a tile, not once for each block of queries."""
    monkeypatch.setattr(nb, "BLOCK", 8)
    monkeypatch.setattr(nb, "TILES", 2)
    rng, sent, pieces = np.random.default_rng(7), [], nb.solve_tiles
    rows = [(i, "g", i, rng.normal(size=6).round(1).tolist()) for i in range(200)]

    def watched(pairs, tiles, mine, others, k, kinds):
        sent.append((pairs.join(tiles, "a").select("tile", "b").distinct().count(), pairs.count(), mine.count()))
        return pieces(pairs, tiles, mine, others, k, kinds)

    monkeypatch.setattr(nb, "solve_tiles", watched)
    assert found(spark, rows, rows, 3, 0) == brute(rows, rows, 3)
    moved, met, blocks = sent[0]
    assert blocks >= 20 and moved <= 2 * blocks < met / 3


def test_a_tile_is_a_task(spark, monkeypatch):
    monkeypatch.setattr(nb, "BLOCK", 4)
    rng = np.random.default_rng(8)
    rows = [(i, "g", i, rng.normal(size=6).round(1).tolist()) for i in range(200)]
    q = spark.createDataFrame(rows, KIND)
    assert nb.nearest(q, q, 3, 0).select(F.spark_partition_id()).distinct().count() == nb.TILES


def of(rows, owners=None):
    return pa.table({"id": [f"v{i:04d}" for i in range(len(rows))], "owner": owners or [f"v{i:04d}" for i in range(len(rows))], "vector": pa.array([list(map(float, v)) for v in rows], pa.list_(pa.float64()))})


def test_of_equal_vectors_those_pass_that_may_be_near():
    assert nb.first_of_equal(of([[1, 2]] * 300 + [[3, 4]] * 2), 5).column("id").to_pylist() == [f"v{i:04d}" for i in (*range(6), 300, 301)]
    two = nb.first_of_equal(of([[1, 2]] * 8, ["a", "a", "a", "b", "b", "c", "c", "c"]), 2)  # a query of a's has b's two
    assert two.num_rows == 5


@pytest.mark.parametrize("scale, offset", [(1, 0), (1, 1e7), (1e-20, 0), (1e25, 0)])
@pytest.mark.parametrize("copies", [1, 30])
def test_blocks_equal_all_distances(scale, offset, copies, monkeypatch):
    """Also where single precision tells nothing apart, with ties, several rows an owner, and rows that aren't finite."""
    monkeypatch.setattr(nb, "BLOCK", 20)
    monkeypatch.setattr(nb, "ROWS", 30)
    rng = np.random.default_rng(4)
    v = np.repeat(rng.normal(size=(240 // copies, 7)), copies, axis=0)[rng.permutation(240)] * scale + offset
    v[7], v[9, 0] = np.nan, np.inf
    owners = [None if i % 50 == 0 else f"o{i % 60}" for i in range(240)]
    rows = of(v, owners)
    want = []
    for i in range(240):
        with np.errstate(invalid="ignore"):
            d = np.sqrt(((v[i] - v) ** 2).sum(axis=1))
        near = sorted((d[j], f"v{j:04d}") for j in range(240) if np.isfinite(d[j]) and (owners[i] is None or owners[i] != owners[j]))
        want += [(f"v{i:04d}", *x) for x in near[:4]]
    got = nb.best_of_blocks(rows, nb.first_of_equal(rows, 4), 4)
    assert list(zip(*(got.column(c).to_pylist() for c in ("id", "dist", "other")))) == want
