"""A dataset that joins a scored pool: the same scores as of the whole pool anew."""

import numpy as np

from tracewright.operators import corpus
from tracewright.storage import materialize

KIND = "dataset string, episode_id string, embedding array<double>, quality double, speed_norm double"


def test_added_datasets_are_scored_as_the_whole(spark):
    rng = np.random.default_rng(3)
    rows = [(f"d{i % 3}", f"e{i // 3}", rng.normal(i % 2, 1, 6).round(2).tolist(), float(i % 5), float(rng.random())) for i in range(90)]
    rows += [("d2", "e0copy", rows[0][2], 1.0, 0.5)]
    part = lambda *names: spark.createDataFrame([r for r in rows if r[0] in names], KIND)
    kept = materialize(corpus.pool_neighbours(part("d0")), "neighbours")
    for before, added in ((("d0",), ("d1",)), (("d0", "d1"), ("d2",))):
        kept = materialize(corpus.pool_neighbours(part(*added), 8, part(*before), kept), "neighbours")
        pool = part(*before, *added)
        want, got = (sorted(map(tuple, df.collect())) for df in (corpus.rescore(pool), corpus.rescore(pool, neighbours=kept)))
        assert got == want and len(got) == pool.count()


def test_neighbours_are_found_once(spark, monkeypatch):
    """Value, tiers and speed read novelty several times; the search is not repeated for them."""
    rng, passed, search = np.random.default_rng(9), spark.sparkContext.accumulator(0), corpus.nearest
    rows = [(f"d{i % 2}", f"e{i}", rng.normal(size=4).tolist(), float(i % 5), float(rng.random())) for i in range(40)]

    def counted(batches):
        for batch in batches:
            passed.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(corpus, "nearest", lambda *a: search(*a).mapInArrow(counted, "id string, dist double, other string"))
    assert corpus.rescore(spark.createDataFrame(rows, KIND)).count() == 40
    assert len(corpus.rescore(spark.createDataFrame(rows, KIND)).collect()) == 40
    assert passed.value == 2 * 8 * 40
