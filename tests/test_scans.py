"""Scans of datasets open the files that an episode list needs."""

from pyspark.sql import functions as F

from tracewright.sources import episodes as src


def test_files_are_chosen_by_footers(spark, tmp_path):
    rows = spark.range(6000).select(F.floor(F.col("id") / 100).cast("long").alias("episode_index"), (F.col("id") % 100).alias("frame_index"), F.array(F.col("id").cast("float")).alias("action"), F.concat(F.lit("t"), F.floor(F.col("id") / 100)).alias("task"))
    rows.repartitionByRange(6, "episode_index").sortWithinPartitions("episode_index", "frame_index").write.option("parquet.block.size", 4096).parquet(str(tmp_path / "data" / "a"))
    every = {r["path"]: (r["first"], r["last"], r["rows"]) for r in src.episode_files(spark, str(tmp_path)).collect()}
    assert len(every) == 6 and sum(x[2] for x in every.values()) == 6000
    some = src.vector_frames(spark, str(tmp_path), episodes=[3, 4])
    need = {p for p, (a, b, _) in every.items() if a <= 3 <= b or a <= 4 <= b}
    assert len(some.inputFiles()) == len(need) < 3
    assert sorted((r["episode_id"], r["frame_idx"]) for r in some.collect()) == sorted((str(e), i) for e in (3, 4) for i in range(100))
    assert src.vector_frames(spark, str(tmp_path), episodes=[]).count() == 0 and src.vector_frames(spark, str(tmp_path), episodes=[999]).count() == 0
    assert src.vector_frames(spark, str(tmp_path)).count() == 6000
    first = src.first_frame_tasks(spark, str(tmp_path), [59])
    assert [(r["episode_id"], r["__first"]) for r in first.collect()] == [("59", "t59")]
