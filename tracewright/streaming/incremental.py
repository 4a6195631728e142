"""Incremental annotation: new episodes are taken up as files arrive, finished ones are never done again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import conform, ddl
from ..sources.commits import CommitLog


def remaining(episodes: DataFrame, done: DataFrame) -> DataFrame:
    """Episodes that have no annotation yet."""
    return episodes.join(done.select("episode_id").distinct(), "episode_id", "left_anti")


def annotate_batch(spark: SparkSession, episodes: DataFrame, annotate: Callable[[DataFrame], DataFrame], out: str, key: str | None = None) -> None:
    """Annotate what is not done and commit it, at most once for a ``key``. ``annotate`` gives annotations of the episodes it
    could do; those it couldn't become the table ``out``/failures, from which done ones leave."""
    done, failed = CommitLog(spark, f"{out}/annotations"), CommitLog(spark, f"{out}/failures")
    todo = remaining(episodes, done.read(schema=ddl()))
    if key is None or key not in done.snapshot().keys:
        done.append(conform(annotate(todo)), key)
    base, kinds = failed.snapshot(), ", ".join(f"`{n}` {t}" for n, t in episodes.dtypes)
    left = remaining(episodes.unionByName(failed.read(base.version, kinds)), done.read(schema=ddl()))
    failed.replace(left.dropDuplicates(["episode_id"]), base)


def annotate_stream(spark: SparkSession, source: str, schema: str, annotate: Callable[[DataFrame], DataFrame], out: str):
    """Annotate all episode files below ``source`` that are new since the last run, and what failed before, then stop; progress
    is in the query's checkpoint, and a batch that is replayed commits nothing twice. Returns the finished query."""

    def batch(df: DataFrame, number: int) -> None:
        failed = CommitLog(spark, f"{out}/failures").read(schema=schema)
        annotate_batch(spark, df.unionByName(failed).dropDuplicates(["episode_id"]), annotate, out, f"batch-{number}")

    stream = spark.readStream.schema(schema).parquet(source)
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{out}/_progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def event_windows(events: DataFrame, time: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums per event type and tumbling window with a watermark. Works on streams and tables alike; an extra
    beyond the annotation rules."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
