"""Helpers shared by the training-data operators: shared storage, Arrow batches, connected components."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts that split on ASCII white space.
SPACE_WORDS = r"[^\x20\x09-\x0D]+"
#: A side may be broadcast when its measured size is under this many bytes.
BROADCAST_BYTES = 8 << 20


_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset a temporary one stands in,
    but only if all tasks run on this machine; on a cluster it would not be shared."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="tracewright-")
    return _OWN_DIRS[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: later steps no longer depend on its lineage."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int) -> bool:
    """True if ``df`` has at most ``rows`` rows; it looks at no more than one row beyond the bound."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast if the measured row count times ``row_bytes`` is under ``limit``; else leave the shuffle join."""
    return F.broadcast(df) if small(df, limit // row_bytes) else df


def join_salted(left: DataFrame, right: DataFrame, on: list[str], spread: list[str], how: str = "inner", counts: DataFrame | None = None, share: int = 2000, least: int = 200, few: int = 20_000) -> DataFrame:
    """``left`` joined with ``right`` (inner or left) on equal columns, no task with more than its part of a frequent key.

    A key that holds over 1/``share`` of left's rows (at most ``share`` keys do, so their table may be broadcast) is dealt
    out by the hash of the columns ``spread``, and right's rows of it are repeated for every part. Left is read twice, or only
    counted if ``counts`` has its rows per key as __c. Up to ``few`` rows are no burden for a task and joined plainly.
    """
    rows = left.count()
    if rows <= few:
        return left.join(right, on, how)
    n = max(least, rows // share)
    counts = left.groupBy(*on).agg(F.count("*").alias("__c")) if counts is None else counts
    hot = materialize(counts.where(F.col("__c") > n).select(*on, F.ceil(F.col("__c") / n).cast("int").alias("__c")), "hot-keys")
    if hot.isEmpty():
        return left.join(right, on, how)
    hot = F.broadcast(hot)
    salt = F.when(F.col("__c").isNull(), 0).otherwise(F.pmod(F.xxhash64(*spread, F.lit(7)), "__c")).cast("int")
    every = F.sequence(F.lit(0), F.coalesce("__c", F.lit(1)) - 1)
    a = left.join(hot, on, "left").withColumn("__salt", salt).drop("__c")
    b = right.join(hot, on, "left").withColumn("__salt", F.explode(every)).drop("__c")
    return a.join(b, [*on, "__salt"], how).drop("__salt")


def content_key(text) -> F.Column:
    """128-bit digest of a text, null as the empty text; equal texts share their work and their result."""
    return F.unhex(F.md5(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))))


def groups_of_bytes(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Cut a string column into runs of rows of about ``limit`` UTF-8 bytes (one row at least): (first row, texts)."""
    first, size, out = 0, 0, []
    for i, text in enumerate(column.to_pylist()):
        b = b"" if text is None else text.encode("utf-8", "surrogatepass")
        if out and size + len(b) > limit:
            yield first, out
            first, size, out = i, 0, []
        out.append(b)
        size += len(b) + 1
    if out:
        yield first, out


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finalizer, in place where it can."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown as needed."""

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = pow(self.BASE, -1, 1 << 64)
            for name, base in (("up", self.BASE), ("down", inverse)):
                x = np.full(n, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up[:n], self.down[:n]


POWERS = Powers()
#: One random 64-bit value per byte, from a fixed rule.
BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of value(byte) * base**i modulo 2**64, with a leading zero."""
    up, _ = POWERS.get(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * up[: len(data)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] whatever its place, from ``prefix_hash``."""
    _, down = POWERS.get(len(prefix))
    return mix64((prefix[end] - prefix[start]) * down[start])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values: block-wise running minima from both sides, linear time."""
    n = len(x)
    if n < w:
        return x[:0]
    if w <= 8:
        out = x[: n - w + 1].copy()
        for j in range(1, w):
            np.minimum(out, x[j : n - w + 1 + j], out=out)
        return out
    padded = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                yield from [out] if isinstance(out, pa.RecordBatch) else out

    return df.mapInArrow(run, schema)


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Smallest node reachable from each node that has an edge: (node, root).

    ``edges`` has two long columns a, b in either order; self loops and repeats are allowed, an empty table gives
    an empty result. Each round hooks every node to the smallest of its neighbours, follows the pointers to their
    ends and contracts the edges, which leaves only local minima as nodes; random orders take about log2(n) rounds.
    State is written to the shared folder each round; nothing but two counts comes to the driver.
    """
    live = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = materialize(live.select(F.col("a").alias("node")).union(live.select("b")).distinct().select("node", F.col("node").alias("root")), "labels")
    for _ in range(max_rounds):
        if live.isEmpty():
            return labels
        both = live.union(live.select("b", "a"))
        hook = materialize(both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.first("a")).alias("p")), "hook")
        while True:
            up = hook.select(F.col("n").alias("p"), F.col("p").alias("q"))
            nxt = materialize(join_salted(hook, up, ["p"], ["n"]).select("n", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("moved")), "hook")
            moved = not nxt.where("moved").isEmpty()
            hook = nxt.select("n", "p")
            if not moved:
                break
        to = hook.withColumnRenamed("n", "root")
        labels = materialize(join_salted(labels, to, ["root"], ["node"], "left").select("node", F.coalesce("p", "root").alias("root")), "labels")
        left = hook.select(F.col("n").alias("a"), F.col("p").alias("pa"))
        right = hook.select(F.col("n").alias("b"), F.col("p").alias("pb"))
        half = materialize(join_salted(live, left, ["a"], ["b"]), "half-edges")
        both = join_salted(half, right, ["b"], ["a"]).where("pa <> pb")
        live = materialize(both.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def spreadable(df: DataFrame, without: tuple[str, ...] = ()) -> list[str]:
    """Columns that a hash may be taken of, so that equal rows alone must share a part."""
    return [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant" and f.name not in without]


def scale_to_parts(n: int, per_part: int, least: int = 1) -> int:
    """Partitions so that each holds about ``per_part`` items."""
    return max(least, math.ceil(n / per_part))
