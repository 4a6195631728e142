"""Mixing sources to target weights with a low-discrepancy schedule.

1. Sizes: words of each document; targets: each source's share by weight of the whole, no more than ``MAX_EPOCHS`` times
   its size, the excess shared among the others by weight until none is above (water filling).
2. Schedule: slot i gets the point frac(i * golden ratio), mapped through the cumulative targets, in blocks, to a source.
   Any run of slots then holds each source close to its share. The r-th slot of a source takes its r-th block.
   The largest gap among N such points is under 2.62 / N, so with N = 2.7 times all blocks every source gets its own
   number of slots, however small it is; slots beyond that number stay empty.
3. Blocks: a source's documents stand in a shuffled order (by keyed hash) on a line of its words, which is repeated for
   each epoch; block r is the words r*B .. (r+1)*B of that line, cut off at the target. So blocks have equal words but
   the last, a document is taken at most once an epoch, and a source gives its target exactly once its slots are drawn.

Nothing is ordered in one place: documents are dealt into hash buckets per source and slots into ranges, sums per bucket
and range come first, and only those few rows are summed in order. A hot source is many buckets.

Definitions: null texts have size 0 and are taken 0 times, as is anything of a source of size 0. The null source stands
last by code point. Equal rows stand next to each other and are taken one by one. Reruns agree: hashes are keyed by
``seed``, ties are broken by doc_id and text digest. An empty table gives an empty mix.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_WORDS, content_key, materialize, small

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
BLOCK = 4096
#: Documents of a bucket and slots of a range, about; a task sorts one at a time.
BUCKET_DOCS = 2_000
RANGE_SLOTS = 100_000
GOLDEN = np.uint64(0x9E3779B97F4A7C15)  # frac of the golden ratio, times 2**64


def with_size(documents: DataFrame) -> DataFrame:
    return documents.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(SPACE_WORDS)), F.lit(0)).cast("long"))


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, budget: int | None = None) -> DataFrame:
    """(source, source_no, n_docs, source_size, weight, target, words), one row a source, null last; words is target rounded.

    Water filling in closed form: by the level cap/weight at which a source is full, ascending; a source is capped if
    the level that all later ones would share is at or above its own. All windows are over this one-row-a-source table.
    """
    by_source = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    order = Window.orderBy(F.asc_nulls_last("source"))
    t = by_source.withColumn("source_no", F.row_number().over(order) - 1)
    t = t.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int")))
    cap = (max_epochs * F.col("source_size")).cast("double")
    t = t.withColumns({"__cap": cap, "__full": cap / F.col("weight")})
    level, everything = Window.orderBy("__full", "source_no"), Window.partitionBy()
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything) if budget is None else F.lit(budget)
    rest = total - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))
    share = rest / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    t = t.withColumn("__share", share)
    # the first source that the shared level does not fill, and all after it, take that level
    t = t.withColumn("__level", F.min(F.when(F.col("__share") < F.col("__full"), F.struct("__full", "source_no", "__share"))).over(everything))
    after = F.struct("__full", "source_no") >= F.struct(F.col("__level")["__full"], F.col("__level")["source_no"])
    target = F.when(F.col("__level").isNotNull() & after, F.col("weight") * F.col("__level")["__share"]).otherwise(F.col("__cap"))
    return t.withColumn("target", target).withColumn("words", F.round("target").cast("long")).drop("__cap", "__full", "__share", "__level")


def schedule(blocks: list[tuple[int, int]], spark) -> DataFrame:
    """(slot, source_no, rank): slots in order, each with its source and its rank among the slots of that source.

    ``blocks`` has one (source_no, number of blocks) a source. Ranges of slots are counted first, so ranks need no
    single order.
    """
    number = np.array([n for _, n in blocks], np.float64)
    edges = np.cumsum(number) / number.sum()
    numbers = np.array([s for s, _ in blocks], np.int32)
    edges[np.flatnonzero(number)[-1] :] = 1.0
    n_slots = math.ceil(2.7 * number.sum()) + 3
    n_ranges = max(1, math.ceil(n_slots / RANGE_SLOTS))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("id").to_pylist():
                slot = np.arange(k * RANGE_SLOTS, min(n_slots, (k + 1) * RANGE_SLOTS), dtype=np.int64)
                point = ((slot.astype(np.uint64) + np.uint64(1)) * GOLDEN) >> np.uint64(11)
                at = np.searchsorted(edges, point.astype(np.float64) / 2**53, side="right")
                order = np.argsort(at, kind="stable")
                first = np.searchsorted(at[order], np.arange(len(number)))
                rank = np.empty(len(slot), np.int64)
                rank[order] = np.arange(len(slot)) - first[at[order]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slot), k, np.int64)), pa.array(slot), pa.array(numbers[at]), pa.array(rank)], ["range", "slot", "source_no", "rank"])

    drawn = spark.range(0, n_ranges, 1, min(n_ranges, 1000)).mapInArrow(draw, "range long, slot long, source_no int, rank long")
    counts = drawn.groupBy("range", "source_no").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source_no").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("range", "source_no", F.coalesce(before, F.lit(0).cast("long")).alias("offset"))
    return drawn.join(offsets, ["range", "source_no"]).select("slot", "source_no", (F.col("rank") + F.col("offset")).alias("rank"))


def on_lines(sized: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """Add source_no, source_size, target and start: where each document begins on its source's shuffled line."""
    h = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("__key"))
    n_buckets = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / BUCKET_DOCS)).cast("int")
    joined = sized.join(F.broadcast(targets) if small(targets, 20_000) else targets, sized["source"].eqNullSafe(targets["source"]))
    joined = joined.drop(targets["source"]).withColumns({"__h": h, "__bucket": F.pmod(F.shiftright(h, 20), n_buckets).cast("int")})
    sums = joined.groupBy("source_no", "__bucket").agg(F.sum("size").alias("__sum"))
    ahead = F.sum("__sum").over(Window.partitionBy("source_no").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("source_no", "__bucket", F.coalesce(ahead, F.lit(0).cast("long")).alias("__ahead"))
    inside = Window.partitionBy("source_no", "__bucket").orderBy("__h", "doc_id", "__key").rowsBetween(Window.unboundedPreceding, -1)
    placed = joined.withColumn("__inside", F.coalesce(F.sum("size").over(inside), F.lit(0).cast("long"))).join(sums, ["source_no", "__bucket"])
    return placed.withColumn("start", F.col("__ahead") + F.col("__inside")).drop("__h", "__bucket", "__inside", "__ahead")


def mix(documents: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, block: int = BLOCK, seed: int = 0, budget: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with size, source_size, target, taken; slots; targets).

    The first has doc_id, source and __key (text digest) and no text; slots are (slot, source_no, rank, begin, end): the
    words begin..end of the source's line, repeated for each epoch, that the slot takes.
    """
    spark = documents.sparkSession
    sized = materialize(with_size(documents.select("doc_id", "source", "text")).select("doc_id", "source", content_key("text").alias("__key"), "size"), "sizes")
    targets = materialize(source_targets(sized, weights, max_epochs, budget), "targets")
    rows = [tuple(r) for r in targets.select("source_no", F.ceil(F.col("words") / block)).orderBy("source_no").collect()]  # one a source
    if not any(n for _, n in rows):
        nothing = on_lines(sized, targets, seed).withColumn("taken", F.lit(0).cast("long"))
        return nothing, spark.createDataFrame([], "slot long, source_no int, rank long, begin long, end long"), targets
    per_source = F.broadcast(targets.select("source_no", "words", F.col("source_size").alias("__n")))  # as many rows as were collected
    slots = schedule(rows, spark).join(per_source, "source_no").where(F.col("rank") * block < F.col("words"))
    slots = slots.select("slot", "source_no", "rank", (F.col("rank") * block).alias("begin"), F.least((F.col("rank") + 1) * block, "words").alias("end"))
    slots = materialize(slots, "slots")

    # Join documents with the blocks they meet: by block number on the line of one epoch, so each document meets
    # about size/block + 2 blocks an epoch. What slots take of one line block is added up over epochs first.
    lines = on_lines(sized, targets, seed)
    pieces = slots.join(per_source, "source_no").withColumn("__e", F.explode(F.sequence(F.floor(F.col("begin") / F.col("__n")), F.floor((F.col("end") - 1) / F.col("__n")))))
    pieces = pieces.select(
        "source_no",
        F.greatest(F.col("begin") - F.col("__e") * F.col("__n"), F.lit(0).cast("long")).alias("a"),
        F.least(F.col("end") - F.col("__e") * F.col("__n"), F.col("__n")).alias("b"),
    )
    cells = pieces.withColumn("cell", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor((F.col("b") - 1) / block))))
    cells = cells.groupBy("source_no", "cell").agg(F.collect_list(F.struct(F.greatest("a", F.col("cell") * block).alias("a"), F.least("b", (F.col("cell") + 1) * block).alias("b"))).alias("parts"))
    some = lines.where("size > 0").select("source_no", "doc_id", "__key", "start", "size")
    met = some.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)))).join(cells, ["source_no", "cell"])
    overlap = F.aggregate("parts", F.lit(0).cast("long"), lambda s, p: s + F.greatest(F.lit(0).cast("long"), F.least(p["b"], F.col("start") + F.col("size")) - F.greatest(p["a"], F.col("start"))))
    taken = met.groupBy("source_no", "start").agg(F.sum(overlap).alias("__taken"))
    out = lines.join(taken.withColumn("__some", F.lit(True)), ["source_no", "start"], "left")
    return out.withColumn("taken", F.when(F.col("size") > 0, F.coalesce("__taken", F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))).drop("__taken", "__some"), slots, targets


def slot_words(mixed: DataFrame, slots: DataFrame, targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, source_no, doc_id, epoch, first, last): which words of which document each slot takes, first to before last.

    The arguments are those that ``mix`` returns. Read in the order of slot, epoch and the place on the line (``start``),
    this is the mix itself. Documents and slots meet by number of their block on the line of one epoch.
    """
    sizes = targets.select("source_no", F.col("source_size").alias("__n"))
    each = slots.join(sizes, "source_no").withColumn("epoch", F.explode(F.sequence(F.floor(F.col("begin") / F.col("__n")), F.floor((F.col("end") - 1) / F.col("__n")))))
    a, b = F.greatest(F.col("begin") - F.col("epoch") * F.col("__n"), F.lit(0).cast("long")), F.least(F.col("end") - F.col("epoch") * F.col("__n"), F.col("__n"))
    cells = lambda x, y: F.explode(F.sequence(F.floor(x / block), F.floor((y - 1) / block)))
    parts = each.select("slot", "source_no", "epoch", a.alias("a"), b.alias("b")).withColumn("cell", cells(F.col("a"), F.col("b")))
    docs = mixed.where("size > 0").select("source_no", "doc_id", "start", "size").withColumn("cell", cells(F.col("start"), F.col("start") + F.col("size")))
    met = parts.join(docs, ["source_no", "cell"])
    first = F.greatest("a", "start", F.col("cell") * block) - F.col("start")
    last = F.least(F.col("b"), F.col("start") + F.col("size"), (F.col("cell") + 1) * block) - F.col("start")
    met = met.select("slot", "source_no", "epoch", "start", "doc_id", first.alias("first"), last.alias("last")).where("first < last")
    return met.groupBy("slot", "source_no", "epoch", "start", "doc_id").agg(F.min("first").alias("first"), F.max("last").alias("last"))


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    """Contract query: the mix of all documents."""
    mixed, _, _ = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def repeat_documents(documents: DataFrame, **how) -> DataFrame:
    """Pipeline stage: each document as often as the mix takes its words, a part counting as one; columns unchanged.

    Documents of which nothing is taken leave; repeats are equal rows.
    """
    mixed, _, _ = mix(documents, **how)
    times = F.ceil(F.col("taken") / F.greatest(F.col("size"), F.lit(1))).cast("int")
    per_doc = mixed.groupBy("doc_id", "source", "__key").agg(F.sum(times).alias("__times"), F.count("*").alias("__rows"))
    # equal rows share their repeats as evenly as whole numbers allow: every row gets the rounded-up mean
    per_doc = per_doc.select(F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.col("__key").alias("__k"), F.ceil(F.col("__times") / F.col("__rows")).cast("int").alias("__times")).where("__times > 0")
    keyed = documents.withColumn("__key", content_key("text"))
    same = F.col("doc_id").eqNullSafe(F.col("__d")) & F.col("source").eqNullSafe(F.col("__s")) & (F.col("__key") == F.col("__k"))
    joined = keyed.join(per_doc, same).withColumn("__i", F.explode(F.sequence(F.lit(1), "__times")))
    return joined.select(*documents.columns)
