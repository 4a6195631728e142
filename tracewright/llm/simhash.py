"""SimHash near-duplicate detection with pigeonhole blocks.

A fingerprint has 64 bits. Two fingerprints that differ in at most d bits leave at least m - d of m blocks of bits
equal, so after joining on every choice of m - d blocks no close pair is missed. m is chosen from the number of distinct
fingerprints: more blocks make longer keys and fewer chance meetings, at the price of more keys per fingerprint.
Rows of one key are compared where they lie; what leaves a task are links of a spanning forest of each key, not all
pairs. A key with more than ``HOT_KEY`` fingerprints is dealt out as pairs of chunks, so no task holds more than two.

Definitions: letters A-Z are lower-cased, words are split at ASCII white space, shingles are runs of ``shingle`` words
with repeats, space-joined; a shorter text is one shingle; a text without words (null and empty too) has fingerprint 0
and links like any other. Each input row gives one row; equal fingerprints are one node, so copies are never paired.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, groups_of_bytes, join_salted, map_arrow, materialize

SEED = 42
HOT_KEY = 20_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: bytes, shingle: int) -> list[int]:
    """XXH64 of every shingle of a UTF-8 text."""
    words = text.translate(_LOWER).split()  # bytes.split() cuts at exactly the ASCII white space
    if not words:
        return []
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    return [digest(view[a:b], SEED) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())]


def fingerprint(hashes: np.ndarray) -> int:
    """Bit j is set if over half the hashes have it set."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        part = hashes[a : a + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprint(documents: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row as a signed long."""

    def compute(batch: pa.RecordBatch):
        fps = [fingerprint(np.array(shingle_hashes(t, shingle), np.uint64)) for _, texts in groups_of_bytes(batch.column("text")) for t in texts]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return map_arrow(documents.select("doc_id", "text"), compute, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, fp long")


def block_masks(m: int, d: int) -> list[int]:
    """For each choice of m - d of m nearly equal blocks of 64 bits, the mask of its bits."""
    cut = [64 * i // m for i in range(m + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(cut, cut[1:])]
    return [sum(x) for x in combinations(block, m - d)]


def choose_blocks(n: int, d: int) -> int:
    """Blocks for n fingerprints: least rows plus chance pairs (a pair costs about 1/40 of a row)."""

    def cost(m: int) -> float:
        keys = math.comb(m, d)
        return keys * n * (1 + n / 2 ** (64 * (m - d) / m) / 80)

    return min(range(d + 1, d + 6), key=cost)


def _near(a: np.ndarray, b: np.ndarray, d: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= d


def forest_of_run(fps: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what distance <= d connects among distinct fps: a search that visits each value once."""
    left, a, b = fps, [], []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = _near(left, x, d)
            if near.any():
                found, left = left[near], left[~near]
                a.append(np.full(len(found), x))
                b.append(found)
                todo.extend(found)
    return (np.concatenate(a), np.concatenate(b)) if a else (fps[:0], fps[:0])


def links_of_keys(key: np.ndarray, fp: np.ndarray, d: int, long_run: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows with equal keys; rows are sorted by key and distinct. Short runs are compared shift by shift."""
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    size = np.diff(cut)
    a, b = [], []
    for i in np.flatnonzero(size > long_run):
        x, y = forest_of_run(fp[cut[i] : cut[i + 1]], d)
        a.append(x)
        b.append(y)
    short = np.where(size > long_run, 0, size)
    remaining = np.repeat(cut[1:], size) - 1 - np.arange(len(key))  # rows after this one in its run
    remaining[np.repeat(short == 0, size)] = 0
    at = np.flatnonzero(remaining > 0)
    for shift in range(1, int(short.max(initial=1))):
        at = at[remaining[at] >= shift]
        if not len(at):
            break
        hit = at[_near(fp[at], fp[at + shift], d)]
        a.append(fp[hit])
        b.append(fp[hit + shift])
    return (np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])


def _key(mask: int) -> F.Column:
    signed = mask - (1 << 64) if mask >> 63 else mask
    return F.col("fp").bitwiseAND(F.lit(signed))


def close_pairs(fps: DataFrame, n: int, d: int = 4, hot_key: int = HOT_KEY) -> DataFrame:
    """(a, b) long: links that connect every two of the n distinct ``fps`` that chains of distance <= d connect."""
    masks = block_masks(choose_blocks(n, d), d)
    keys = F.array(*(F.struct(F.lit(i).cast("short").alias("t"), _key(m).alias("k")) for i, m in enumerate(masks)))
    rows = fps.select("fp", F.inline(keys))
    hot = rows.groupBy("t", "k").agg(F.count("*").alias("n")).where(F.col("n") > hot_key)
    hot = materialize(hot.select("t", "k", F.ceil(F.col("n") / hot_key).cast("int").alias("c")), "hot-keys")
    if hot.isEmpty():
        dealt = rows.select("t", "k", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp")
    else:
        mine = F.pmod(F.xxhash64("fp"), "c").cast("int")
        pair = F.transform(F.sequence(F.lit(0), F.col("c") - 1), lambda x: F.struct(F.least(x, mine).alias("i"), F.greatest(x, mine).alias("j")))
        cold = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
        dealt = rows.join(hot, ["t", "k"], "left").select("t", "k", "fp", F.inline(F.when(F.col("c").isNull(), cold).otherwise(pair)))
    parts = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n * len(masks) / 500_000))
    dealt = dealt.repartition(parts, "t", "k", "i", "j").sortWithinPartitions("t", "k", "i", "j")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows of the last key so far

        def solve(cols):
            t, k, i, j, fp = cols
            change = np.ones(len(t), bool)
            change[1:] = (t[1:] != t[:-1]) | (k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            a, b = links_of_keys(np.cumsum(change), fp, d)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            cols[4] = cols[4].view(np.uint64)
            last = np.logical_and.reduce([c == c[-1] for c in cols[:4]])
            whole = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
            if whole or (held and any(c[0] != h[-1] for c, h in zip(cols[:4], held[-1]))):
                done = [np.concatenate([*(h[x] for h in held), cols[x][:whole]]) for x in range(5)]
                held = []
                yield solve(done)
            held.append(tuple(c[whole:] for c in cols))
        if held:
            yield solve([np.concatenate([h[x] for h in held]) for x in range(5)])

    return dealt.select("t", "k", "i", "j", "fp").mapInArrow(links, "a long, b long")


def components(documents: DataFrame, shingle: int = 4, d: int = 4, hot_key: int = HOT_KEY) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row: 16 hex digits; the smallest doc_id that links reach."""
    prints = materialize(with_fingerprint(documents, shingle), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    n = nodes.count()
    roots = connected_components(close_pairs(nodes.select("fp"), n, d, hot_key))
    linked = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = join_salted(linked.select("fp", "root"), smallest, ["root"], ["fp"]).select("fp", "component_id")
    return join_salted(prints, by_fp, ["fp"], ["doc_id"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    """Contract query: near-duplicate components of all documents."""
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def keep_one(documents: DataFrame, shingle: int = 4, d: int = 4) -> DataFrame:
    """Pipeline stage: of each component the document with the smallest doc_id stays, whole and unchanged.

    Rows with one doc_id are one document, of which one row stays. Rows with a null doc_id can't be named and all stay.
    """
    keep = materialize(components(documents, shingle, d).where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")), "kept")
    kept = documents.join(keep.select("doc_id"), "doc_id", "left_semi")
    if not keep.where("n > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id"])
    return kept.unionByName(documents.where("doc_id is null"))
