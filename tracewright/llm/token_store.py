"""Token-id output as a content-addressed store.

Every text becomes ids, the end id included. A rolling hash over ``ROLL`` ids cuts each document's stream where its high
bits are zero, so equal passages give equal chunks wherever they stand. A chunk is named by the BLAKE2b-256 digest of
its ids as little-endian unsigned 32-bit integers and its bytes are stored once. Files, below one folder:

- ``blocks``, sorted by kind within each file, so that a read of one kind skips the other's row groups;
  kind chunk: digest, n_ids, width, data (little-endian ids of width 2 bytes, or 4 if the vocabulary needs it);
  kind doc: doc_id, n_ids, root, digests, sizes - the documents as tasks met them
- ``recipes``: shard, place (order in the shard), doc_id, n_ids, start, root, digests, sizes; shards and places ascend by doc_id
- ``manifest``: shard, n_docs, n_ids, start, root: the Merkle root over the document roots of the shard

The Merkle root of a document is over its chunk digests; that of a shard is over its documents' roots, ``FAN`` at a
time and level by level, so no row holds more. Reading verifies each chunk against its name, each document
against its root and each shard against the manifest, and fails on any difference.

Definitions: null texts are empty and hold the end id only. Documents with equal doc_id stand next to each other,
ordered by root; null ids come first. An empty table makes an empty store. Other columns, whatever their names, are
not stored. Texts may be of any length; a document's list of digests is one row.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Powers, join_salted, map_arrow, materialize, mix64, new_path, scale_to_parts

END_ID = 1
ROLL = 16
MASK_BITS = 11
LEAST, MOST = 256, 1 << 16
#: Leaves under one node of a shard's Merkle tree.
FAN = 1024
SHARD_DOCS = 500_000
#: Bytes of text that are encoded at once (one text at least).
GROUP_BYTES = 6 << 20
#: Composed Latin letters, each with one lower-case form, and ASCII marks, no apostrophe, that may follow.
_LETTERS = r"[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+"
_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
_PLAIN = "^" + _LETTERS + r"[!-&(-/:-@\[-`{-~]*$"
_POWERS = Powers()
#: A random value of each common id, by the rule used for all ids.
_ID_VALUES = mix64(np.arange(1, (1 << 16) + 1, dtype=np.uint64))


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[start : start + size] of every pair, one after the other."""
    return flat[np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]


def _lists(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists as one array and their sizes."""
    size = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(size.sum())), size


class WordEncoder:
    """Ids of whole texts from the ids of their distinct words between white space.

    The tokenizer splits at white space before it merges, and drops the white space, so words are independent and each
    distinct one is encoded once a group of texts. Most words are Latin letters and maybe marks: the letters are one
    pre-token, lower-cased, the marks after them another. Letters are encoded many in one call, by a tokenizer of the
    same vocabulary and merges that only splits at spaces, and told apart by the end-of-word piece, the last of each.
    Any other word goes through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
        suffix = model["end_of_word_suffix"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.tokenizer = Tokenizer.from_file(path)
        self.letters = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=suffix, cache_capacity=0))
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for piece, i in self.tokenizer.get_vocab().items():
            self.ends[i] = piece.endswith(suffix)

    def whole(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return _lists([e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)])

    def of_letters(self, words: pa.Array, group: int = 1000) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and their number, of each lower-case word of letters."""
        n = len(words)
        cut = np.append(np.arange(0, n, group), n).astype(np.int32)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(cut), words), " ").to_pylist()
        flat, size = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for a, e in zip(cut.tolist(), self.letters.encode_batch_fast(joined, add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids])
            sizes = np.diff(ends, prepend=-1)
            if len(ends) != min(group, n - a):  # a letter that no piece holds
                ids, sizes = self.whole(words.slice(a, group).to_pylist())
            flat.append(ids)
            size.append(sizes)
        return np.concatenate(flat), np.concatenate(size)

    def of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat, start, size): ids of distinct words as pieces; word i is the pieces 2i and 2i + 1, the latter maybe empty."""
        plain = pc.match_substring_regex(words, _PLAIN)
        at, rest = np.flatnonzero(plain.to_numpy(zero_copy_only=False)), np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        some = words.take(pa.array(at))
        base = pc.utf8_lower(pc.ascii_rtrim(some, _MARKS)).dictionary_encode()
        marks = pc.replace_substring_regex(some, "^" + _LETTERS, "").dictionary_encode()
        parts = [self.of_letters(base.dictionary), self.whole(marks.dictionary.to_pylist()), self.whole(words.take(pa.array(rest)).to_pylist())]
        flat, sizes = np.concatenate([p[0] for p in parts]), [p[1] for p in parts]
        size = np.concatenate(sizes)
        start = np.cumsum(size) - size
        piece = np.full((len(words), 2), -1, np.int64)
        piece[at, 0] = base.indices.to_numpy()
        piece[at, 1] = marks.indices.to_numpy() + len(sizes[0])
        piece[rest, 0] = np.arange(len(rest)) + len(sizes[0]) + len(sizes[1])
        start, size = np.append(start, 0), np.append(size, 0)  # piece -1 is empty
        return flat, start[piece.ravel()], size[piece.ravel()]

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text."""
        ids, size = self.encode_together(pa.array(texts, pa.string()))
        yield from np.split(ids, np.cumsum(size)[:-1])

    def encode_together(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each); null is empty."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = split.flatten().dictionary_encode()
        flat, start, size = self.of_words(words.dictionary)
        code = words.indices.to_numpy()
        pieces = np.stack([2 * code, 2 * code + 1], axis=1).ravel()
        size = size[pieces]
        ends = np.concatenate([[0], np.cumsum(size)])[2 * (split.offsets.to_numpy() - split.offsets[0].as_py())]
        return gather(flat, start[pieces], size), np.diff(ends)


@lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def text_groups(texts: pa.Array, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows first .. last of about ``limit`` bytes of text, one row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first, n = 0, len(size)
    while first < n:
        done = size[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(size, done + limit, side="right")))
        yield first, last
        first = last


def marks_of(ids: np.ndarray) -> np.ndarray:
    """Places after which a stream may be cut: the rolling hash of the ``ROLL`` ids before has zeros in its high bits."""
    n = len(ids)
    if n < ROLL:
        return np.zeros(0, np.int64)
    prefix = np.zeros(n + 1, np.uint64)
    up, down = _POWERS.get(n + 1)
    values = _ID_VALUES[ids] if ids.max() < len(_ID_VALUES) else mix64(ids.astype(np.uint64) + np.uint64(1))
    np.cumsum(values * up[:n], out=prefix[1:])
    rolled = (prefix[ROLL:] - prefix[: n + 1 - ROLL]) * down[: n + 1 - ROLL]
    return np.flatnonzero(rolled >> np.uint64(64 - MASK_BITS) == 0) + ROLL


def cut_stream(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ends of the chunks of documents that end at ``ends`` of one stream: content-defined, at least LEAST and at most MOST
    ids (the last of a document may be shorter). LEAST is over ROLL, so a document's cuts depend on its own ids only."""
    marks = marks_of(ids)
    first = np.concatenate([[0], ends[:-1]])
    a, b = np.searchsorted(marks, first + LEAST), np.searchsorted(marks, ends)
    cuts = [ends]
    for i in np.flatnonzero((a < b) | (ends - first > MOST)).tolist():
        last, end = int(first[i]), int(ends[i])
        for m in itertools.chain(marks[a[i] : b[i]].tolist(), [end]):
            while m - last > MOST:
                last += MOST
                cuts.append(np.array([last]))
            if m < end and m - last >= LEAST:
                last = m
                cuts.append(np.array([last]))
    return np.unique(np.concatenate(cuts))


def cut_points(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one document."""
    return cut_stream(ids, np.array([len(ids)])).tolist()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Binary tree over 32-byte leaves; an odd node moves up unchanged; no leaves: the digest of nothing."""
    level = [hashlib.blake2b(b"\0" + x, digest_size=32).digest() for x in leaves]
    while len(level) > 1:
        up = [hashlib.blake2b(b"\1" + a + b, digest_size=32).digest() for a, b in zip(level[0::2], level[1::2])]
        level = up + level[len(level) - len(level) % 2 :]
    return level[0] if level else hashlib.blake2b(b"", digest_size=32).digest()


def name_of(ids: np.ndarray) -> bytes:
    return hashlib.blake2b(ids.astype("<u4").tobytes(), digest_size=32).digest()


BLOCK = "kind string, digest binary, n_ids long, width int, data binary, doc_id {}, root binary, digests array<binary>, sizes array<long>"


def write_blocks(documents: DataFrame, tokenizer_path: str, end_id: int, path: str) -> None:
    """Tokenise once; chunk bytes meet by digest and are written once, document rows go with them without their bytes."""
    schema = BLOCK.format(documents.schema["doc_id"].dataType.simpleString())
    names = ["kind", "digest", "n_ids", "width", "data", "doc_id", "root", "digests", "sizes"]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # of this task, so a chunk leaves a task once; a task is bounded
        for batch in batches:
            for x, y in text_groups(batch.column("text")):
                doc_ids = batch.column("doc_id").slice(x, y - x)
                kinds = [pa.string(), pa.binary(), pa.int64(), pa.int32(), pa.binary(), doc_ids.type, pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64())]

                def rows(n: int, **given) -> pa.RecordBatch:
                    return pa.RecordBatch.from_arrays([given.get(c, pa.nulls(0 if c in given else n, t)) for c, t in zip(names, kinds)], names)

                found = encoder(tokenizer_path)
                own, size = found.encode_together(batch.column("text").slice(x, y - x))
                ends = np.cumsum(size + 1)
                ids = np.full(int(ends[-1]), end_id, np.uint32)
                body = np.ones(len(ids), bool)
                body[ends - 1] = False
                ids[body] = own
                cuts = cut_stream(ids, ends)
                begin = np.concatenate([[0], cuts[:-1]])
                whole = memoryview(ids.astype("<u4").tobytes())
                digests = [hashlib.blake2b(whole[4 * a : 4 * b], digest_size=32).digest() for a, b in zip(begin.tolist(), cuts.tolist())]
                new = np.array([not (d in seen or seen.add(d)) for d in digests], bool)
                width = 2 if max(end_id, len(found.ends) - 1) < 1 << 16 else 4
                packed = ids.astype(f"<u{width}").tobytes()
                for a in range(0, len(cuts), 2000):  # rows of about 2,000 ids each
                    keep = np.flatnonzero(new[a : a + 2000]) + a
                    data = pa.array([packed[width * b : width * c] for b, c in zip(begin[keep].tolist(), cuts[keep].tolist())], pa.binary())
                    n = len(keep)
                    yield rows(n, kind=pa.array(["chunk"] * n, pa.string()), digest=pa.array([digests[i] for i in keep.tolist()], pa.binary()), n_ids=pa.array(cuts[keep] - begin[keep]), width=pa.array(np.full(n, width, np.int32)), data=data)
                per_doc = np.searchsorted(cuts, ends, side="right")
                edge = np.concatenate([[0], per_doc]).tolist()
                roots = [merkle_root(digests[a:b]) for a, b in zip(edge, edge[1:])]
                offsets, n = pa.array(np.array(edge, np.int32)), len(ends)
                yield rows(
                    n, kind=pa.array(["doc"] * n, pa.string()), n_ids=pa.array(size + 1), doc_id=doc_ids, root=pa.array(roots, pa.binary()),
                    digests=pa.ListArray.from_arrays(offsets, pa.array(digests, pa.binary())), sizes=pa.ListArray.from_arrays(offsets, pa.array(cuts - begin)),
                )

    met = documents.select("doc_id", "text").mapInArrow(blocks, schema)
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # chunks meet by digest; documents are spread by doc_id too, so copies of one document don't
    met = met.repartition(parts, F.xxhash64("digest", "root", "doc_id")).sortWithinPartitions("kind", "digest")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            keep = []
            for d in batch.column("digest").to_pylist():
                keep.append(d is None or d != last)
                last = d
            yield batch.filter(pa.array(keep))

    met.mapInArrow(once, schema).write.option("compression", "lz4").parquet(f"{path}/blocks")


def shard_roots(leaves: DataFrame) -> DataFrame:
    """(shard, place, root) -> (shard, root): Merkle roots over ``FAN`` neighbours at a time, level by level."""

    def up(batch: pa.RecordBatch):
        out = [merkle_root([x["root"] for x in group]) for group in batch.column("group").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("place"), pa.array(out, pa.binary())], ["shard", "place", "root"])

    nodes = leaves.agg(F.max("place")).head()[0]
    while True:
        grouped = leaves.groupBy("shard", F.floor(F.col("place") / FAN).alias("place")).agg(F.array_sort(F.collect_list(F.struct("place", "root"))).alias("group"))
        leaves = map_arrow(grouped, up, "shard int, place long, root binary")
        nodes = (nodes or 0) // FAN
        if not nodes:
            return leaves.select("shard", "root")


def read_kind(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.parquet(f"{path}/blocks").where(F.col("kind") == kind)


def write_recipes(spark: SparkSession, path: str) -> None:
    """Shards of documents in ascending doc_id order with the number of ids before each, and the manifest.

    Documents are dealt by ranges of doc_id; sums per shard come first, and only those few rows are summed in order.
    """
    docs = read_kind(spark, path, "doc").select("doc_id", "n_ids", "root", "digests", "sizes")
    parts = scale_to_parts(docs.count(), SHARD_DOCS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = docs.repartitionByRange(parts, F.asc_nulls_first("doc_id"), "root").sortWithinPartitions(F.asc_nulls_first("doc_id"), "root")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = before = 0
        for batch in batches:
            n = batch.column("n_ids").to_numpy()
            sums = np.cumsum(n)
            yield batch.append_column("place", pa.array(np.arange(place, place + len(n)))).append_column("before", pa.array(before + sums - n))
            place, before = place + len(n), before + int(sums[-1]) if len(n) else before

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    numbered = dealt.withColumn("shard", F.spark_partition_id()).mapInArrow(number, f"{fields}, shard int, place long, before long")
    numbered.write.option("compression", "zstd").parquet(f"{path}/numbered")
    numbered = spark.read.parquet(f"{path}/numbered")

    sums = numbered.groupBy("shard").agg(F.count("*").alias("n_docs"), F.sum("n_ids").alias("n_ids"))
    shards = sums.join(shard_roots(numbered.select("shard", "place", "root")), "shard")
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # one row a shard
    shards.withColumn("start", F.coalesce(before, F.lit(0).cast("long"))).write.parquet(f"{path}/manifest")
    starts = spark.read.parquet(f"{path}/manifest").select("shard", F.col("start").alias("__start"))
    recipes = numbered.join(F.broadcast(starts), "shard").withColumn("start", F.col("__start") + F.col("before"))  # one row a shard
    recipes.drop("__start", "before").write.option("compression", "zstd").parquet(f"{path}/recipes")


def write_store(documents: DataFrame, tokenizer_path: str, end_id: int = END_ID, path: str | None = None) -> str:
    """Write a store and give its path, a new one in the shared folder unless named."""
    path = path or new_path(documents.sparkSession, "token-store")
    write_blocks(documents, tokenizer_path, end_id, path)
    write_recipes(documents.sparkSession, path)
    return path


def verified_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(digest, ids as little-endian 32-bit bytes, crc): every stored chunk, checked against its name."""

    def check(batch: pa.RecordBatch):
        out, crcs = [], []
        for digest, width, data in zip(*(batch.column(c).to_pylist() for c in ("digest", "width", "data"))):
            ids = np.frombuffer(data, f"<u{width}").astype("<u4")
            if name_of(ids) != digest:
                raise ValueError(f"chunk {digest.hex()} does not match its name")
            out.append(ids.tobytes())
            crcs.append(zlib.crc32(out[-1]))
        return pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(out, pa.binary()), pa.array(crcs, pa.int64())], ["digest", "ids", "crc"])

    return map_arrow(read_kind(spark, path, "chunk").select("digest", "width", "data"), check, "digest binary, ids binary, crc long")


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of polynomials modulo the CRC-32 polynomial, bit-reflected, elementwise."""
    out, b = np.zeros_like(a), b.copy()
    for i in range(31, -1, -1):
        out ^= np.where((a >> np.uint32(i)) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return out


def shift_crc(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What each CRC-32 adds to that of a whole in which ``n_bytes`` more bytes follow: all parts XORed give the whole's."""
    out = crc.astype(np.uint32)
    power = np.full(1, 1 << 23, np.uint32)  # x**8
    n = n_bytes.copy()
    while n.any():
        out = np.where(n & 1, _times(out, np.broadcast_to(power, out.shape)), out)
        power, n = _times(power, power), n >> 1
    return out


def verified_recipes(spark: SparkSession, path: str) -> DataFrame:
    """Recipes whose roots match their chunk digests and whose shards match the manifest; any difference fails the job."""

    def check(batch: pa.RecordBatch):
        for root, digests in zip(batch.column("root").to_pylist(), batch.column("digests").to_pylist()):
            if merkle_root(digests) != root:
                raise ValueError("a recipe does not match its Merkle root")
        return batch

    recipes = spark.read.parquet(f"{path}/recipes")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in recipes.schema.fields)
    found = shard_roots(recipes.select("shard", "place", "root")).withColumnRenamed("root", "found")
    differ = F.raise_error(F.lit("a shard does not match the manifest")).cast("boolean")
    good = spark.read.parquet(f"{path}/manifest").select("shard", "root").join(found, "shard", "left")
    good = good.select("shard", F.when(F.col("root") == F.col("found"), True).otherwise(differ).alias("good"))
    return map_arrow(recipes, check, fields).join(good, "shard").where("good").drop("good")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids array<long>): the documents again, from verified chunks and recipes."""
    parts = materialize(verified_recipes(spark, path).select("shard", "place", F.posexplode("digests").alias("pos", "digest")), "recipe-chunks")
    parts = join_salted(parts, verified_chunks(spark, path), ["digest"], ["shard", "place", "pos"])
    whole = parts.groupBy("shard", "place").agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("parts"))

    def join(batch: pa.RecordBatch):
        ids = [np.frombuffer(b"".join(p["ids"] for p in parts), "<u4").astype(np.int64) for parts in batch.column("parts").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("place"), pa.array(ids, pa.list_(pa.int64()))], ["shard", "place", "ids"])

    named = spark.read.parquet(f"{path}/recipes").select("shard", "place", "doc_id", "start", F.col("n_ids").alias("n_tokens"))
    return named.join(map_arrow(whole, join, "shard int, place long, ids array<long>"), ["shard", "place"]).drop("shard", "place")


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): read from the files; each chunk's bytes are read and checked once, where
    they lie, and only its CRC travels; CRCs of parts combine to that of the document."""
    recipes = verified_recipes(spark, path)

    def chunks_of(batch: pa.RecordBatch):
        """A row a chunk of every document, with the number of ids after it."""
        sizes, digests = batch.column("sizes"), batch.column("digests")
        counts = sizes.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = sizes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        total, ends = np.concatenate([[0], np.cumsum(flat)]), np.cumsum(counts)
        after = np.repeat(total[ends], counts) - total[1:]
        row = pa.array(np.repeat(np.arange(batch.num_rows), counts))
        return pa.RecordBatch.from_arrays([batch.column("shard").take(row), batch.column("place").take(row), digests.flatten(), pa.array(after)], ["shard", "place", "digest", "after"])

    parts = materialize(map_arrow(recipes.select("shard", "place", "digests", "sizes"), chunks_of, "shard int, place long, digest binary, after long"), "recipe-chunks")
    found = join_salted(parts, verified_chunks(spark, path).select("digest", "crc"), ["digest"], ["shard", "place", "after"], "left")

    def shift(batch: pa.RecordBatch):
        crc = batch.column("crc")
        if crc.null_count:
            raise ValueError("a recipe names a chunk that is not stored")
        moved = shift_crc(crc.to_numpy(), batch.column("after").to_numpy() * 4)
        return pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("place"), pa.array(moved.astype(np.int64))], ["shard", "place", "crc"])

    crcs = map_arrow(found.select("shard", "place", "after", "crc"), shift, "shard int, place long, crc long").groupBy("shard", "place").agg(F.expr("bit_xor(crc)").alias("ids_crc32"))
    named = spark.read.parquet(f"{path}/recipes").select("shard", "place", "doc_id", "start", F.col("n_ids").alias("n_tokens"))
    return named.join(crcs, ["shard", "place"]).drop("shard", "place")


def op6_token_store(spark, sf_dir: str) -> DataFrame:
    """Contract query: write the store of all documents, read it back."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = write_store(documents, public_tokenizers.path("word_bpe_49k.json"))
    return read_summaries(spark, path)
