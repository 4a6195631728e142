"""Target-distribution importance resampling with a dictionary of distinct features.

Features are runs of one and two consecutive words. They are counted as strings over all texts, each distinct string is
hashed to its bucket once, buckets are added up, and the gain of a bucket (log ratio of target to source) goes back to
the feature counts of each document by joins:

1. Texts are read in groups of about ``GROUP_BYTES`` and written as words by number, with the group's own list of words
   (``coded_groups``). All that follows starts from this table, so a group is the same in every step.
2. A group's distinct features, in the order of (slice of their hash, first word, second word), are its dictionary.
   Dictionaries travel by slices: slices of all groups meet, equal strings are counted together, and each distinct one is
   hashed. A slice gives its sums per bucket, and to each group the buckets of that group's strings, in the group's order
   (``count_slices``).
3. Sums make the 10,000 gains (``gain_table``). A group's buckets meet its documents' features by the group's number, and
   gains are added up (``weights``).

A group sends a string once however often it holds it, so a frequent feature has as many rows as there are groups.
Slices are as many as let one hold about ``SLICE_ROWS`` strings.

Definitions: A-Z alone are lower-cased; null texts have no words. The mean gain is floored, 0 without features. The draw
is a Gumbel top-k: score is weight plus noise of the document's id alone, so reruns agree. Null ids draw as the empty
string and stand last among equal scores. Repeated rows are documents of their own. Columns named like the results are replaced;
others pass through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import number_rows
from .common import materialize, mix64
from .decontamination import _IS_WORD, find_words

BUCKETS = 10_000
GROUP_BYTES = 8 << 20
SLICE_ROWS = 400_000
MIN_WORDS = 20
SHARE = (25, 100)
OWN = ["n_features", "weight", "score", "rank"]


_ZSTD = pa.Codec("zstd", compression_level=3)


def pack_strings(strings: pa.Array, counts: np.ndarray) -> bytes:
    """Strings without line feeds and their counts as one compressed value."""
    lines = pc.binary_join_element_wise(strings, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))  # a line feed after each
    joined = lines.buffers()[2].to_pybytes()[: pc.sum(pc.binary_length(lines)).as_py()]
    head = np.array([len(joined), len(counts)], "<i8").tobytes()
    raw = head + joined + counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def unpack_strings(data: bytes) -> tuple[pa.Array, np.ndarray]:
    raw = np.frombuffer(_ZSTD.decompress(data[8:], int.from_bytes(data[:8], "little")), np.uint8)
    size, n = raw[:16].view("<i8")
    joined, counts = raw[16 : 16 + size], raw[16 + size :].reshape(4, -1).T
    feed = joined == 10
    offsets = np.concatenate([[0], np.flatnonzero(feed) - np.arange(n)])
    strings = pa.LargeStringArray.from_buffers(int(n), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(joined[~feed]))
    return strings, np.ascontiguousarray(counts).view("<u4").ravel().astype(np.int64)


def distinct(x: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of x, all under ``top``, and the place of each element among them. Value and place share
    a 64-bit number where they fit, which sorts much faster than by reference."""
    bits = max(1, int(len(x)).bit_length())
    if top.bit_length() + bits > 63:
        return np.unique(x, return_inverse=True)
    packed = (x << bits) | np.arange(len(x))
    packed.sort()
    value, at = packed >> bits, packed & ((1 << bits) - 1)
    new = np.ones(len(x), bool)
    new[1:] = value[1:] != value[:-1]
    which = np.empty(len(x), np.int64)
    which[at] = np.cumsum(new) - 1
    return value[new], which


def pack_numbers(x: np.ndarray) -> bytes:
    """Numbers by their bytes, all low ones first, so that they compress where they are stored."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpack_numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def code_words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of a group, frequent ones first; all words in order by their number there; words of each text."""
    data, start, end, text = find_words(texts)
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=offsets[1:])
    words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data[_IS_WORD[data]]))
    coded = words.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(-np.bincount(code, minlength=len(coded.dictionary)), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), rank[code], np.bincount(text, minlength=len(texts))


class Group:
    """Features of a coded group: ``owner`` and ``which`` tell the text and the distinct feature of each occurrence; distinct
    features stand in the order of (slice, first word, second word)."""

    def __init__(self, names: pa.Array, code: np.ndarray, n_words: np.ndarray, slices: int) -> None:
        order = pc.array_sort_indices(names)
        self.names, many = names.take(order), len(order)
        rank = np.empty(many, np.int64)
        rank[order.to_numpy()] = np.arange(1, many + 1)  # 0 stands for no second word
        code = rank[code]
        hashes = np.fromiter((zlib.crc32(x) for x in self.names.cast(pa.large_binary()).to_pylist()), np.uint64, many)
        hashes = mix64(np.concatenate([np.zeros(1, np.uint64), hashes]) + np.uint64(1))
        text = np.repeat(np.arange(len(n_words)), n_words)
        paired = text[1:] == text[:-1]
        self.owner = np.concatenate([text, text[1:][paired]])
        wide = many + 1
        pairs, which = distinct(np.concatenate([code * wide, code[:-1][paired] * wide + code[1:][paired]]), wide * wide)
        a, b = pairs // wide, pairs % wide
        part = mix64(hashes[a] * np.uint64(0x9E3779B97F4A7C15) + hashes[b]) % np.uint64(slices)
        by_part = np.argsort(part.astype(np.uint16 if slices <= 1 << 16 else np.uint64), kind="stable")
        number = np.empty(len(by_part), np.int64)
        number[by_part] = np.arange(len(by_part))
        self.which = number[which]
        self.first, self.second, self.part = a[by_part], b[by_part], part[by_part].astype(np.int64)

    def dictionary(self) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
        """(slice, strings, counts) of the slices that have any."""
        counts = np.bincount(self.which, minlength=len(self.part))
        edges = np.append(np.flatnonzero(np.diff(self.part, prepend=-1)), len(self.part))
        for x, y in zip(edges[:-1], edges[1:]):
            a, b = self.first[x:y], self.second[x:y]
            heads, both = self.names.take(pa.array(a - 1)), b > 0
            tails = self.names.take(pa.array(np.where(both, b - 1, 0)))
            yield int(self.part[x]), pc.if_else(pa.array(both), pc.binary_join_element_wise(heads, tails, pa.scalar(" ", pa.large_string())), heads), counts[x:y]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Groups of rows of about ``GROUP_BYTES`` of text, one row at least."""
    for batch in batches:
        column, a, size, raw = batch.column("text"), 0, 0, []
        for i in range(batch.num_rows):
            b = (column[i].as_py() or "").encode("utf-8", "surrogatepass")
            if raw and size + len(b) > GROUP_BYTES:
                yield batch.slice(a, len(raw)), raw
                a, size, raw = i, 0, []
            raw.append(b)
            size += len(b)
        if raw:
            yield batch.slice(a, len(raw)), raw


def coded_groups(texts: DataFrame) -> DataFrame:
    """One row a group: (__group, __rows, __sizes, __names, __codes), ``__rows`` all columns but text as structs."""
    passed = [f for f in texts.schema.fields if f.name != "text"]
    kinds = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in passed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        for k, (batch, raw) in enumerate(_cut(batches)):
            names, code, n_words = code_words(raw)
            rows = pa.StructArray.from_arrays([batch.column(f.name) for f in passed], [f.name for f in passed]) if passed else pa.nulls(len(raw), pa.struct([]))
            blobs = [pack_numbers(n_words), pack_strings(names, np.zeros(len(names), np.int64)), pack_numbers(code)]
            yield pa.RecordBatch.from_arrays([pa.array([base + k]), pa.ListArray.from_arrays(pa.array([0, len(raw)], pa.int32()), rows), *(pa.array([x], pa.binary()) for x in blobs)], ["__group", "__rows", "__sizes", "__names", "__codes"])

    return texts.mapInArrow(run, f"__group long, __rows array<struct<{kinds}>>, __sizes binary, __names binary, __codes binary")


def read_group(sizes: bytes, names: bytes, codes: bytes, slices: int) -> Group:
    return Group(unpack_strings(names)[0], unpack_numbers(codes), unpack_numbers(sizes), slices)


def dictionaries(groups: DataFrame, side: int, slices: int) -> DataFrame:
    """(side, __group, __slice, __strings): distinct features of every group with their counts, by slices of their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, *blobs in zip(*(c.to_pylist() for c in batch.columns)):
                for part, strings, counts in read_group(*blobs, slices).dictionary():
                    yield pa.RecordBatch.from_arrays([pa.array([side], pa.int32()), pa.array([group], pa.int64()), pa.array([part], pa.int32()), pa.array([pack_strings(strings, counts)], pa.binary())], ["side", "__group", "__slice", "__strings"])

    return groups.select("__group", "__sizes", "__names", "__codes").mapInArrow(run, "side int, __group long, __slice int, __strings binary")


def count_slices(dictionaries: DataFrame) -> DataFrame:
    """(side, __slice, __group, __strings) -> rows of two kinds: (side, __sums), counts per bucket of a slice, and
    (__group, __slice, __buckets), the buckets of a group's strings in its own order. Each distinct string is hashed once."""

    def merge(key, table):
        sides, groups = table.column("side").to_pylist(), table.column("__group").to_pylist()
        parts = [unpack_strings(x.as_py()) for x in table.column("__strings")]
        strings = pa.chunked_array([s for s, _ in parts]).combine_chunks().dictionary_encode()
        which = strings.indices.to_numpy(zero_copy_only=False)
        bucket = np.fromiter((zlib.crc32(s) % BUCKETS for s in strings.dictionary.cast(pa.large_binary()).to_pylist()), np.int64, len(strings.dictionary))
        counts = np.concatenate([n for _, n in parts])
        edges = np.cumsum([0, *(len(n) for _, n in parts)])
        side = np.repeat(np.array(sides), np.diff(edges))
        rows: list[tuple] = []
        for s in sorted(set(sides)):
            per_string = np.zeros(len(bucket), np.int64)
            np.add.at(per_string, which[side == s], counts[side == s])  # the global count of each distinct string
            sums = np.zeros(BUCKETS, np.int64)
            np.add.at(sums, bucket, per_string)
            rows.append((s, None, None, zlib.compress(sums.astype("<i8").tobytes(), 1)))
        for i, s in enumerate(sides):
            if s == 0:
                rows.append((None, groups[i], key[0].as_py(), bucket[which[edges[i] : edges[i + 1]]].astype("<u2").tobytes()))
        return pa.table([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.int64(), pa.int32(), pa.binary()))], ["side", "__group", "__slice", "__data"])

    return dictionaries.groupBy("__slice").applyInArrow(merge, "side int, __group long, __slice int, __data binary")


def gain(s: Column, t: Column, all_s: Column, all_t: Column) -> Column:
    """floor(1000 * log ratio) of a bucket, add-one smoothed."""
    d = lambda c: c.cast("double")
    return F.floor(1000 * F.log((d(t) + 1) * (d(all_s) + BUCKETS) / ((d(s) + 1) * (d(all_t) + BUCKETS)))).cast("long")


def gain_table(sums: DataFrame) -> DataFrame:
    """(bucket, gain) of all buckets from (side, __data) rows of slices; 10,000 rows whatever the corpus."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for side, data in zip(batch.column("side").to_pylist(), batch.column("__data").to_pylist()):
                total[side] += np.frombuffer(zlib.decompress(data), "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(total[0]), pa.array(total[1])], ["bucket", "s", "t"])

    spark = sums.sparkSession
    added = sums.mapInArrow(spread, "bucket long, s long, t long").groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    every = spark.range(BUCKETS).withColumnRenamed("id", "bucket").join(added, "bucket", "left").fillna(0, ["s", "t"])
    whole = every.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    return every.join(F.broadcast(whole), how="cross").select("bucket", gain(F.col("s"), F.col("t"), F.col("all_s"), F.col("all_t")).alias("gain"))  # one row


def weights(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """All columns of ``documents`` but text, and n_words, n_features, weight (long)."""
    spark = documents.sparkSession
    size = documents.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (20 * SLICE_ROWS // 2)))  # a new string in 10 bytes or so
    kept = documents.drop(*OWN, "n_words")
    coded = materialize(coded_groups(kept if len(kept.columns) > 1 else kept.withColumn("__row", F.lit(0))), "coded-texts")
    wanted = dictionaries(coded_groups(targets.select("text", F.lit(0).alias("__row"))), 1, slices)
    met = dictionaries(coded, 0, slices).union(wanted).repartition(slices, "__slice")
    counted = materialize(count_slices(met), "buckets")
    table = gain_table(counted.where("side is not null").select("side", "__data")).orderBy("bucket").select("gain").toPandas()["gain"]  # 10,000 values
    gains = spark.sparkContext.broadcast(table.to_numpy(np.int64))
    passed = [f for f in kept.schema.fields if f.name != "text"]

    def score(key, left, right):
        order = pc.sort_indices(right.column("__slice"))
        gain_of = gains.value[np.frombuffer(b"".join(x.as_py() for x in right.column("__data").take(order)), "<u2")]
        sizes, names, codes = (left.column(c)[0].as_py() for c in ("__sizes", "__names", "__codes"))
        group, n_words = read_group(sizes, names, codes, slices), unpack_numbers(sizes)
        n = np.bincount(group.owner, minlength=len(n_words))
        total = np.bincount(group.owner, gain_of[group.which], minlength=len(n_words)).astype(np.int64)  # under 2**53: exact
        rows = left.column("__rows").combine_chunks().flatten()
        own = [rows.field(f.name) for f in passed]
        return pa.table([*own, pa.array(n_words), pa.array(n), pa.array(total // np.maximum(n, 1))], [f.name for f in passed] + ["n_words", "n_features", "weight"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in passed)
    buckets = counted.where("__group is not null").select("__group", "__slice", "__data")
    return coded.groupBy("__group").cogroup(buckets.groupBy("__group")).applyInArrow(score, f"{kinds}n_words long, n_features long, weight long")


def with_scores(weighted: DataFrame, seed: int = 7, key: str = "doc_id") -> DataFrame:
    """Add score: weight plus Gumbel noise drawn from sha256 of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return weighted.withColumn("score", F.col("weight") + noise.cast("long"))


def resample(documents: DataFrame, targets: DataFrame, share: tuple[int, int] = SHARE, min_words: int = MIN_WORDS, seed: int = 7, key: str = "doc_id") -> DataFrame:
    """Every document (all columns but text) with n_words, n_features, weight, score and its rank in the draw, null if not
    drawn: of the N documents with ``min_words`` words, floor(share * N) are drawn."""
    scored = materialize(with_scores(weights(documents, targets), seed, key), "scores")
    drawn = scored.where(F.col("n_words") >= min_words)
    n = drawn.count() * share[0] // share[1]
    ranked = number_rows(drawn, [F.col("score").desc(), F.col(key).asc_nulls_last()], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= n, F.col("rank")))
    return ranked.unionByName(scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")))


def op12_importance(spark, sf_dir: str) -> DataFrame:
    """Contract query: all documents against all benchmark texts."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return resample(documents, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", *OWN)


#: CRC-32 by bytes; its table follows from the reversed polynomial.
_CRC_SQL = "list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, 2 * strlen({0}), 2), lambda i: ('0x' || hex({0})[i : i + 1])::bigint)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))"
_WORDS_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE_SQL = {
    "op12_importance": f"""
with t as (select list(list_reduce(list_prepend(n::bigint, range(8)), lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end) order by n) as tab from range(256) as r(n)),
d as (select row_number() over () as rid, doc_id, {_WORDS_SQL} as w from documents),
df as (select rid, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as f from d),
b as (select {_WORDS_SQL} as w from benchmark),
bf as (select unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as f from b),
c as (select rid, f, count(*)::bigint as n from df group by rid, f),
g as (select f, sum(s)::bigint as s, sum(t)::bigint as t from (select f, n as s, 0 as t from c union all select f, 0, 1 from bf) group by f),
h as (select f, s, t, xor({_CRC_SQL.format("f")}, 4294967295) % 10000 as bucket from g, t),
k as (select bucket, sum(s)::double as s, sum(t)::double as t from h group by bucket),
n as (select sum(s) as all_s, sum(t) as all_t from k),
v as (select bucket, floor(1000 * ln((t + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000))))::bigint as gain from k, n),
m as (select rid, sum(n)::bigint as n_features, sum(n * gain)::bigint as total from c join h using (f) join v using (bucket) group by rid),
x as (select rid, doc_id, len(w) as n_words, coalesce(n_features, 0)::bigint as n_features,
    case when total is null then 0 else ((total - ((total % n_features) + n_features) % n_features) // n_features) end::bigint as weight from d left join m using (rid)),
y as (select *, weight + floor(-1000 * ln(-ln((('0x' || sha256('7:' || doc_id)[1:8])::bigint + 0.5) / 4294967296)))::bigint as score from x),
r as (select rid, row_number() over (order by score desc, doc_id) as rank, count(*) over () as n from y where n_words >= 20)
select doc_id, n_features, weight, score, case when rank <= 25 * n // 100 then rank end::bigint as rank from y left join r using (rid)"""
}
