"""Benchmark decontamination by winnowing.

Test items and documents are cut into the same windows of words. Of the k-grams of a window the one with the smallest
hash (the leftmost of equals) is its fingerprint, so equal windows have equal fingerprints at equal places: with
k + w - 1 = 13 every shared span of 13 words or more shares a fingerprint. Documents and items are joined on
fingerprints; each hit is then extended to the windows around it, which are compared by 128-bit digest of their words.

Definitions: words are runs of ASCII digits, ASCII letters (lower-cased) and all non-ASCII characters. Null texts have
no words. Items of fewer than 13 words are one window of their own length; items of none never occur. Repeated
document rows each get a row; repeated items count once per distinct item_id (null ids are dropped from lists).
Extra columns pass through the joins untouched because only named columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import POWERS, content_key, groups_of_bytes, join_salted, map_arrow, materialize, maybe_broadcast, mix64, prefix_hash, range_hash, small, spreadable

WINDOW_WORDS = 13
#: The contract's words, for native counting; A-Z are words in either case, so counting needs no lower-casing.
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = True
_IS_WORD[128:] = True


def gram_size(n: int) -> int:
    """k-gram length for windows of n words: half, rounded up, so w = n - k + 1 grams compete."""
    return (n + 1) // 2


def find_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts with a separator after each; start, end and text number of each word."""
    data = _LOWER[np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)]
    word = np.zeros(len(data) + 1, bool)
    word[1:] = _IS_WORD[data]
    change = np.flatnonzero(word[1:] != word[:-1])
    start, end = change[0::2], change[1::2]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return data, start, end, np.searchsorted(np.cumsum(lengths), start, side="right")


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return range_hash(prefix_hash(data), start, end)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words."""
    n = max(0, len(words) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= np.uint64(POWERS.BASE)
        out += words[j : j + n]
    return mix64(out)


def winnow(words: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window of n words inside one text: (first word, place of its fingerprint, fingerprint)."""
    k = gram_size(n)
    grams = gram_hashes(words, k)
    first = np.arange(max(0, len(words) - n + 1))
    first = first[text[first] == text[first + n - 1]]
    best, at = grams[first], first.copy()
    for j in range(1, n - k + 1):
        g = grams[first + j]
        less = g < best
        best[less] = g[less]
        at[less] = first[less] + j
    return first, at, best


def digest(data: np.ndarray, start: np.ndarray, end: np.ndarray, a: int, n: int) -> bytes:
    """128-bit digest of words a .. a+n-1, space-joined."""
    return hashlib.blake2b(b" ".join(data[start[i] : end[i]].tobytes() for i in range(a, a + n)), digest_size=16).digest()


def _lists(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def document_fingerprints(documents: DataFrame, lengths: list[int]) -> DataFrame:
    """(key, n, fp, at): the distinct selected fingerprints of each row's text for each window length."""

    def fingerprints(batch: pa.RecordBatch):
        keys = batch.column("key")
        for row, texts in groups_of_bytes(batch.column("text")):
            data, start, end, text = find_words(texts)
            words = word_hashes(data, start, end)
            first_word = np.searchsorted(text, np.arange(len(texts)))
            for n in lengths:
                _, at, fp = winnow(words, text, n)
                keep = np.ones(len(at), bool)
                keep[1:] = at[1:] != at[:-1]  # places never go down
                at, fp = at[keep], fp[keep]
                counts = np.bincount(text[at], minlength=len(texts))
                hits = pa.StructArray.from_arrays([pa.array(fp.view(np.int64)), pa.array((at - first_word[text[at]]).astype(np.int32))], ["fp", "at"])
                yield pa.RecordBatch.from_arrays([keys.slice(row, len(texts)), pa.array(np.full(len(texts), n, np.int32)), _lists(hits, counts)], ["key", "n", "hits"])

    keyed = documents.where("text is not null").select(content_key("text").alias("key"), "text")
    found = map_arrow(keyed, fingerprints, "key binary, n int, hits array<struct<fp:long,at:int>>")
    return found.select("key", "n", F.inline("hits"))


def item_windows(items: DataFrame) -> DataFrame:
    """(item_id, n, fp, window): every window of every item with its fingerprint and digest."""

    def windows(batch: pa.RecordBatch):
        ids = batch.column("item_id")
        for row, texts in groups_of_bytes(batch.column("text")):
            data, start, end, text = find_words(texts)
            words = word_hashes(data, start, end)
            count = np.bincount(text, minlength=len(texts))
            rows = []
            for n in np.unique(np.minimum(count[count > 0], WINDOW_WORDS)):
                first, _, fp = winnow(words, text, int(n))
                own = np.minimum(count[text[first]], WINDOW_WORDS) == n
                rows += [(int(text[f]), int(n), int(h), digest(data, start, end, int(f), int(n))) for f, h in zip(first[own], fp[own].view(np.int64))]
            which = pa.array([r[0] + row for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(which), *(pa.array([r[i] for r in rows], t) for i, t in ((1, pa.int32()), (2, pa.int64()), (3, pa.binary())))], ["item_id", "n", "fp", "window"])

    rows = items.where("text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    return map_arrow(rows, windows, "item_id string, n int, fp long, window binary")


def windows_at_hits(texts: DataFrame) -> DataFrame:
    """(key, text, hits) -> (key, n, a, window): digests of all windows around each hit that can hold it, each once."""

    def extend(batch: pa.RecordBatch):
        for key, text, hits in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), batch.column("hits").to_pylist()):
            data, start, end, _ = find_words([text.encode("utf-8", "surrogatepass")])
            around = {(a, h["n"]) for h in hits for a in range(max(0, h["at"] - (h["n"] - gram_size(h["n"]))), min(h["at"], len(start) - h["n"]) + 1)}
            a, n = [x[0] for x in around], [x[1] for x in around]
            windows = [digest(data, start, end, *x) for x in around]
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(a), pa.binary()), pa.array(n, pa.int32()), pa.array(a, pa.int32()), pa.array(windows, pa.binary())], ["key", "n", "a", "window"])

    return map_arrow(texts.select("key", "text", "hits"), extend, "key binary, n int, a int, window binary")


#: Bits of the filter that keeps texts without hits out of shuffles; 8 MB whatever the number of keys.
FILTER_BITS = 1 << 26


def _places(key: bytes) -> tuple[int, int, int]:
    """Three places in the filter from a digest."""
    return tuple(int.from_bytes(key[i : i + 4], "little") % FILTER_BITS for i in (0, 4, 8))


def maybe_in(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``keyed`` whose ``key`` may be among ``keys``: none that is goes missing, few others stay while the keys are
    under some ten million. A Bloom filter, put together from each task's own."""

    def mark(batches):
        bits = np.zeros(FILTER_BITS // 64, np.uint64)
        for batch in batches:
            at = np.array([p for k in batch.column("key").to_pylist() for p in _places(k)], np.int64)
            np.bitwise_or.at(bits, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        word = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits[word].view(np.int64))], ["word", "bits"])

    marked = keys.mapInArrow(mark, "word long, bits long").groupBy("word").agg(F.expr("bit_or(bits)").alias("bits")).toPandas()  # a row for each 64 bits at most
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    bits[marked["word"].to_numpy(np.int64)] = marked["bits"].to_numpy(np.int64).view(np.uint64)
    shared = keyed.sparkSession.sparkContext.broadcast(bits)

    def look(batch: pa.RecordBatch):
        at = np.array([_places(k) for k in batch.column("key").to_pylist()], np.int64)
        found = ((shared.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)
        return batch.filter(pa.array(found))

    return map_arrow(keyed.select("key", "text"), look, "key binary, text string")


def hit_words(spans: F.Column) -> F.Column:
    """Words covered by the spans (a, n), sorted by a."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("sum"))

    def step(s, x):
        end = F.greatest(s["end"], x["a"] + x["n"])
        return F.struct(end.alias("end"), (s["sum"] + end - F.greatest(s["end"], x["a"])).alias("sum"))

    return F.aggregate(spans, zero, step, lambda s: s["sum"])


def contamination(documents: DataFrame, items: DataFrame, broadcast_bytes: int = 8 << 20) -> DataFrame:
    """Per distinct text that holds a window of some item: (key, n_hit, items), items sorted as strings.

    Item windows are broadcast only if their counted rows fit ``broadcast_bytes``; otherwise the same joins shuffle, with
    frequent fingerprints and windows dealt out. Hits are a text's own, so only one row of it is extended, once for all its copies.
    """
    windows = materialize(item_windows(items), "item-windows")
    lengths = sorted({r["n"] for r in windows.select("n").distinct().limit(WINDOW_WORDS).collect()})  # 13 values at most
    spark = documents.sparkSession
    if not lengths:
        return spark.createDataFrame([], "key binary, n_hit long, items array<string>")

    def joined(left: DataFrame, right: DataFrame, on: list[str], row_bytes: int, spread: list[str]) -> DataFrame:
        few = maybe_broadcast(right, row_bytes, broadcast_bytes)
        return left.join(few, on) if few is not right else join_salted(materialize(left, "left-of-join"), right, on, spread)

    fps = document_fingerprints(documents, lengths)
    hits = joined(fps, windows.select("n", "fp").distinct(), ["n", "fp"], 16, ["key", "at"]).groupBy("key").agg(F.collect_set(F.struct("n", "at")).alias("hits"))
    hits = materialize(hits, "hits")
    # one row of each text with hits; the copies of a text leave a task as one row
    keyed, keys = documents.where("text is not null").select(content_key("text").alias("key"), "text"), hits.select("key")
    if (few := maybe_broadcast(keys, 32, broadcast_bytes)) is not keys:
        keyed = keyed.join(few, "key", "left_semi")
    else:
        keyed = maybe_in(keyed, keys)  # the join below settles it
    seen = windows_at_hits(keyed.groupBy("key").agg(F.first("text").alias("text")).join(hits, "key"))
    owners = windows.groupBy("n", "window").agg(F.collect_set("item_id").alias("ids"))
    met = materialize(joined(seen, windows.select("n", "window").distinct(), ["n", "window"], 48, ["key", "a"]), "window-hits")
    words = met.groupBy("key").agg(hit_words(F.array_sort(F.collect_list(F.struct("a", "n")))).alias("n_hit"))
    texts_of = met.select("key", "n", "window").distinct()
    own = join_salted(texts_of, owners, ["n", "window"], ["key"]).select("key", F.explode("ids").alias("item_id"))
    own = own.groupBy("key").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    return words.join(own, "key")


def judge(documents: DataFrame, items: DataFrame, min_share: tuple[int, int] = (1, 20)) -> DataFrame:
    """All columns of ``documents`` and n_words, n_hit, n_items, items_sha256, contaminated.

    Contaminated: n_hit > 0 and at least ``min_share`` of the words are hit. Input columns of these names are replaced.
    """
    own = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    found = materialize(contamination(documents, items), "contamination")
    few = small(found, (8 << 20) // 64)  # judged texts are named by 64 bytes each
    found = found.select(
        F.col("key").alias("__key"),
        F.col("n_hit").alias("__hit"),
        F.size("items").cast("long").alias("__n"),
        F.sha2(F.array_join("items", ","), 256).alias("__sha"),
    )
    counted = documents.drop(*own).withColumns(
        {"__key": content_key("text"), "n_words": F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORDS)).cast("long")}
    )
    n_hit, (part, whole) = F.coalesce("__hit", F.lit(0).cast("long")), min_share
    judged = counted.join(F.broadcast(found), "__key", "left") if few else join_salted(counted, found, ["__key"], spreadable(counted, ("text",)), "left")
    return (
        judged
        .withColumns(
            {
                "n_hit": n_hit,
                "n_items": F.coalesce("__n", F.lit(0).cast("long")),
                "items_sha256": F.coalesce("__sha", F.lit(hashlib.sha256(b"").hexdigest())),
                "contaminated": (n_hit > 0) & (whole * n_hit >= part * F.col("n_words")),
            }
        )
        .drop("__key", "__hit", "__n", "__sha")
    )


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    """Contract query: every document against every benchmark item."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return judge(documents, items).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_WORDS_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE_SQL = {
    "op1_decontamination": f"""
with i as (select item_id::varchar as item_id, {_WORDS_SQL} as w from benchmark),
iw as (select distinct item_id, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda a: array_to_string(w[a : a + 12], ' '))) as win, least(len(w), 13) as n from i where len(w) > 0),
win as (select win, n, list(item_id) as items from iw group by win, n),
d as (select row_number() over () as rid, doc_id, {_WORDS_SQL} as w from documents),
dw as (select rid, n, a, array_to_string(w[a : a + n - 1], ' ') as win from (select rid, w, n, unnest(range(1, len(w) - n + 2)) as a from d, (select distinct n from win))),
hit as (select rid, a, dw.n, items from dw join win on dw.win = win.win and dw.n = win.n),
words as (select rid, count(distinct x) as n_hit from (select rid, unnest(range(a, a + n)) as x from hit) group by rid),
own as (select rid, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items from (select distinct rid, unnest(items) as item_id from hit) group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated from d left join words using (rid) left join own using (rid)"""
}
