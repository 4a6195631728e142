"""Exact removal of repeated byte strings by column-wise construction of a collection's BWT and common prefixes.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in the same document or another.

Inserting one symbol per document and round needs as many rounds as the longest document has bytes, each over the whole
collection. Strings of a bounded length need less: windows that are proved to occur once leave first, the rest stand in
aligned pieces, so rounds are bounded by the length searched for.

1. Anchors. In every window of ``length`` bytes the ``gram`` bytes of smallest hash are its anchor, the leftmost of
   equals. Equal windows have equal anchors at equal places, so windows of an anchor that occurs once are unique. That is
   all that anchors decide. A piece is a longest run of windows with one anchor.
2. One copy of each distinct piece of the other anchors is fetched; one that occurs more than once enters the collection
   twice, which shows as much as all its copies would.
3. Pieces are dealt by anchor and stand aligned on it: equal windows of an anchor start in the same column. From the last
   column to the first each round inserts one symbol of every piece: the order of the suffixes that start in this
   column follows from that of the next column by a stable distribution on the inserted symbol, which lists the BWT of
   the collection column by column; the common prefix of neighbours is one more than the least one between them before, or none
   where symbols differ. Symbols, order and prefixes live in sequential files of the task. Neighbours with a common
   prefix of ``length`` or more are repeated windows; nothing else makes a window count as repeated.
4. Windows are carried back to all copies of their piece and merged into spans of each text.

An anchor with more than ``HOT`` distinct pieces would be too much for a task. Its windows get longer anchors: those that
reach half of the missing bytes to its left take these bytes in, the others reach the rest to its right and take that.
The missing bytes halve each time, so after log2(length) times an anchor is the whole window and has one distinct piece.

Definitions: null texts are empty. Copies of a text are stored once with their number, which counts as occurrences.
Repeated rows count as occurrences and get a row each; texts under ``length`` bytes never change. Only doc_id and text
are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import content_key, join_salted, map_arrow, materialize, maybe_broadcast, new_path, prefix_hash, range_hash, scale_to_parts, sliding_min

LENGTH = 400
GRAM = 128
#: Distinct pieces of an anchor that one task compares; anchors with more are lengthened.
HOT = 20_000
#: A key with over 1/SHARE of all documents (at most SHARE are) is joined by broadcast.
SHARE = 2000
#: Bytes of text hashed at once, under 2**PLACE_BITS; longer texts are cut so that each window is seen once.
SEGMENT = 1 << 20
PLACE_BITS = 22
#: Pieces that one construction holds, about, and pieces of a partition.
BLOCK_PIECES = 20_000
_LOW = np.uint64((1 << PLACE_BITS) - 1)


def find_anchors(data: np.ndarray, text: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Over bytes with the number of their text: (first byte, windows, anchor byte, anchor hash) of each piece."""
    n = len(data)
    if n < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    prefix = prefix_hash(data)
    start = np.arange(n - gram + 1)
    hashes = range_hash(prefix, start, start + gram)
    low = sliding_min((hashes & ~_LOW) | start.astype(np.uint64), length - gram + 1)
    window = np.flatnonzero(text[: n - length + 1] == text[length - 1 :])
    at = (low[window] & _LOW).astype(np.int64)
    change = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else at
    count = np.diff(np.append(change, len(at)))
    return window[change], count, at[change], hashes[at[change]]


def pieces_of(texts: list[bytes], length: int, gram: int) -> Iterator[tuple[int, np.ndarray, list[bytes]]]:
    """For each text with windows: (text, rows of (off, n, rel, hash as int64), digests), segment by segment."""

    def solve(parts: list[tuple[int, int, bytes]]):
        data = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
        sizes = np.array([len(p[2]) for p in parts])
        base = np.cumsum(sizes) - sizes
        off, n, at, h = find_anchors(data, np.repeat(np.arange(len(parts)), sizes), length, gram)
        owner = np.searchsorted(base, off, side="right") - 1
        view = data.tobytes()
        rel = at - off
        digests = [hashlib.blake2b(view[a : a + m + length - 1] + r.to_bytes(4, "little"), digest_size=16).digest() for a, m, r in zip(off.tolist(), n.tolist(), rel.tolist())]
        cut = np.searchsorted(owner, np.arange(len(parts) + 1))
        for i, (number, begin, _) in enumerate(parts):
            a, b = cut[i], cut[i + 1]
            if a < b:
                yield number, np.stack([off[a:b] - base[i] + begin, n[a:b], rel[a:b], h[a:b].view(np.int64)]), digests[a:b]

    held, size = [], 0
    for number, text in enumerate(texts):
        for begin in range(0, max(0, len(text) - length + 1), SEGMENT):
            part = text[begin : begin + SEGMENT + length - 1]
            if held and size + len(part) > SEGMENT:
                yield from solve(held)
                held, size = [], 0
            held.append((number, begin, part))
            size += len(part)
    if held:
        yield from solve(held)


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


ANCHORED = "k1 long, k2 long, text binary, copies long, anchors array<struct<h:long,p1:long,p2:long,off:long,n:int,rel:int>>"


def anchored_texts(documents: DataFrame, length: int, gram: int) -> DataFrame:
    """(k1, k2, text, copies, anchors): each distinct text of ``length`` bytes or more with its pieces.

    Written as a table bucketed by content key, so that later joins on the key move neither texts nor anchors again.
    Copies leave a task as a number, so a hot text moves once for each task, not for each copy.
    """

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}  # of this task, a bounded part of the input
        for batch in batches:
            new: dict[bytes, bytes] = {}
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                seen[key] = seen.get(key, 0) + 1
                if seen[key] == 1:
                    new[key] = text
            texts, keys = list(new.values()), list(new)
            found: list[list] = [[] for _ in texts]
            for number, rows, digests in pieces_of(texts, length, gram):
                p1, p2 = _halves(digests)
                found[number].append((rows[3], p1, p2, rows[0], rows[1], rows[2]))
            for a in range(0, len(texts), 500):
                part = [x for f in found[a : a + 500] for x in f]
                counts = [sum(len(x[0]) for x in f) for f in found[a : a + 500]]
                flat = [np.concatenate(c) if part else np.zeros(0, np.int64) for c in zip(*part)] or [np.zeros(0, np.int64)] * 6
                kinds = [np.int64] * 4 + [np.int32] * 2
                anchors = pa.StructArray.from_arrays([pa.array(c.astype(k)) for c, k in zip(flat, kinds)], ["h", "p1", "p2", "off", "n", "rel"])
                k1, k2 = _halves(keys[a : a + 500])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), anchors)
                yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(texts[a : a + 500], pa.binary()), pa.array(np.ones(len(counts), np.int64)), lists], ["k1", "k2", "text", "copies", "anchors"])
        more = {k: n - 1 for k, n in seen.items() if n > 1}
        if more:
            k1, k2 = _halves(list(more))
            none = pa.nulls(len(more), pa.list_(pa.struct([("h", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64()), ("off", pa.int64()), ("n", pa.int32()), ("rel", pa.int32())])))
            yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.nulls(len(more), pa.binary()), pa.array(list(more.values()), pa.int64()), none], ["k1", "k2", "text", "copies", "anchors"])

    spark = documents.sparkSession
    long_texts = documents.where(F.octet_length("text") >= length).select(content_key("text").alias("key"), F.col("text").cast("binary").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = long_texts.mapInArrow(compute, ANCHORED).repartition(parts, "k1", "k2")
    made = dealt.groupBy("k1", "k2").agg(F.first("text", True).alias("text"), F.sum("copies").alias("copies"), F.first("anchors", True).alias("anchors"))
    name = f"anchored_{uuid.uuid4().hex}"
    made.write.bucketBy(parts, "k1", "k2").option("compression", "zstd").option("path", new_path(spark, name)).saveAsTable(name)
    return spark.table(name)


def repeated_columns(pieces: list[bytes], rel: np.ndarray, length: int, folder: str | None = None) -> np.ndarray:
    """For aligned pieces: flags (piece, start of a window relative to the piece) of windows that another piece has.

    rel is where the anchor starts in each piece. ``length`` symbols from the anchor on and what lies before it are the
    columns. All state is in sequential files: symbols column by column, order and prefixes of the last column.
    """
    m = len(pieces)
    left, sizes = int(rel.max()), np.fromiter(map(len, pieces), np.int64, m)
    width = left + int((sizes - rel).max())
    flags = np.zeros((m, int((sizes - length + 1).max())), bool)
    with tempfile.TemporaryFile(dir=folder) as symbols, tempfile.TemporaryFile(dir=folder) as state:
        columns = np.zeros((width, m), np.uint16)  # 0: the piece has no symbol here
        for i, (piece, r) in enumerate(zip(pieces, rel.tolist())):
            columns[left - r : left - r + len(piece), i] = np.frombuffer(piece, np.uint8) + np.uint16(1)
        columns.tofile(symbols)
        del columns
        np.arange(m, dtype=np.int32).tofile(state)
        np.zeros(m, np.int16).tofile(state)  # common prefix with the one before
        for c in range(width - 1, -1, -1):
            symbols.seek(2 * m * c)
            column = np.fromfile(symbols, np.uint16, m)
            state.seek(0)
            order, common = np.fromfile(state, np.int32, m), np.fromfile(state, np.int16, m)
            inserted = column[order]  # the BWT of the next column's suffixes
            old = np.argsort(inserted, kind="stable")
            order, symbol = order[old], inserted[old]
            fresh = np.zeros(m, np.int16)
            same = np.flatnonzero((symbol[1:] == symbol[:-1]) & (symbol[1:] > 0)) + 1
            fresh[same] = np.minimum(_range_min(common, old[same - 1] + 1, old[same]) + 1, length)
            state.seek(0)
            order.tofile(state)
            fresh.tofile(state)
            state.flush()
            whole = np.flatnonzero(fresh >= length)
            for p in (order[whole], order[whole - 1]):
                flags[p, c - left + rel[p]] = True
    return flags


def _range_min(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min(x[a..b]), both ends included, from minima of runs of powers of two; levels no range needs are not made."""
    out = np.empty(len(a), x.dtype)
    if not len(a):
        return out
    level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
    table, size = x, 1
    for k in range(int(level.max()) + 1):
        now = np.flatnonzero(level == k)
        out[now] = np.minimum(table[a[now]], table[b[now] - size + 1])
        if k < level.max():
            table, size = np.minimum(table[:-size], table[size:]), 2 * size
    return out


def _runs(flags: np.ndarray) -> list[list[dict]]:
    """Runs of flagged window starts of each row: a to b, b excluded."""
    edge = np.zeros((len(flags), flags.shape[1] + 2), np.int8)
    edge[:, 1:-1] = flags
    change = np.diff(edge, axis=1)
    rows, at = np.nonzero(change)
    out: list[list[dict]] = [[] for _ in range(len(flags))]
    for r, a, b in zip(rows[0::2].tolist(), at[0::2].tolist(), at[1::2].tolist()):
        out[r].append({"a": a, "b": b})
    return out


SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def compare_pieces(pieces: DataFrame, n: int, length: int) -> DataFrame:
    """(h, p1, p2, rel, twice, piece) of distinct pieces -> (p1, p2, spans): windows that occur again."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def done(table: pa.Table):
            if table.num_rows:
                times = 1 + table.column("twice").to_numpy(zero_copy_only=False).astype(np.int64)
                which = np.repeat(np.arange(table.num_rows), times)
                pieces = table.column("piece").to_pylist()
                rel = table.column("rel").to_numpy().astype(np.int64)
                flags = repeated_columns([pieces[i] for i in which.tolist()], rel[which], length)[np.cumsum(times) - times]
                some = np.flatnonzero(flags.any(axis=1))
                kept = table.select(["p1", "p2"]).take(pa.array(some)).combine_chunks()
                spans = pa.array(_runs(flags[some]), SPANS)
                yield from kept.append_column("spans", spans).to_batches()

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= BLOCK_PIECES:
                table = pa.Table.from_batches(held)
                h = table.column("h").to_numpy()
                whole = int(np.searchsorted(h, h[-1]))  # all but the last anchor, which may go on
                if whole:
                    yield from done(table.slice(0, whole))
                    held, rows = table.slice(whole).to_batches(), table.num_rows - whole
        if held:
            yield from done(pa.Table.from_batches(held))

    parts = max(scale_to_parts(n, BLOCK_PIECES), int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = pieces.select("h", "p1", "p2", "rel", "twice", "piece").repartition(parts, "h").sortWithinPartitions("h")
    return dealt.mapInArrow(solve, "p1 long, p2 long, spans array<struct<a:int,b:int>>")


def _with_text(texts: DataFrame, wanted: DataFrame, columns: list[str]) -> DataFrame:
    """(k1, k2, text, wanted): texts with the structs that are wanted of them; texts stay where they are."""
    lists = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct(*columns)).alias("wanted"))
    return texts.select("k1", "k2", "text").join(lists.hint("shuffle_hash"), ["k1", "k2"])


ROWS = {"h": pa.int64(), "p1": pa.int64(), "p2": pa.int64(), "off": pa.int64(), "n": pa.int32(), "rel": pa.int32(), "gram": pa.int32()}


def lengthen(texts: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """The windows of ``rows`` again, in pieces of longer anchors."""

    def split(batch: pa.RecordBatch):
        out: list[tuple] = []
        for k1, k2, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "text", "wanted"))):
            for w in wanted:
                missing, at = length - w["gram"], w["off"] + w["rel"]
                half = -(-missing // 2)
                left = max(0, min(w["n"], w["rel"] - half + 1))  # windows that begin half or more before the anchor
                for first, n, begin, gram in ((0, left, at - half, w["gram"] + half), (left, w["n"] - left, at, w["gram"] + missing - half + 1)):
                    if n > 0:
                        off, gram = w["off"] + first, min(gram, length)
                        name = hashlib.blake2b(text[begin : begin + gram] + gram.to_bytes(4, "little"), digest_size=8).digest()
                        rel = begin - off
                        piece = hashlib.blake2b(text[off : off + n + length - 1] + rel.to_bytes(4, "little"), digest_size=16).digest()
                        p = [int.from_bytes(x, "little", signed=True) for x in (name, piece[:8], piece[8:])]
                        out.append((k1, k2, w["weight"], *p, off, n, rel, gram))
        kinds = {"k1": pa.int64(), "k2": pa.int64(), "weight": pa.int32()} | ROWS
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds.values())], list(kinds))

    found = _with_text(texts, rows, ["off", "n", "rel", "gram", "weight"])
    return map_arrow(found, split, "k1 long, k2 long, weight int, h long, p1 long, p2 long, off long, n int, rel int, gram int")


def met_pieces(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose anchor occurs again, their distinct pieces with the number of occurrences and one place of each)."""
    counts = materialize(rows.groupBy("h").agg(F.sum("weight").alias("c"), F.count("*").alias("__c")).where("c > 1").drop("c"), "repeated-anchors")
    met = materialize(join_salted(rows, counts.select("h"), ["h"], ["k1", "k2", "off"], counts=counts), "met-pieces")
    place = F.struct("k1", "k2", "off", "n", "rel", "gram")
    pieces = met.groupBy("h", "p1", "p2").agg((F.sum("weight") > 1).alias("twice"), F.first(place).alias("place"))
    return met, materialize(pieces.select("h", "p1", "p2", "twice", "place.*"), "distinct-pieces")


def repeated_spans(texts: DataFrame, length: int, gram: int, hot: int = HOT) -> DataFrame:
    """(k1, k2, spans): starts of repeated windows of each text that ``anchored_texts`` holds, as runs a to b."""
    weight = F.least("copies", F.lit(2)).cast("int").alias("weight")
    rows = texts.select("k1", "k2", weight, F.inline("anchors")).withColumn("gram", F.lit(gram))
    starts = None
    while True:
        met, pieces = met_pieces(rows)
        large = pieces.groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") > hot).select("h")
        large = materialize(large, "large-anchors")
        last = large.isEmpty()
        if not last:
            large = maybe_broadcast(large, 16)
            rows = materialize(lengthen(texts, met.join(large, "h", "left_semi"), length), "longer-anchors")
            met, pieces = met.join(large, "h", "left_anti"), pieces.join(large, "h", "left_anti")
        spans = found_spans(texts, met, pieces, length)
        starts = spans if starts is None else starts.unionByName(spans)
        if last:
            return starts.groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("spans"))


def found_spans(texts: DataFrame, met: DataFrame, pieces: DataFrame, length: int) -> DataFrame:
    """(k1, k2, a, b): runs of repeated windows of all rows, by the construction over their distinct pieces."""

    def fetch(batch: pa.RecordBatch):
        for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist()):
            kinds = {"h": pa.int64(), "p1": pa.int64(), "p2": pa.int64(), "rel": pa.int32(), "twice": pa.bool_()}
            cols = [pa.array([w[c] for w in wanted], t) for c, t in kinds.items()]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([text[w["off"] : w["off"] + w["n"] + length - 1] for w in wanted], pa.binary())], [*kinds, "piece"])

    source = _with_text(texts, pieces, ["h", "p1", "p2", "off", "n", "rel", "twice"]).select("text", "wanted")
    fetched = map_arrow(source, fetch, "h long, p1 long, p2 long, rel int, twice boolean, piece binary")
    found = materialize(compare_pieces(fetched, pieces.count(), length), "repeated-pieces")
    again = join_salted(met.select("k1", "k2", "off", "p1", "p2"), found, ["p1", "p2"], ["k1", "k2", "off"])
    again = again.select("k1", "k2", "off", F.inline("spans"))
    return again.select("k1", "k2", (F.col("off") + F.col("a")).alias("a"), (F.col("off") + F.col("b")).alias("b"))


def cut_texts(texts: DataFrame, spans: DataFrame, length: int) -> DataFrame:
    """(k1, k2, kept, removed): what is left of each text with spans, and the removed runs as byte ranges [a, b)."""

    def cut(batch: pa.RecordBatch):
        k1, k2, kept, removed = [], [], [], []
        for x1, x2, text, spans in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "text", "spans"))):
            runs: list[dict] = []
            for s in spans:
                a, b = s["a"], s["b"] + length - 1
                if runs and a <= runs[-1]["b"]:
                    runs[-1]["b"] = max(b, runs[-1]["b"])
                else:
                    runs.append({"a": a, "b": b})
            ends = [0] + [r["b"] for r in runs]
            kept.append(b"".join(text[x:y] for x, y in zip(ends, [r["a"] for r in runs] + [len(text)])))
            removed.append(runs)
            k1.append(x1)
            k2.append(x2)
        kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        return pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(kept, pa.binary()), pa.array(removed, kind)], ["k1", "k2", "kept", "removed"])

    joined = texts.select("k1", "k2", "text").join(spans.hint("shuffle_hash"), ["k1", "k2"])
    return map_arrow(joined, cut, "k1 long, k2 long, kept binary, removed array<struct<a:long,b:long>>")


def key_halves(text: str = "text") -> dict[str, F.Column]:
    """The content key as two longs, as ``anchored_texts`` has them: little-endian halves of the digest."""
    hexed = F.md5(F.coalesce(text, F.lit("")))

    def half(first: int) -> F.Column:
        swapped = F.concat(*(F.substring(hexed, first + 2 * i, 2) for i in range(7, -1, -1)))
        high = F.conv(F.substring(swapped, 1, 8), 16, 10).cast("long")
        low = F.conv(F.substring(swapped, 9, 8), 16, 10).cast("long")
        return F.shiftleft(high, 32).bitwiseOR(low)

    return {"k1": half(1), "k2": half(17)}


def removals(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(k1, k2, kept, removed) of each distinct text that loses bytes; ``key_halves`` names the texts of documents."""
    texts = anchored_texts(documents, length, min(gram, length))
    return cut_texts(texts, repeated_spans(texts, length, min(gram, length), hot), length)


def dedup(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, removed, kept) of every row: the removed runs as byte ranges [a, b) and the bytes that are left.

    Rows find their text by content key where it lies. A text with copies loses all its bytes, so of the at most
    ``SHARE`` texts with very many copies only the ranges are broadcast.
    """
    texts = anchored_texts(documents, length, min(gram, length))
    cut = materialize(cut_texts(texts, repeated_spans(texts, length, min(gram, length), hot), length), "cut-texts")
    short = F.coalesce(F.octet_length("text"), F.lit(0)) < length
    own = documents.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), *(c.alias(k) for k, c in key_halves().items()), F.when(short, F.coalesce("text", F.lit("")).cast("binary")).alias("kept"))
    own = materialize(own, "document-keys")
    none = F.array().cast(cut.schema["removed"].dataType)
    out = own.where("kept is not null").select("doc_id", "n_bytes", none.alias("removed"), "kept")
    rows = own.where("kept is null").drop("kept")
    many = max(200, rows.count() // SHARE)
    hot_texts = materialize(texts.where(F.col("copies") > many).select("k1", "k2").join(cut.select("k1", "k2", "removed"), ["k1", "k2"]), "hot-texts")
    if not hot_texts.isEmpty():
        hot_texts = F.broadcast(hot_texts)
        out = out.union(rows.join(hot_texts, ["k1", "k2"]).select("doc_id", "n_bytes", "removed", F.lit(b"").alias("kept")))
        rows = rows.join(hot_texts, ["k1", "k2"], "left_anti")
    told = texts.select("k1", "k2", "text").join(cut, ["k1", "k2"], "left").select("k1", "k2", F.coalesce("removed", none).alias("removed"), F.coalesce("kept", "text").alias("kept"))
    return out.union(rows.join(told, ["k1", "k2"]).select("doc_id", "n_bytes", "removed", "kept"))


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query: what repeated strings of 400 bytes leave of every document.

    text is what is kept, with U+FFFD for characters that are cut in two.
    """
    cut = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda s, r: s + r["b"] - r["a"])
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), text.alias("text"))
