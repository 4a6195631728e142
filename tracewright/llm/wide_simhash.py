"""SimHash near-duplicates by shingle similarity: a wide fingerprint, blocks of its bits, Hamming distance.

64 bits can't tell a similarity of 0.8 from one of 0.6, and pigeonhole keys that bear the 12 bits in which such pairs differ are too
short to join on. So the fingerprint has ``WIDTH`` bits. Two sets of shingles of Jaccard similarity s have a cosine of 2s / (1 + s)
at least, and each bit of theirs differs with a chance of acos(cosine) / pi at most, 0.151 at s = 0.8:

* blocks of w bits, cut from fixed permutations of the positions, are as many as let a pair of similarity s share one of them
  with a chance of ``RECALL``; w follows the number of distinct fingerprints, so that a chance key holds a few of them;
* fingerprints that share a block are compared by 128 of their bits where they meet, which chance pairs don't pass; what chains of
  close ones connect under one key is a group, of which only the members leave the task, a row each;
* members of a group are compared by all bits. Pairs clearly within the distance of similarity s are links at once; pairs about
  that distance (two and a half standard deviations to both sides) are links if their sets of shingles have that similarity, which
  is looked up only where no chain of sure links, under any key, joins them already.

Every two members of a group are compared, whatever its size, unless links join them already; a task returns one row per member at
most, which names whom it is joined to. A key with more than ``hot_key`` fingerprints is dealt out as pairs of chunks, and so is a
group whose sets of shingles are too long for one task.

Definitions: words and shingles are those of ``simhash`` with five words and without repeats. A text without words (null, empty) has
fingerprint zero. Equal fingerprints are one node, copies are never paired. Rows with a null doc_id take no part.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, groups_of_bytes, join_salted, map_arrow, materialize, maybe_broadcast, mix64, scale_to_parts
from .simhash import HOT_KEY, shingle_hashes

WIDTH = 1024
#: Chance that a pair just similar enough shares a block.
RECALL = 0.97
LONG_RUN = 48
#: Shingles of a group's sets that a task compares at once with as many others.
SET_CHUNK = 2_000_000
#: One constant per 64 bits of the fingerprint, from a fixed rule.
WORD_SEEDS = mix64(np.arange(1, WIDTH // 64 + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def bit_rate(similarity: float) -> float:
    """Chance at most that a bit differs between two sets of this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def limit_of(similarity: float, bits: int, deviations: float) -> int:
    """Differing bits that a pair of this similarity has at most, but for chances beyond so many standard deviations."""
    r = bit_rate(similarity)
    return math.floor(bits * r + deviations * math.sqrt(bits * r * (1 - r)))


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """Bit j is set if over half of the distinct hashes set it; each hash gives ``WIDTH`` bits by mixing with constants."""
    hashes = np.unique(hashes)
    ones = np.zeros(WIDTH, np.int64)
    for a in range(0, len(hashes), 255):  # 255 rows are summed in bytes
        words = mix64(hashes[a : a + 255, None] ^ WORD_SEEDS).astype("<u8", copy=False)
        ones += np.add.reduce(np.unpackbits(words.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").tobytes()


def with_wide_fingerprint(documents: DataFrame, shingle: int = 5) -> DataFrame:
    """(doc_id, fp binary) of each row."""

    def compute(batch: pa.RecordBatch):
        fps = [wide_fingerprint(np.array(shingle_hashes(t, shingle), np.uint64)) for _, texts in groups_of_bytes(batch.column("text")) for t in texts]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.binary())], ["doc_id", "fp"])

    return map_arrow(documents.select("doc_id", "text"), compute, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, fp binary")


def block_positions(n: int, similarity: float, recall: float = RECALL) -> np.ndarray:
    """Positions of the bits of each block (blocks x w) for n fingerprints."""
    w = min(max(math.ceil(math.log2(n + 1)) - 2, 8), 40)
    blocks = math.ceil(math.log(1 - recall) / math.log(1 - (1 - bit_rate(similarity)) ** w))
    a_cut, rng, out = WIDTH // w, np.random.default_rng(1024), []
    while len(out) < blocks:
        out.extend(rng.permutation(WIDTH)[: a_cut * w].reshape(a_cut, w))
    return np.array(out[:blocks])


def block_rows(nodes: DataFrame, positions: np.ndarray) -> DataFrame:
    """(key, node, s, u): a row for each fingerprint and block; s and u are 128 bits of the fingerprint."""
    blocks, w = positions.shape
    weights = 1 << np.arange(w, dtype=np.int64)

    def compute(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a in range(0, batch.num_rows, 512):
            part = batch.slice(a, 512)
            raw = np.frombuffer(b"".join(part.column("fp").to_pylist()), np.uint8).reshape(part.num_rows, -1)
            bits = np.unpackbits(raw, axis=1, bitorder="little")
            keys = np.empty((part.num_rows, blocks), np.int64)
            for t in range(blocks):
                keys[:, t] = (bits[:, positions[t]] @ weights) * blocks + t
            sketch = np.ascontiguousarray(raw[:, :16]).view("<i8")
            cols = [keys.ravel(), *(np.repeat(x, blocks) for x in (part.column("node").to_numpy(), sketch[:, 0], sketch[:, 1]))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "node", "s", "u"])

    return map_arrow(nodes.select("node", "fp"), compute, "key long, node long, s long, u long")


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def forest(sketch: np.ndarray, limit: int) -> list[tuple[int, np.ndarray]]:
    """(row, rows linked to it): a search that visits each row once and connects what chains within the limit connect."""
    left, out = np.arange(len(sketch)), []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = _distance(sketch[left], sketch[x]) <= limit
            if near.any():
                out.append((x, left[near]))
                todo.extend(left[near])
                left = left[~near]
    return out


def pairs_of_runs(group: np.ndarray, sketch: np.ndarray, limits: tuple[int, int], long_run: int = LONG_RUN) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of close rows with equal ``group`` (sorted): all pairs of short runs, forests of long ones. Chains of both connect the
    same rows; links of a forest say no more, so rows they connect are compared again."""
    cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    size = np.diff(cut)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in np.flatnonzero(size > long_run):
        for limit in limits:
            for x, found in forest(sketch[cut[i] : cut[i + 1]], limit):
                a.append(np.full(len(found), cut[i] + x))
                b.append(cut[i] + found)
    after = np.repeat(np.where(size > long_run, 0, cut[1:]), size) - 1 - np.arange(len(group))  # rows behind in a short run
    at = np.flatnonzero(after > 0)
    for shift in range(1, long_run):
        at = at[after[at] >= shift]
        if not len(at):
            break
        hit = at[_distance(sketch[at], sketch[at + shift]) <= limits[-1]]
        a.append(hit)
        b.append(hit + shift)
    return np.concatenate(a), np.concatenate(b)


def labels_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row that links (a, b) reach from each of n rows: hooks to the smallest neighbour, then pointers to their ends."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return root
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def map_runs(df: DataFrame, keys: list[str], parts: int, solve: Callable[[np.ndarray, pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """``solve(group, rows)`` of whole runs of rows with equal integer ``keys``; group numbers the runs in ascending order."""
    df = df.select(*keys, *(c for c in df.columns if c not in keys)).repartition(parts, *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[list[np.ndarray], pa.RecordBatch]] = []  # rows of the last run so far

        def whole_runs(pieces: list[tuple[list[np.ndarray], pa.RecordBatch]]) -> pa.RecordBatch:
            cols = [np.concatenate(c) for c in zip(*(k for k, _ in pieces))]
            new = np.logical_or.reduce([np.concatenate([[True], c[1:] != c[:-1]]) for c in cols])
            return solve(np.cumsum(new), pa.Table.from_batches([b for _, b in pieces]))

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(keys))]
            other = np.flatnonzero(np.logical_or.reduce([c != c[-1] for c in cols]))
            cut = int(other[-1]) + 1 if len(other) else 0  # rows before those of the batch's last run
            if cut or (held and any(c[0] != h[-1] for c, h in zip(cols, held[-1][0]))):
                yield whole_runs([*held, ([c[:cut] for c in cols], batch.slice(0, cut))])
                held = []
            held.append(([c[cut:] for c in cols], batch.slice(cut)))
        if held:
            yield whole_runs(held)

    return df.mapInArrow(run, schema)


def dealt_in_pairs(rows: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """``rows`` with i, j: of keys in ``hot`` (key, c chunks) each row goes to every pair of chunks that has its own, so every two
    rows of a key meet; rows of other keys stay together."""
    if hot.isEmpty():
        return rows.withColumns({"i": F.lit(0), "j": F.lit(0)})
    mine = F.pmod(F.xxhash64("node"), "c").cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("c") - 1), lambda x: F.struct(F.least(x, mine).alias("i"), F.greatest(x, mine).alias("j")))
    cold = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    return rows.join(hot, key, "left").select(*rows.columns, F.inline(F.when(F.col("c").isNull(), cold).otherwise(pair)))


def close_groups(nodes: DataFrame, n: int, similarity: float, hot_key: int = HOT_KEY) -> DataFrame:
    """(cluster, node): members of the groups, of two or more, that chains of nodes close by 128 bits make under one key. The name
    of a group is a hash of its members, so groups that many keys find are equal rows."""
    positions = block_positions(n, similarity)
    limits = (limit_of(similarity, 128, 3),)
    parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), scale_to_parts(n * len(positions), 500_000))
    rows = block_rows(nodes.repartition(max(parts // 4, 1), "node"), positions)
    hot = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot_key)
    hot = materialize(hot.select("key", F.ceil(F.col("n") / hot_key).cast("int").alias("c")), "hot-keys")

    def members(group: np.ndarray, rows: pa.Table) -> pa.RecordBatch:
        node, s, u = (rows.column(c).to_numpy() for c in ("node", "s", "u"))
        root = labels_of(len(node), *pairs_of_runs(group, np.stack([s, u], axis=1).view(np.uint64), limits))
        name = np.zeros(len(node), np.uint64)
        np.add.at(name, root, mix64(node.view(np.uint64)))
        at = np.flatnonzero(np.bincount(root, minlength=len(root))[root] > 1)
        return pa.RecordBatch.from_arrays([pa.array(name[root[at]].view(np.int64)), pa.array(node[at])], ["cluster", "node"])

    return map_runs(dealt_in_pairs(rows, "key", hot), ["key", "i", "j"], parts, members, "cluster long, node long")


def _prints(rows: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column("fp").to_pylist()), "<u8").reshape(rows.num_rows, -1)


def sure_links(members: DataFrame, parts: int, limit: int) -> DataFrame:
    """(a, b): of each member (cluster, node, fp) that chains within ``limit`` bits join to others of its group, the first of these."""

    def links(group: np.ndarray, rows: pa.Table) -> pa.RecordBatch:
        node = rows.column("node").to_numpy()
        root = labels_of(len(node), *pairs_of_runs(group, _prints(rows), (limit,)))
        at = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(node[root[at]])], ["a", "b"])

    return map_runs(members, ["cluster"], parts, links, "a long, b long")


def close_apart(fps: np.ndarray, root: np.ndarray, limit: int) -> np.ndarray:
    """True for rows that are within ``limit`` bits of a row with another root."""
    _, kind, count = np.unique(root, return_inverse=True, return_counts=True)
    out = np.zeros(len(root), bool)
    for x in np.flatnonzero(kind != count.argmax()):  # every pair of roots has one that is not the most frequent
        near = (kind != kind[x]) & (_distance(fps, fps[x]) <= limit)
        out |= near
        out[x] |= near.any()
    return out


def unsure_members(members: DataFrame, parts: int, limit: int) -> DataFrame:
    """(cluster, node, root): members (cluster, node, root, fp) within ``limit`` bits of one of their group with another root."""

    def apart(group: np.ndarray, rows: pa.Table) -> pa.RecordBatch:
        root = rows.column("root").to_numpy()
        changes = np.flatnonzero((group[1:] == group[:-1]) & (root[1:] != root[:-1]))
        ask = np.zeros(len(group), bool)
        fps = _prints(rows) if len(changes) else None
        for g in np.unique(group[changes]):
            a, b = np.searchsorted(group, [g, g + 1])
            ask[a:b] = close_apart(fps[a:b], root[a:b], limit)
        names = ["cluster", "node", "root"]
        return pa.RecordBatch.from_arrays([pa.array(rows.column(c).to_numpy()[ask]) for c in names], names)

    return map_runs(members, ["cluster"], parts, apart, "cluster long, node long, root long")


def shingle_sets(documents: DataFrame, shingle: int) -> DataFrame:
    """(node, hashes array<long>): the distinct shingles of each text, under the name of its fingerprint."""

    def compute(batch: pa.RecordBatch):
        for _, texts in groups_of_bytes(batch.column("text")):
            sets = [np.unique(np.array(shingle_hashes(t, shingle), np.uint64)) for t in texts]
            hashes = pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([wide_fingerprint(x) for x in sets], pa.binary()), hashes], ["fp", "hashes"])

    rows = map_arrow(documents.select("text"), compute, "fp binary, hashes array<long>")
    return rows.select(F.xxhash64("fp").alias("node"), "hashes")


def links_of_sets(root: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Rows whose sets (sorted, distinct) have this Jaccard similarity: links that connect all such rows, given that rows with equal
    root are connected. Pairs are compared unless something joins them already."""
    _, kind, count = np.unique(root, return_inverse=True, return_counts=True)
    size, out = np.array([len(x) for x in sets]), []
    for x in np.flatnonzero(kind != count.argmax()):
        todo = np.flatnonzero((np.minimum(size, size[x]) >= similarity * np.maximum(size, size[x]) - 1e-9) & (size > 0))
        while len(todo := todo[kind[todo] != kind[x]]):
            now, todo = todo[:32], todo[32:]
            values = np.concatenate([sets[y] for y in now])
            at = np.minimum(np.searchsorted(sets[x], values), size[x] - 1)
            common = np.add.reduceat(sets[x][at] == values, np.cumsum(size[now]) - size[now], dtype=np.int64)
            for y in now[common >= similarity * (size[now] + size[x] - common) - 1e-9]:
                if kind[y] != kind[x]:
                    out.append((int(x), int(y)))
                    kind[kind == kind[y]] = kind[x]
    return out


def similar_links(documents: DataFrame, nodes: DataFrame, unsure: DataFrame, shingle: int, similarity: float, chunk: int = SET_CHUNK) -> DataFrame:
    """(a, b): links of nodes whose sets of shingles have at least this Jaccard similarity, which with the roots connect all such nodes
    of a group. ``unsure`` is (cluster, node, root)."""
    asked = unsure.select("node").distinct()
    firsts = materialize(nodes.join(asked, "node", "left_semi").select(F.col("first").alias("doc_id")).distinct(), "asked")
    texts = documents.select("doc_id", "text").join(maybe_broadcast(firsts, 32), "doc_id", "left_semi")
    sets = materialize(shingle_sets(texts, shingle).dropDuplicates(["node"]), "shingle-sets")
    size = join_salted(unsure, sets.select("node", F.size("hashes").alias("size")), ["node"], ["cluster"])
    hot = size.groupBy("cluster").agg(F.sum("size").alias("n")).where(F.col("n") > chunk)
    hot = materialize(hot.select("cluster", F.ceil(F.col("n") / chunk).cast("int").alias("c")), "hot-groups")
    dealt = materialize(dealt_in_pairs(unsure, "cluster", hot), "dealt")
    rows = join_salted(dealt, sets, ["node"], ["cluster", "i", "j"])
    least = int(unsure.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def links(group: np.ndarray, rows: pa.Table) -> pa.RecordBatch:
        node, root = (rows.column(c).to_numpy() for c in ("node", "root"))
        lists, a, b = rows.column("hashes"), [], []
        cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
            sets = [lists[i].values.to_numpy().view(np.uint64) for i in range(lo, hi)]
            for x, y in links_of_sets(root[lo:hi], sets, similarity):
                a.append(node[lo + x])
                b.append(node[lo + y])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return map_runs(rows, ["cluster", "i", "j"], max(least, scale_to_parts(dealt.count(), 20_000)), links, "a long, b long")


def near_components(documents: DataFrame, shingle: int = 5, similarity: float = 0.8, hot_key: int = HOT_KEY) -> DataFrame:
    """(doc_id, component_id) of each row with a doc_id: the smallest doc_id that links of this similarity reach."""
    documents = documents.where("doc_id is not null").select("doc_id", "text")
    prints = materialize(with_wide_fingerprint(documents, shingle), "wide-fingerprints")
    named = prints.select("doc_id", F.xxhash64("fp").alias("node"), "fp")
    nodes = materialize(named.groupBy("node", "fp").agg(F.min("doc_id").alias("first")), "wide-nodes")
    members = materialize(close_groups(nodes, nodes.count(), similarity, hot_key).distinct(), "members")
    members = materialize(join_salted(members, nodes.select("node", "fp"), ["node"], ["cluster"]), "member-prints")
    parts = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), scale_to_parts(members.count(), 200_000))
    sure = materialize(sure_links(members, parts, limit_of(similarity, WIDTH, -2.5)), "sure-links")
    roots = materialize(connected_components(sure), "sure-roots")
    rooted = join_salted(members, roots, ["node"], ["cluster"], "left").select("cluster", "node", F.coalesce("root", "node").alias("root"), "fp")
    unsure = materialize(unsure_members(rooted, parts, limit_of(similarity, WIDTH, 2.5)), "unsure-members")
    if not unsure.isEmpty():
        roots = connected_components(sure.union(similar_links(documents, nodes, unsure, shingle, similarity)))
    linked = nodes.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    smallest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    by_node = join_salted(linked.select("node", "root").distinct(), smallest, ["root"], ["node"]).select("node", "component_id")
    return join_salted(named.select("doc_id", "node"), by_node, ["node"], ["doc_id"]).select("doc_id", "component_id")


def keep_one(documents: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Pipeline stage: of each component the document with the smallest doc_id stays, whole and unchanged.

    Rows with one doc_id are one document, of which one row stays. Rows with a null doc_id can't be named and all stay.
    """
    keep = near_components(documents, shingle, similarity).where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n"))
    keep = materialize(keep, "kept")
    kept = documents.join(keep.select("doc_id"), "doc_id", "left_semi")
    if not keep.where("n > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id"])
    return kept.unionByName(documents.where("doc_id is null"))
