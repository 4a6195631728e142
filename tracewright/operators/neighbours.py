"""Exact nearest neighbours of vectors within groups.

Where the candidates fit a measured bound they are broadcast and each task compares its queries with all of them. Beyond
it, pivots index both sides:

1. Vectors go to the nearest of ``PIVOTS`` pivots, are ordered by group, pivot and distance from it, and consecutive
   ones are packed into blocks of about ``BLOCK``. A block knows, for every pivot, its least and largest distance from it.
2. By the triangle inequality two blocks are at least ``max(lo_a - hi_b, lo_b - hi_a)`` apart and all their pairs within
   ``hi_a + hi_b``, for any pivot. The k-th neighbour of a block's queries is no farther than ``reach``: the least upper bound
   to a block with k vectors of other owners, or what the block's own vectors show.
3. Only pairs of blocks that may be within reach meet, first as numbers about blocks, then as vectors. Blocks of queries stand
   in ``TILES`` tiles (more where a tile would exceed ``TILE`` blocks), each of them a task. It holds the queries of its tile while
   the blocks that any of them must meet pass by once; of equal vectors of a block those pass that may be among a query's k nearest.
   A meeting is one matrix product that chooses who may be nearer than the k-th so far; distances of those are taken exactly, and a
   query's k best are known when its tile ends.

Work is quadratic in a group at worst, as exactness asks. A block of candidates is sent once a tile at most, so what is
shuffled is in proportion to the vectors up to ``TILES * TILE`` blocks; memory is a tile whatever the corpus. Ties go to the
smaller candidate id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize

BLOCK = 1024
PIVOTS = 32
#: Tiles of query blocks, and blocks of one at most.
TILES = 24
TILE = 256
#: Candidates are broadcast up to so many bytes of vectors.
FEW_BYTES = 16 << 20
#: Rows of queries in a matrix product, and pairs whose distances are taken at once.
ROWS = 256
FEW_PAIRS = 1 << 14
#: Share of a distance by which rounding may move it, and rounding units of matrix products.
SLACK = 1e-9
UNIT, UNIT_SINGLE = 2.0**-53, 2.0**-24
#: Stands for a null owner, who equals nobody.
NOBODY = object()


def matrix(vectors: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows of doubles."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 0))


def first_of_equal(rows: pa.Table, k: int) -> pa.Table:
    """``rows`` (ascending by id) less those that no query can have among its k nearest: k rows of smaller id and other owners
    than the query's, whoever asks, hold the same vector."""
    v = np.ascontiguousarray(matrix(rows.column("vector")))
    if not v.size or len(np.unique(v.sum(axis=1))) == len(v):
        return rows
    which = np.unique(v.view(np.dtype((np.void, v.shape[1] * v.itemsize))).ravel(), return_inverse=True)[1]
    order = np.argsort(which, kind="stable")
    place = np.empty(len(v), np.int64)
    place[order] = np.arange(len(v)) - np.searchsorted(which[order], which[order])
    owner = np.unique(rows.column("owner").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False), return_inverse=True)[1]
    pair, held = np.unique(which * len(v) + owner, return_counts=True)
    most = np.zeros(len(v), np.int64)  # rows of a vector that one owner has
    np.maximum.at(most, pair // len(v), held)
    return rows.filter(pa.array(place < k + most[which]))


def _objects(column: pa.ChunkedArray) -> np.ndarray:
    out = np.empty(len(column), object)
    out[:] = column.to_pylist()
    return out


class Passing:
    """Candidates (id, owner, vector), ascending by id, as rows ``[v - centre, |v - centre|^2]`` of a matrix product."""

    def __init__(self, rows: pa.Table, centre: np.ndarray):
        vectors = matrix(rows.column("vector"))
        finite = np.isfinite((vectors * vectors).sum(axis=1))  # others are at no distance from anyone
        if not finite.all():
            rows, vectors = rows.filter(pa.array(finite)), vectors[finite]
        self.vectors, self.owners, self.kind = vectors, rows.column("owner"), rows.schema.field("id").type
        self.id, self.owner = _objects(rows.column("id")), _objects(self.owners)
        if self.owners.null_count:
            self.owner[[x is None for x in self.owner]] = NOBODY
        about = vectors - centre if len(vectors) else np.zeros((0, len(centre)))
        norm = (about * about).sum(axis=1)
        self.doubles = np.hstack([about, norm[:, None]])
        self.far = float(np.sqrt(norm.max(initial=0.0)))
        self.size = max(np.abs(vectors).max(initial=0.0), np.abs(centre).max(initial=0.0)) * len(centre) ** 0.5
        self.singles = self.doubles.astype(np.float32) if self.far < 1e15 else None
        self.held = np.empty((ROWS, len(vectors)), np.float32)  # for products, one after the other


class Nearest:
    """The k nearest of each row of ``mine`` (id, owner, vector) among the candidates that passed by so far; equal owners
    don't count, ties go to the smaller id. A matrix product, in single precision where that tells enough apart, chooses who
    may be nearer than the k-th so far, with room for rounding; distances of those are taken exactly."""

    def __init__(self, mine: pa.Table, k: int, centre: np.ndarray):
        self.mine, self.k, self.centre, self.kind = mine, k, centre, None
        self.vectors = matrix(mine.column("vector"))
        self.owner = _objects(mine.column("owner"))
        about = self._about(slice(None))
        self.own = (about * about).sum(axis=1)
        self.size = np.abs(self.vectors).max(initial=0.0, where=np.isfinite(self.vectors)) * len(centre) ** 0.5
        self.singles = None
        if self.own.max(initial=0.0, where=np.isfinite(self.own)) < 1e30:
            with np.errstate(over="ignore", invalid="ignore"):
                self.singles = np.hstack([-2 * about, np.ones((len(about), 1))]).astype(np.float32)
        self.dist = np.full((len(self.vectors), k), np.inf)
        self.other = np.full((len(self.vectors), k), None, object)

    def _about(self, part: slice | np.ndarray) -> np.ndarray:
        return self.vectors[part] - self.centre

    def _room(self, part: slice, near: Passing, unit: float) -> np.ndarray:
        """By how much squared distances of a product whose rounding unit is given may be wrong."""
        ends = np.sqrt(self.own[part]) + near.far
        return unit * (len(self.centre) + 8) * ends**2 + 2.0**-49 * ends * max(self.size, near.size) + 1e-36

    def _product(self, part: slice, near: Passing) -> np.ndarray:
        """Squared distances less a row's own squared norm, in doubles."""
        return np.hstack([-2 * self._about(part), np.ones((len(self.own[part]), 1))]) @ near.doubles.T

    def _first(self, part: slice, near: Passing) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that hold the k nearest of ``near``, whatever passed before."""
        d = self._product(part, near)
        owner = pa.concat_arrays([*self.mine.column("owner").slice(part.start, len(d)).chunks, *near.owners.chunks]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        d[owner[: len(d), None] == owner[None, len(d) :]] = np.inf
        last = min(self.k, d.shape[1]) - 1
        edge = np.partition(d, last, axis=1)[:, last]
        return np.nonzero((d <= (edge + 2 * self._room(part, near, UNIT))[:, None]) & np.isfinite(d))

    def _closer(self, part: slice, near: Passing) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that may be as near as the k-th so far."""
        limit = self.dist[part, -1] ** 2 * (1 + SLACK) - self.own[part]
        if self.singles is not None and near.singles is not None:
            d = np.matmul(self.singles[part], near.singles.T, out=near.held[: len(limit)])
            edge = (limit + np.abs(limit) * 2.0**-23 + self._room(part, near, UNIT_SINGLE)).astype(np.float32)
            rows = np.flatnonzero(d.min(axis=1) <= edge)
            i, j = np.divmod(np.flatnonzero(d[rows] <= edge[rows, None]), d.shape[1])
            if len(i) <= d.size // 16:
                return rows[i], j
        return np.nonzero(self._product(part, near) <= (limit + np.abs(limit) * SLACK + self._room(part, near, UNIT))[:, None])

    def meet(self, near: Passing) -> None:
        self.kind = near.kind
        if not len(near.id):
            return
        new = np.isinf(self.dist[:, -1]) & np.isfinite(self.own)
        pairs = []
        with np.errstate(invalid="ignore"):  # rows that aren't finite have no neighbours
            for x in range(0, len(self.vectors), ROWS):
                part = slice(x, x + ROWS)
                i, j = (self._first if new[part].any() else self._closer)(part, near)
                pairs.append((i + x, j))
        self._take(*map(np.concatenate, zip(*pairs)), near)

    def _take(self, i: np.ndarray, j: np.ndarray, near: Passing) -> None:
        """Merge pairs, ascending by row, into the k nearest."""
        known = (self.owner[i] != near.owner[j]).astype(bool)
        i, j = i[known], j[known]
        dist = np.concatenate([np.sqrt(((self.vectors[i[x : x + FEW_PAIRS]] - near.vectors[j[x : x + FEW_PAIRS]]) ** 2).sum(axis=1)) for x in range(0, len(i), FEW_PAIRS)] or [np.zeros(0)])
        known = dist <= self.dist[i, -1]  # not where it is NaN
        i, j, dist = i[known], j[known], dist[known]
        if not len(i):
            return
        rows = np.unique(i)
        at, place = np.nonzero(np.isfinite(self.dist[rows]))
        row = np.concatenate([at, np.searchsorted(rows, i)])
        other = np.concatenate([self.other[rows[at], place], near.id[j]])
        dist = np.concatenate([self.dist[rows[at], place], dist])
        order = np.lexsort((dist, row))
        row, dist, other = row[order], dist[order], other[order]
        same = (row[1:] == row[:-1]) & (dist[1:] == dist[:-1])
        if same.any():
            tied = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            rank = np.zeros(len(row), np.int64)
            rank[tied] = pc.rank(pa.array(other[tied].tolist(), self.kind), sort_keys="ascending", tiebreaker="dense").to_numpy().astype(np.int64)
            order = np.lexsort((rank, dist, row))
            row, dist, other = row[order], dist[order], other[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < self.k
        self.dist[rows], self.other[rows] = np.inf, None
        self.dist[rows[row[kept]], place[kept]] = dist[kept]
        self.other[rows[row[kept]], place[kept]] = other[kept]

    def table(self) -> pa.Table:
        """(id, dist, other), by row and distance."""
        held = np.isfinite(self.dist)
        return pa.table({"id": self.mine.column("id").take(pa.array(np.nonzero(held)[0])), "dist": pa.array(self.dist[held]), "other": pa.array(self.other[held].tolist(), self.kind)})


def _centre(vectors: np.ndarray) -> np.ndarray:
    return np.nan_to_num(vectors.mean(axis=0), nan=0.0, posinf=0.0, neginf=0.0) if len(vectors) else np.zeros(vectors.shape[1])


def best_of_blocks(mine: pa.Table, others: pa.Table, k: int) -> pa.Table:
    """(id, dist, other): the k nearest of ``others`` for each row of ``mine``, both (id, owner, vector); equal owners don't
    count. ``others`` ascends by id."""
    best = Nearest(mine, k, _centre(matrix(mine.column("vector"))))
    if len(best.vectors):
        for x in range(0, others.num_rows, BLOCK):
            best.meet(Passing(others.slice(x, BLOCK), best.centre))
    return best.table()


def _pieces(table: pa.Table) -> list[pa.RecordBatch]:
    return table.combine_chunks().to_batches() if table.num_rows else []


def _few(queries: DataFrame, candidates: pa.Table, k: int, kinds: str) -> DataFrame:
    shared = queries.sparkSession.sparkContext.broadcast(candidates.sort_by([("grp", "ascending"), ("id", "ascending")]).combine_chunks())

    def by_group(table: pa.Table) -> Iterator[tuple[object, pa.Table]]:
        groups, a = table.column("grp").to_pylist(), 0
        for b in range(1, len(groups) + 1):
            if b == len(groups) or groups[b] != groups[a]:
                yield groups[a], table.slice(a, b - a)
                a = b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {g: first_of_equal(rows, k) for g, rows in by_group(shared.value)}
        for batch in batches:
            for g, mine in by_group(pa.Table.from_batches([batch]).sort_by("grp")):
                if g in table:
                    yield from _pieces(best_of_blocks(mine, table[g], k))

    return queries.select("id", "grp", "owner", "vector").mapInArrow(run, kinds)


def _pack(vectors: DataFrame, pivots: np.ndarray, k: int) -> DataFrame:
    """Blocks (block, grp, n, lo, hi, spare, reach, rows): ``spare`` vectors of other owners whatever a query's owner is; ``reach``
    the k-th neighbour of any of its vectors within the block."""
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)
    kind = dict(vectors.dtypes)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("vector"))
            if len(v):
                d = np.sqrt(np.maximum(0, (v * v).sum(axis=1)[:, None] + (shared.value**2).sum(axis=1) - 2 * v @ shared.value.T))
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "grp", "owner", "vector")), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], ["id", "grp", "owner", "vector", "cell", "far"])

    def block(rows: pa.Table, number: int) -> pa.RecordBatch:
        rows = rows.sort_by("id")
        v = matrix(rows.column("vector"))
        d = np.sqrt(((v[:, None, :] - shared.value[None, :, :]) ** 2).sum(axis=2)) if v.size < 1 << 22 else np.stack([np.sqrt(((v - p) ** 2).sum(axis=1)) for p in shared.value], axis=1)
        most = max(rows.column("owner").value_counts().field("counts").to_pylist())
        near = best_of_blocks(rows, rows, k)
        dist = near.column("dist").to_numpy()
        reach = float(dist.max(initial=0.0)) if len(dist) == k * len(v) else float("inf")
        sink, kept = pa.BufferOutputStream(), rows.select(["id", "owner", "vector"])
        with np.errstate(over="ignore"):
            singles = v.astype(np.float32)
        if v.size and (singles == v).all():  # half the bytes
            kept = kept.set_column(2, "vector", pa.FixedSizeListArray.from_arrays(pa.array(singles.ravel()), v.shape[1]))
        with pa.ipc.new_stream(sink, kept.schema) as out:
            out.write_table(kept)
        lists = [pa.array([x.tolist()], pa.list_(pa.float64())) for x in (d.min(axis=0), d.max(axis=0))]
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), grp_of(rows), pa.array([len(v)]), *lists, pa.array([len(v) - most]), pa.array([reach]), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
            ["block", "grp", "n", "lo", "hi", "spare", "reach", "rows"],
        )

    grp_of = lambda rows: rows.column("grp").slice(0, 1).combine_chunks()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            where = list(zip(held.column("grp").to_pylist(), held.column("cell").to_pylist()))
            a = 0
            while a < len(where):  # cut where group or pivot change; what may go on with the next batch stays
                b = a
                while b < len(where) and where[b] == where[a] and b - a < BLOCK:
                    b += 1
                if b == len(where) and b - a < BLOCK:
                    break
                yield block(held.slice(a, b - a), number)
                number, a = number + 1, b
            held = held.slice(a)
        if held is not None and held.num_rows:
            yield block(held, number)

    rows = vectors.select("id", "grp", "owner", "vector").mapInArrow(assign, f"id {kind['id']}, grp {kind['grp']}, owner {kind['owner']}, vector array<double>, cell int, far double")
    ordered = rows.repartitionByRange(parts, "grp", "cell", "far", "id").sortWithinPartitions("grp", "cell", "far", "id")
    return materialize(ordered.mapInArrow(pack, f"block long, grp {kind['grp']}, n long, lo array<double>, hi array<double>, spare long, reach double, rows binary"), "vector-blocks")



def meetings(mine: DataFrame, others: DataFrame, k: int, same: bool) -> DataFrame:
    """(a, b): blocks of ``mine`` and ``others`` of a group that may hold k nearest; from the numbers about blocks alone."""
    a = mine.select("grp", F.col("block").alias("a"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"), (F.col("reach") if same else F.lit(float("inf"))).alias("reach"))
    b = others.select("grp", F.col("block").alias("b"), F.col("lo").alias("blo"), F.col("hi").alias("bhi"), "spare")
    apart = F.array_max(F.zip_with(F.zip_with("alo", "bhi", lambda x, y: x - y), F.zip_with("blo", "ahi", lambda x, y: x - y), lambda x, y: F.greatest(x, y)))
    within = F.when(F.col("spare") >= k, F.array_min(F.zip_with("ahi", "bhi", lambda x, y: x + y))).otherwise(F.lit(float("inf")))
    met = a.join(b, "grp").select("a", "b", "reach", apart.alias("apart"), within.alias("within"))
    reach = met.groupBy("a").agg(F.least(F.min("reach"), F.min("within")).alias("far"))
    return met.join(reach, "a").where(F.col("apart") <= F.col("far") * (1 + 1e-6) + 1e-9).select("a", "b")


def nearest(queries: DataFrame, candidates: DataFrame, k: int, few_bytes: int = FEW_BYTES) -> DataFrame:
    """(id, dist, other): the k nearest candidates of each query in its group with another owner.

    Both are (id, grp, owner, vector ARRAY<DOUBLE>), ids unique and vectors of one length; null groups match nothing.
    """
    kind = dict(queries.dtypes)["id"], dict(candidates.dtypes)["id"]
    kinds = f"id {kind[0]}, dist double, other {kind[1]}"
    size = candidates.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).head()
    if size["n"] * (size["d"] or 0) * 8 <= few_bytes:
        return _few(queries.where("grp is not null"), candidates.where("grp is not null").select("id", "grp", "owner", "vector").toArrow(), k, kinds)
    same = queries is candidates
    pivots = matrix(candidates.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).select("vector").toArrow().column("vector"))
    others = _pack(candidates.where("grp is not null"), pivots, k)
    mine = others if same else _pack(queries.where("grp is not null"), pivots, k)
    pairs = meetings(mine, others, k, same)
    tile = F.ntile(max(TILES, -(-mine.count() // TILE))).over(Window.orderBy("grp", "block"))  # a row a block, of numbers alone
    tiles = materialize(mine.select(F.col("block").alias("a"), tile.alias("tile")), "vector-tiles")
    return solve_tiles(pairs, tiles, mine, others, k, kinds)


def solve_tiles(pairs: DataFrame, tiles: DataFrame, mine: DataFrame, others: DataFrame, k: int, kinds: str) -> DataFrame:
    """(id, dist, other) from the pairs (a, b) of blocks that meet and the tile of each block a."""
    wanted = pairs.join(F.broadcast(tiles), "a").groupBy("tile", "b").agg(F.collect_list("a").alias("asked"))
    held = tiles.join(mine.select(F.col("block").alias("a"), "rows"), "a")
    held = held.select("tile", F.lit(0).alias("kind"), F.col("a").alias("block"), F.lit(None).cast("array<long>").alias("asked"), "rows")
    passing = wanted.join(others.select(F.col("block").alias("b"), "rows"), "b").select("tile", F.lit(1).alias("kind"), F.col("b").alias("block"), "asked", "rows")
    n = tiles.agg(F.max("tile")).head()[0] or 1
    dealt = held.union(passing).repartitionById(n, F.col("tile")).sortWithinPartitions("tile", "kind", "block")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lambda x: pa.ipc.open_stream(x.as_buffer()).read_all()
        now, centre, best = None, None, {}
        for batch in batches:
            for t, kind, block, asked, rows in zip(*(batch.column(c) for c in ("tile", "kind", "block", "asked", "rows"))):
                if t.as_py() != now:
                    for x in best.values():
                        yield from _pieces(x.table())
                    now, centre, best = t.as_py(), None, {}
                near = read(rows)
                if kind.as_py() == 0:
                    centre = _centre(matrix(near.column("vector"))) if centre is None else centre
                    best[block.as_py()] = Nearest(near, k, centre)
                    continue
                near = Passing(first_of_equal(near, k), centre)
                for a in asked.as_py():
                    best[a].meet(near)
        for x in best.values():
            yield from _pieces(x.table())

    return dealt.mapInArrow(solve, kinds)


def extend_nearest(best: DataFrame, known: DataFrame, added: DataFrame, k: int, few_bytes: int = FEW_BYTES) -> DataFrame:
    """(id, dist, other) of ``known`` and ``added`` together, from ``best``, that of ``known`` alone.

    Added vectors look for neighbours among all, known ones only among the added; so the work is in proportion to what was
    added. ``best`` is (id, dist, other) as ``nearest(known, known, k)`` gave it.
    """
    every = known.unionByName(added)
    fresh = nearest(added, every, k, few_bytes)
    closer = best.unionByName(nearest(known, added, k, few_bytes))
    kept = closer.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("dist", "other"))), 1, k).alias("best"))  # 2k a row at most
    return kept.select("id", F.inline("best")).unionByName(fresh)
