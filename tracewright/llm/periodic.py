"""Periodic runs of words from longest previous factors.

A run is a maximal stretch of words with smallest period q that is at least ``max(6, 4 * q)`` words long. Per text:

1. Words become numbers; the suffix array of each text comes from prefix doubling, common prefixes of neighbours from
   comparing word by word, on from 16 words in text order (where they shrink by at most one a step).
2. Suffix array and common prefixes give the longest previous factor of each word in one pass with a stack; its chain
   cuts the text into LZ blocks: a new word, or the longest factor that starts earlier too.
3. A run that is not strictly inside one block meets the border of the last block it reaches within what its two blocks
   allow: with lengths u and v around the border its period is under (u + v) / 3, since a run that began a period
   before the former block would have let that block be longer. For all such periods words across the border are compared
   forward and backward, 16 each way. Borders where that leaves a run possible get Main's extensions in full,
   from Z-functions in linear time.
4. Runs strictly inside a block are copies of runs of its earlier occurrence; buckets by start are copied block by block.

Steps 1 to 3 work on a group of texts at once, of about ``GROUP_BYTES`` (one text at least), in numpy; work is n log n in
the number of words, memory linear. Texts need no shuffle: each row is answered where it is read.

Definitions: words are runs of characters other than ASCII white space, compared as they are. Null and empty texts have
no words and no runs. Repeated rows each get a row. Columns named like the results are replaced; others pass through.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP_BYTES = 6 << 20
MIN_LENGTH = 6
MIN_POWER = 4
#: Words compared at once before the linear methods take over.
NEAR = 16
#: A block that holds a run strictly inside has a word more at either end.
_COPY = MIN_LENGTH + 2
OWN = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
KINDS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"

_IS_WORD = np.ones(256, bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False

Run = tuple[int, int, int]  # first word, last word, period


def split_words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts in order, and where each text's words begin (one more than texts)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    inside = _IS_WORD[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    start, end = edge[0::2], edge[1::2]
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=offsets[1:])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return words, np.searchsorted(start, bounds)


def sort_by(key: np.ndarray, top: int) -> np.ndarray:
    """Places of ``key`` (all under ``top``) in ascending order; key and place share a 64-bit number where they fit."""
    bits = max(1, int(len(key)).bit_length())
    if top.bit_length() + bits > 63:
        return np.argsort(key, kind="stable")
    packed = (key << bits) | np.arange(len(key))
    packed.sort()
    return packed & ((1 << bits) - 1)


def suffix_array(code: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Suffixes in order, text by text; a suffix ends with its text and stands before longer ones that it begins.

    Prefix doubling, in which only suffixes whose first words are shared take part in the next round.
    """
    n = len(code)
    text = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    stop = edges[1:][text]
    top = int(code.max(initial=0)) + 1
    key = text * top + code
    order = sort_by(key, (len(edges) - 1) * top)
    sa = order.copy()
    new = np.ones(n, bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0)) if n else np.zeros(0, np.int64)
    rank = np.empty(n, np.int64)
    rank[order] = first
    alone = new & np.append(new[1:], True)
    left, h = order[~alone], 1
    while len(left):
        beyond = left + h
        inside = beyond < stop[left]
        second = np.where(inside, rank[np.where(inside, beyond, 0)] + 1, 0)
        old = rank[left]
        key = old * (n + 1) + second
        by = sort_by(key, n * (n + 1))
        left, key, old = left[by], key[by], old[by]
        at = np.arange(len(left))
        new = np.ones(len(left), bool)
        new[1:] = key[1:] != key[:-1]
        head = np.ones(len(left), bool)
        head[1:] = old[1:] != old[:-1]
        in_class = np.maximum.accumulate(np.where(head, at, 0))
        sa[old + at - in_class] = left
        rank[left] = old + np.maximum.accumulate(np.where(new, at, 0)) - in_class
        alone = new & np.append(new[1:], True)
        left, h = left[~alone], 2 * h
    return sa


def same_ahead(code: np.ndarray, a: np.ndarray, b: np.ndarray, stop: np.ndarray, step: int = 1) -> np.ndarray:
    """Equal words from a and b on, ``NEAR`` at most; with step -1 backward. No place may pass ``stop``."""
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for k in range(NEAR):
        x, y = a[live] + step * k, b[live] + step * k
        ok = (np.maximum(x, y) < stop[live]) if step > 0 else (np.minimum(x, y) > stop[live])
        live, x, y = live[ok], x[ok], y[ok]
        live = live[code[x] == code[y]]
        if not len(live):
            break
        out[live] += 1
    return out


def common_prefixes(code: np.ndarray, edges: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Words that each suffix shares with the one before it in order; 0 for the first of a text."""
    n = len(code)
    text = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    lcp = np.zeros(n, np.int64)
    a, b = sa[:-1], sa[1:]
    near = np.flatnonzero(text[a] == text[b])
    lcp[near + 1] = same_ahead(code, a[near], b[near], edges[1:][text[b[near]]])
    long = np.flatnonzero(lcp == NEAR)
    if len(long):
        words, stops = code.tolist(), edges[1:][text[sa[long]]].tolist()
        last, shared = -2, 0
        for i, j, r, stop in sorted(zip(sa[long].tolist(), sa[long - 1].tolist(), long.tolist(), stops)):
            k = max(NEAR, shared - 1) if i == last + 1 else NEAR
            while max(i, j) + k < stop and words[i + k] == words[j + k]:
                k += 1
            lcp[r] = shared = k
            last = i
    return lcp


def previous_factors(sa: np.ndarray, lcp: np.ndarray) -> tuple[list[int], dict[int, int]]:
    """Per place the length of the longest factor that starts there and earlier too; for long ones where that is."""
    n = len(sa)
    out, source = [0] * n, {}
    linked = lcp > 0
    keep = np.flatnonzero(linked | np.append(linked[1:], False))  # others share no word with any suffix
    places, shares = sa[keep].tolist() + [-1], lcp[keep].tolist() + [0]
    stack: list[tuple[int, int]] = []
    for place, share in zip(places, shares):
        while stack:
            at, held = stack[-1]
            if place < at:
                stack.pop()
                if share > held:
                    out[at] = share
                    if share >= _COPY:
                        source[at] = place
                else:
                    out[at] = held
                    if held >= _COPY:
                        source[at] = stack[-1][0]
                share = min(share, held)
            elif share <= held:
                stack.pop()
                out[at] = held
                if held >= _COPY:
                    source[at] = stack[-1][0]
            else:
                break
        stack.append((place, share))
    return out, source


def blocks(factors: list[int], edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where LZ blocks begin, and the text of each."""
    starts, counts = [], []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        before = len(starts)
        while a < b:
            starts.append(a)
            a += factors[a] or 1
        counts.append(len(starts) - before)
    return np.array(starts, np.int64), np.repeat(np.arange(len(counts)), counts)


def z_function(x: list[int]) -> list[int]:
    """Words that each suffix of x shares with x."""
    n = len(x)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(z[i - left], right - i) if i < right else 0
        while i + k < n and x[i + k] == x[k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def extensions(words: list[int], c: int, e: int, top: int, whole: bool) -> list[Run]:
    """Main's extensions: runs with a period up to ``top`` that meet the border c and end before e.

    ``words`` begin where no such run can; unless that is the text's own begin (``whole``), what reaches it is the cut-off
    part of a run that an earlier border finds.
    """
    y, x = words[:c], words[c : e + 1]
    head, back = x[:top], y[::-1]
    zx, zb = z_function(x), z_function(back)
    # backward from the border and from p words after it; forward from the border and from p words before it
    zl = z_function([*back, -1, *head[::-1], *back])
    zr = z_function([*x, -1, *y, *x])
    out = []
    for p in range(1, top + 1):
        if p < len(x) and zx[p]:
            left = zl[len(back) + 1 + len(head) - p]
            out.append((c - left, c + p + zx[p] - 1, p))
        if p < len(back) and zb[p]:
            right = zr[len(x) + 1 + len(y) - p]
            out.append((c - p - zb[p], c + right - 1, p))
    return [(a, b, p) for a, b, p in out if b < e and (a or whole) and b - a + 1 >= max(MIN_LENGTH, MIN_POWER * p)]


def border_runs(code: np.ndarray, edges: np.ndarray, starts: np.ndarray, text: np.ndarray) -> dict[int, dict[tuple[int, int], int]]:
    """Per text the runs that are not strictly inside a block: (first, last) -> period."""
    found: dict[int, dict[tuple[int, int], int]] = defaultdict(dict)
    if not len(starts):
        return found
    # borders: the end of every block; the last one of a text has an empty block after it
    u0, c = starts, np.append(starts[1:], edges[-1])
    last = np.append(text[1:] != text[:-1], True)
    e = np.where(last, c, np.append(c[1:], edges[-1]))
    top = np.maximum(0, (e - u0 - 1) // 3)
    border = np.repeat(np.arange(len(c)), top)
    p = np.arange(len(border)) - np.repeat(np.cumsum(top) - top, top) + 1
    low, high = edges[:-1][text], edges[1:][text]
    possible = np.zeros(len(c), bool)
    for side in (1, -1):
        at = c[border] if side > 0 else c[border] - 1
        other = at + side * p
        ok = (other < high[border]) & (at < high[border]) if side > 0 else other >= low[border]
        b, q, x, y = border[ok], p[ok], at[ok], other[ok]
        met = code[x] == code[y]
        b, q, x, y = b[met], q[met], x[met], y[met]
        ahead = same_ahead(code, x, y, high[b]) if side > 0 else same_ahead(code, x, y, low[b] - 1, -1)
        behind = same_ahead(code, x - 1, y - 1, low[b] - 1, -1) if side > 0 else same_ahead(code, x + 1, y + 1, high[b])
        need = np.maximum(MIN_LENGTH - q, (MIN_POWER - 1) * q)
        possible[b[(ahead + behind >= need) | (ahead == NEAR) | (behind == NEAR)]] = True
    for i in np.flatnonzero(possible).tolist():
        # only the stretch around the border becomes a list
        lo = max(int(low[i]), int(u0[i]) - int(top[i]) - 1)
        near = code[lo : min(int(high[i]), int(e[i]) + 1)].tolist()
        runs = found[int(text[i])]
        for first, end, q in extensions(near, int(c[i]) - lo, int(e[i]) - lo, int(top[i]), lo == int(low[i])):
            key = (first + lo, end + lo)
            runs[key] = min(q, runs.get(key, q))
    return {t: r for t, r in found.items() if r}


def copied_runs(known: dict[tuple[int, int], int], starts: list[int], stop: int, source: dict[int, int]) -> list[Run]:
    """All runs of a text: ``known`` and those that blocks copy from their earlier occurrences, in buckets by start."""
    bucket: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for (a, b), p in known.items():
        bucket[a].append((b, p))
    for s, e in zip(starts, [*starts[1:], stop]):
        if e - s >= _COPY:
            shift = s - source[s]
            for a in range(source[s] + 1, e - shift - MIN_LENGTH):
                if a in bucket:
                    bucket[a + shift] += [(b + shift, p) for b, p in bucket[a] if b + shift < e - 1]
    return sorted((a, b, p) for a, ends in bucket.items() for b, p in ends)


def runs_of_texts(code: np.ndarray, edges: np.ndarray) -> dict[int, list[Run]]:
    """Runs of every text that has any, by start and then period; places count from the text's first word."""
    if not len(code):
        return {}
    sa = suffix_array(code, edges)
    factors, source = previous_factors(sa, common_prefixes(code, edges, sa))
    starts, text = blocks(factors, edges)
    out = {}
    first = np.searchsorted(text, np.arange(len(edges)))
    for t, known in border_runs(code, edges, starts, text).items():
        base = int(edges[t])
        runs = copied_runs(known, starts[first[t] : first[t + 1]].tolist(), int(edges[t + 1]), source)
        out[t] = sorted(((a - base, b - base, p) for a, b, p in runs), key=lambda r: (r[0], r[2]))
    return out


Reshape = Callable[[object, int], tuple[int, int] | None]


def with_runs(documents: DataFrame, reshape: Reshape | None = None, key: str = "doc_id") -> DataFrame:
    """All columns of ``documents`` but text and ``OWN``.

    ``reshape(key, n)`` may give (a, p): words from a on are then the p words at a, again and again.
    """
    passed = [f for f in documents.schema.fields if f.name not in ("text", *OWN)]
    names = [f.name for f in passed]

    def solve(batch: pa.RecordBatch, raw: list[bytes]) -> pa.RecordBatch:
        words, edges = split_words(raw)
        at = np.arange(len(words))
        for i, k in enumerate(batch.column(key).to_pylist() if reshape else []):
            a, n = int(edges[i]), int(edges[i + 1] - edges[i])
            if n and (how := reshape(k, n)):
                at[a + how[0] : a + n] = a + how[0] + np.arange(n - how[0]) % how[1]
        coded = words.dictionary_encode()
        found = runs_of_texts(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[at], edges)
        rows: list[list] = [[] for _ in OWN]
        drop = np.zeros(len(words) + 1, np.int64)
        for i in range(len(raw)):
            runs = found.get(i, [])
            for a, b, q in runs:
                drop[edges[i] + a + q] += 1
                drop[edges[i] + b + 1] -= 1
            best = max(runs, key=lambda r: (Fraction(r[1] - r[0] + 1, r[2]), -r[0], -r[2]), default=None)
            own = (best[0], best[1] - best[0] + 1, best[2], 1000 * (best[1] - best[0] + 1) // best[2]) if best else (None,) * 4
            listed = hashlib.sha256("".join(f"{a},{b - a + 1},{q}\n" for a, b, q in runs).encode()).hexdigest()
            for column, value in zip(rows, (len(runs), *own, listed)):
                column.append(value)
        kept = np.cumsum(drop[:-1]) == 0
        count = np.concatenate([[0], np.cumsum(kept)])[edges]
        left = words.take(pa.array(at[kept]))
        spaced = pc.binary_join_element_wise(left, pa.scalar(b"", pa.large_binary()), pa.scalar(b" ", pa.large_binary()))  # a space after each
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(spaced).to_numpy())])[count]
        data = memoryview(spaced.buffers()[2]) if len(spaced) else memoryview(b"")
        rows[-1] = [hashlib.sha256(data[a : max(a, b - 1)]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        results = [pa.array(c, pa.string() if n.endswith("256") else pa.int64()) for n, c in zip(OWN, rows)]
        return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *results], [*names, *OWN])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, size, raw = 0, 0, []
            column = batch.column("text")
            for i in range(batch.num_rows):
                b = (column[i].as_py() or "").encode("utf-8", "surrogatepass")
                if raw and size + len(b) > GROUP_BYTES:
                    yield solve(batch.slice(a, len(raw)), raw)
                    a, size, raw = i, 0, []
                raw.append(b)
                size += len(b)
            if raw:
                yield solve(batch.slice(a, len(raw)), raw)

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in passed)
    return documents.select(*names, "text").mapInArrow(run, kinds + KINDS)


def planted(key: object, n: int) -> tuple[int, int] | None:
    """The contract's change of every tenth text (by crc32 of its id); texts without an id stay as they are."""
    h = None if key is None else zlib.crc32(str(key).encode())
    if h is None or h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Contract query: runs of every document."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_runs(documents, planted).select("doc_id", *(F.col(c) for c in OWN))
