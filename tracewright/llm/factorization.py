"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

    score = sigmoid(b + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2))

so all pairwise interactions cost one pass over a text's features for each of ``RANK`` factors. Features of a text:

- its lower-cased words, hashed to ``DIM`` places: log(1 + count), divided by their norm over the text;
- structure: how long it is, how long its words are, shares of symbols, marks, capitals, digits and other characters,
  of distinct words, of words equal to the one or two before, of repeated lines, how often a line ends (``STRUCTURE``);
- metadata: the logarithm of the length the table states (``METADATA``; the text's own where that is null or absent).

Structure and metadata are standardised by the training rows and cut at ``CUT`` deviations. Labels, language, source and
id are no inputs: the id only says who may learn.

Learning takes at most ``SAMPLE_ROWS`` labelled rows, those of smallest hash of the id, so the fit is bounded whatever the
corpus and the same in reruns; it runs in one task (Adam over fixed batches). Scoring reads every row where it is, without a
shuffle; the model of ``DIM`` places is broadcast.

Definitions: null texts are empty, and empty texts have structure and metadata alone. Labels of an id that disagree, or
are null, are not used; a null id neither learns nor is held out. Without any label to learn from, every score is 0.5.
Scores are rounded to 9 places. Repeated rows each get a row. Columns named like the results are replaced; others pass through.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import groups_of_bytes, prefix_hash, range_hash

DIM = 1 << 14
RANK = 8
SAMPLE_ROWS = 8192
GROUP_BYTES = 3 << 20
CUT = 5.0
STRUCTURE = [
    "log_words", "word_length", "symbols", "marks", "shouts", "bars", "capitals", "capital_words", "digits", "other_bytes",
    "distinct_words", "repeated_words", "second_words", "repeated_lines", "line_ends", "long_words",
]
METADATA = ["n_chars"]
OWN = ["held_out", "score", "predicted"]

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _of(characters: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(characters, np.uint8)] = True
    return table


_CLASSES = {"symbols": _of(b"#*$%&<>@^~_+=\\{}[]"), "marks": _of(b".,;:?'\"-()"), "shouts": _of(b"!"), "bars": _of(b"|/"), "digits": _of(b"0123456789")}


@dataclass
class Entries:
    """Features of texts: word entries (text, place, value) by text, and one row of numbers a text."""

    text: np.ndarray
    place: np.ndarray
    value: np.ndarray
    numbers: np.ndarray


class Features(Entries):
    """Features taken from a group of texts."""

    def __init__(self, texts: list[bytes], stated: np.ndarray) -> None:
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
        inside = ~_SPACE[raw]
        edge = np.flatnonzero(np.diff(inside, prepend=False))
        start, end = edge[0::2], edge[1::2]
        first = np.searchsorted(start, bounds)
        words = np.diff(first)
        text = np.repeat(np.arange(len(texts)), words)
        prefix = prefix_hash(_LOWER[raw])
        hashes = range_hash(prefix, start, end)
        size = end - start

        def share(mask: np.ndarray, places: np.ndarray, whole: np.ndarray) -> np.ndarray:
            """Root of the share of set places of each text; small shares are told apart better."""
            held = np.concatenate([[0], np.cumsum(mask)])[places]
            return np.sqrt(np.diff(held) / np.maximum(whole, 1))

        letters = np.diff(np.concatenate([[0], np.cumsum(size)])[first])
        capital = (raw >= 65) & (raw <= 90)
        key = np.sort(text * DIM + (hashes % np.uint64(DIM)).astype(np.int64))
        new = np.flatnonzero(np.diff(key, prepend=-1))
        count = np.diff(np.append(new, len(key)))
        self.text, self.place = key[new] // DIM, key[new] % DIM
        value = np.log1p(count)
        norm = np.sqrt(np.bincount(self.text, value * value, minlength=len(texts)))
        self.value = value / np.maximum(norm, 1e-12)[self.text]

        def again(step: int) -> np.ndarray:
            same = np.zeros(len(start), bool)
            same[step:] = (hashes[step:] == hashes[:-step]) & (text[step:] == text[:-step])
            return share(same, first, words)

        feeds = np.flatnonzero(raw == 10)
        line_start = np.concatenate([[0], feeds[:-1] + 1])
        line_text = np.searchsorted(bounds[1:], feeds, side="right")
        line_text = np.minimum(line_text, len(texts) - 1)
        filled = np.searchsorted(start, feeds) > np.searchsorted(start, line_start)
        line_hash = range_hash(prefix, line_start[filled], feeds[filled])
        order = np.lexsort((line_hash, line_text[filled]))
        t, h = line_text[filled][order], line_hash[order]
        copy = np.zeros(len(order), bool)
        copy[1:] = (t[1:] == t[:-1]) & (h[1:] == h[:-1])
        lines = np.bincount(t, minlength=len(texts))
        columns = {
            "log_words": np.log1p(words),
            "word_length": letters / np.maximum(words, 1),
            **{name: share(table[raw], bounds, letters) for name, table in _CLASSES.items()},
            "capitals": share(capital, bounds, letters),
            "capital_words": share(capital[start] & capital[np.minimum(start + 1, len(raw) - 1)], first, words),
            "other_bytes": share(raw > 127, bounds, letters),
            "distinct_words": np.bincount(self.text, minlength=len(texts)) / np.maximum(words, 1),
            "repeated_words": again(1),
            "second_words": again(2),
            "repeated_lines": np.sqrt(np.bincount(t, copy, minlength=len(texts)) / np.maximum(lines, 1)),
            "line_ends": np.sqrt(lines / np.maximum(words, 1)),
            "long_words": share(size > 24, first, words),
        }
        own = np.array([len(x.decode("utf-8", "replace")) for x in texts])
        stated = np.where(np.isnan(stated), own, np.maximum(stated, 0))
        self.numbers = np.column_stack([*(columns[c] for c in STRUCTURE), np.log1p(stated)])


class Model:
    """Weights and factors: ``DIM`` words, then structure and metadata."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, seed: int = 7) -> None:
        n = DIM + len(mean)
        self.mean, self.spread = mean, spread
        self.bias, self.weight = 0.0, np.zeros(n)
        self.factor = np.random.default_rng(seed).normal(0, 0.02, (n, RANK))

    def scaled(self, numbers: np.ndarray) -> np.ndarray:
        return np.clip((numbers - self.mean) / self.spread, -CUT, CUT)

    def score(self, f: Entries) -> np.ndarray:
        """Scores in time linear in the features."""
        n, x, s = len(f.numbers), f.value, self.scaled(f.numbers)
        words, rest = self.factor[:DIM], self.factor[DIM:]
        linear = self.bias + s @ self.weight[DIM:]
        sums, squares = s @ rest, (s * s) @ (rest * rest).sum(axis=1)
        linear += np.bincount(f.text, self.weight[f.place] * x, minlength=n)
        squares += np.bincount(f.text, (words * words).sum(axis=1)[f.place] * x * x, minlength=n)
        for k in range(RANK):
            sums[:, k] += np.bincount(f.text, words[f.place, k] * x, minlength=n)
        margin = linear + 0.5 * ((sums * sums).sum(axis=1) - squares)
        return 1 / (1 + np.exp(-np.clip(margin, -35, 35)))


def fit(f: Entries, labels: np.ndarray, epochs: int | None = None, batch: int = 128, rate: float = 0.02, decay: float = 2e-4, seed: int = 7) -> Model:
    """Adam on the logistic loss of fixed batches, taken in a new order each epoch; few rows get more epochs."""
    many = len(labels)
    epochs = epochs or int(np.clip(60_000 // max(1, many), 8, 30))
    spread = f.numbers.std(axis=0)
    model = Model(f.numbers.mean(axis=0), np.where(spread > 1e-9, spread, 1.0), seed)
    share = (labels.sum() + 1) / (len(labels) + 2)
    model.bias = float(np.log(share / (1 - share)))
    if len(set(labels.tolist())) < 2:
        return model
    numbers, rng = model.scaled(f.numbers), np.random.default_rng(seed)
    edges = np.searchsorted(f.text, np.arange(many + 1))
    parts = np.array_split(rng.permutation(many), max(1, many // batch))
    fixed = np.arange(DIM, DIM + numbers.shape[1])
    prepared = []
    for rows in parts:
        at = np.concatenate([np.arange(edges[r], edges[r + 1]) for r in rows])
        row = np.concatenate([np.repeat(np.arange(len(rows)), edges[rows + 1] - edges[rows]), np.repeat(np.arange(len(rows)), len(fixed))])
        place = np.concatenate([f.place[at], np.tile(fixed, len(rows))])
        value = np.concatenate([f.value[at], numbers[rows].ravel()])
        order = np.argsort(place, kind="stable")  # gradients add up by place
        used, first = np.unique(place[order], return_index=True)
        prepared.append((labels[rows].astype(float), row[order], place[order], value[order], used, first))
    moments = [np.zeros((len(model.weight), RANK + 1)) for _ in range(2)]
    bias_moments, step = [0.0, 0.0], 0
    for epoch in range(epochs):
        pace = rate * (1 - epoch / epochs)
        for k in rng.permutation(len(prepared)):
            y, row, place, x, used, first = prepared[k]
            step += 1
            v = model.factor[place]
            vx = v * x[:, None]
            sums = np.column_stack([np.bincount(row, vx[:, j], minlength=len(y)) for j in range(RANK)])
            squares = np.bincount(row, (vx * vx).sum(axis=1), minlength=len(y))
            linear = np.bincount(row, model.weight[place] * x, minlength=len(y))
            margin = model.bias + linear + 0.5 * ((sums * sums).sum(axis=1) - squares)
            loss = (1 / (1 + np.exp(-np.clip(margin, -35, 35))) - y) / len(y)
            g = np.column_stack([loss[row] * x, (loss[row] * x)[:, None] * (sums[row] - vx)])
            now = np.column_stack([model.weight[used], model.factor[used]])
            g = np.add.reduceat(g, first, axis=0) + decay * now
            m, q = moments
            m[used] = 0.9 * m[used] + 0.1 * g
            q[used] = 0.999 * q[used] + 0.001 * g * g
            change = pace * (m[used] / (1 - 0.9**step)) / (np.sqrt(q[used] / (1 - 0.999**step)) + 1e-8)
            model.weight[used] -= change[:, 0]
            model.factor[used] -= change[:, 1:]
            gb = loss.sum()
            bias_moments = [0.9 * bias_moments[0] + 0.1 * gb, 0.999 * bias_moments[1] + 0.001 * gb * gb]
            model.bias -= pace * (bias_moments[0] / (1 - 0.9**step)) / (np.sqrt(bias_moments[1] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(key: str = "doc_id") -> Column:
    """True for the third of ids that never teach (crc32 of the id as text, modulo 3, is 1)."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _stated(documents: DataFrame) -> Column:
    return (F.col(METADATA[0]).cast("double") if METADATA[0] in documents.columns else F.lit(None).cast("double")).alias("__stated")


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(float)


def train(documents: DataFrame, labels: DataFrame, target: str = "quality", key: str = "doc_id", rows: int = SAMPLE_ROWS) -> Model | None:
    """The model of at most ``rows`` labelled documents that are not held out; null without any."""
    taught = labels.where(F.col(target).isNotNull() & F.col(key).isNotNull() & ~held_out(key)).groupBy(key).agg(F.min(target).alias("__y"), F.max(target).alias("__max")).where("__y = __max")
    sample = taught.orderBy(F.xxhash64(key), key).limit(rows).select(F.col(key).alias("__id"), F.col("__y").cast("int").alias("__y"))
    met = documents.select(F.col(key).alias("__id"), "text", _stated(documents)).join(F.broadcast(sample), "__id")  # ``rows`` ids at most
    # repeated ids teach once, so that the bound holds for rows too
    once = met.groupBy("__id").agg(F.min_by(F.struct("text", "__stated", "__y"), F.struct(F.length("text"), "text")).alias("r")).select("__id", "r.*")

    kind = dict(once.dtypes)["__id"]

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, raw in groups_of_bytes(batch.column("text"), GROUP_BYTES):
                part = batch.slice(a, len(raw))
                f = Features(raw, _numbers(part.column("__stated")))
                ends = pa.array(np.searchsorted(f.text, np.arange(len(raw) + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (f.place.astype(np.int32), f.value)]
                every = pa.array(np.arange(len(raw) + 1) * f.numbers.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("__id"), part.column("__y"), *lists, pa.ListArray.from_arrays(every, pa.array(f.numbers.ravel()))], ["__id", "__y", "place", "value", "numbers"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held).sort_by("__id").combine_chunks()
            place, value, numbers = (table.column(c).combine_chunks() for c in ("place", "value", "numbers"))
            text = np.repeat(np.arange(table.num_rows), place.value_lengths().to_numpy())
            f = Entries(text, place.flatten().to_numpy().astype(np.int64), value.flatten().to_numpy(), numbers.flatten().to_numpy().reshape(table.num_rows, -1))
            model = fit(f, table.column("__y").to_numpy().astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    rows_of = once.select("__id", "text", "__stated", "__y").mapInArrow(featured, f"__id {kind}, __y int, place array<int>, value array<double>, numbers array<double>")
    found = rows_of.repartition(1).mapInArrow(learn, "model binary").head()  # ``rows`` rows at most
    return pickle.loads(found["model"]) if found else None


def classify(documents: DataFrame, model: Model | None, key: str = "doc_id") -> DataFrame:
    """All columns of ``documents`` but text, and held_out, score (0 to 1), predicted (1 from 0.5 on)."""
    kept = documents.drop(*OWN)
    passed = [f for f in kept.schema.fields if f.name != "text"]
    names = [f.name for f in passed]
    if model is None:
        scored = kept.drop("text").withColumn("score", F.lit(0.5))
    else:
        shared = documents.sparkSession.sparkContext.broadcast(model)  # DIM places

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                stated = _numbers(batch.column("__stated"))
                for a, raw in groups_of_bytes(batch.column("text"), GROUP_BYTES):
                    part = batch.slice(a, len(raw))
                    score = shared.value.score(Features(raw, stated[a : a + len(raw)]))
                    yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(np.round(score, 9))], [*names, "score"])

        kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in passed)
        scored = kept.select(*names, "text", _stated(kept)).mapInArrow(run, kinds + "score double")
    return scored.select(*names, held_out(key).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Contract query: every document scored by what the labelled two thirds teach."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", *METADATA)
    model = train(documents, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    return classify(documents, model).select("doc_id", *OWN)
