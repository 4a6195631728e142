"""Token counts from counts per distinct pre-token.

Byte-fallback BPE over white-space marks never joins a piece across the start of a run of spaces, nor across a line
feed, which no piece of the vocabulary holds; both facts are checked on the model before use. A text is thus a sequence
of pre-tokens whose piece counts add up. Pieces are counted once per distinct pre-token of the corpus; the counts are
joined to each document's pre-token frequencies and summed, and no ids of documents are ever made.

Pre-token frequencies follow a power law, so the join has two parts. The most frequent pre-tokens, at most ``HEAD``
whatever the corpus, are looked up in a broadcast table while a document's frequencies are made; all others are
joined by a shuffle. The frequent keys are so never shuffled, and the rest are not skewed.

Definitions: null and empty texts have 0 tokens and 0 bytes. No begin, end or added special tokens; strings of control
tokens inside texts are ordinary text, as the library treats them by default. Each input row gives one row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize

#: Bound on the broadcast part of the join; a head entry takes about 100 bytes in a Python worker.
HEAD = 200_000
#: A task passes on its counts when it holds this many distinct pre-tokens.
FLUSH = 400_000
_RUNS = re.compile(r"\n[^ \n]*| +[^ \n]*")


@lru_cache(maxsize=2)
def load_model(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any("▁" in p.lstrip("▁") or "\n" in p for p in pieces):
        raise ValueError("a piece crosses a space or holds a line feed: pre-tokens are not independent")
    if [model.encode(x, out_type=str) for x in ("a", " a")] != [["▁a"], ["▁", "▁a"]]:
        raise ValueError("the model must add a leading space mark and keep white space")
    return model


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens in order. One that starts with a line feed follows no space; of any other the first space is left out."""
    if "▁" in text:
        text = text.replace("▁", " ")
    if "  " in text or text.startswith(" "):
        return [x if x[0] == "\n" else x[1:] for x in _RUNS.findall(" " + text)]
    if "\n" not in text:
        return text.split(" ") if text else []
    first, *rest = text.split("\n")
    out = first.split(" ")  # a text that starts with a line feed still has the mark before it
    for line in rest:
        head, *more = line.split(" ")
        out.append("\n" + head)
        out += more
    return out


def count_pieces(model, tokens: list[str]) -> list[int]:
    """Pieces of each pre-token."""
    sizes = map(len, model.encode(tokens, num_threads=1))
    return [1 if not t else n - 1 if t[0] == "\n" else n for t, n in zip(tokens, sizes)]


def vocabulary(documents: DataFrame, model_path: str) -> DataFrame:
    """(token, freq, pieces) of every distinct pre-token; tasks add up before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["token", "freq"])
            seen.clear()
            for a in range(0, out.num_rows, 50_000):
                yield out.slice(a, 50_000)

        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(pre_tokens(text))
                if len(seen) >= FLUSH:
                    yield from flush()
        yield from flush()

    def pieces(batch: pa.RecordBatch):
        n = count_pieces(load_model(model_path), batch.column("token").to_pylist())
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int32())], ["token", "freq", "pieces"])

    counted = documents.where("text is not null").select("text").mapInArrow(count, "token string, freq long")
    return map_arrow(counted.groupBy("token").agg(F.sum("freq").alias("freq")), pieces, "token string, freq long, pieces int")


def most_frequent(vocab: DataFrame, head: int) -> DataFrame:
    """The most frequent pre-tokens, as many whole classes of frequency (eighths of an octave) as ``head`` holds."""
    graded = vocab.withColumn("grade", F.floor(8 * F.log2("freq")).cast("int"))
    total, least = 0, None
    for r in sorted(graded.groupBy("grade").count().collect(), reverse=True):  # at most 8 * 63 rows
        total += r["count"]
        if total > head:
            break
        least = r["grade"]
    return graded.where(F.col("grade") >= least) if least is not None else graded.limit(0)


def count_tokens(documents: DataFrame, model_path: str, head: int = HEAD) -> DataFrame:
    """All columns of ``documents`` but text, and n_bytes, n_tokens (long); columns of these names are replaced."""
    spark = documents.sparkSession
    vocab = materialize(vocabulary(documents, model_path), "vocabulary")
    frequent = most_frequent(vocab, head).select("token", "pieces").toPandas()  # at most ``head`` rows
    table = spark.sparkContext.broadcast(dict(zip(frequent["token"], frequent["pieces"].tolist())))

    def frequencies(batch: pa.RecordBatch):
        known, sums, tokens, counts, sizes = table.value, [], [], [], [0]
        for text in batch.column("text").to_pylist():
            total = 0
            for token, n in Counter(pre_tokens(text or "")).items():
                pieces = known.get(token)
                if pieces is None:
                    tokens.append(token)
                    counts.append(n)
                else:
                    total += n * pieces
            sums.append(total)
            sizes.append(len(tokens))
        rest = pa.ListArray.from_arrays(
            pa.array(np.array(sizes, np.int32)), pa.StructArray.from_arrays([pa.array(tokens, pa.string()), pa.array(counts, pa.int32())], ["token", "n"])
        )
        others = [i for i, name in enumerate(batch.schema.names) if name != "text"]
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in others), pa.array(sums, pa.int64()), rest], [*(batch.schema.names[i] for i in others), "__head", "__rest"])

    passed = [c for c in documents.columns if c not in ("text", "n_bytes", "n_tokens")]
    rows = documents.select(*passed, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")
    found = map_arrow(rows, frequencies, f"{kinds}, __head long, __rest array<struct<token:string,n:int>>")
    found = materialize(found.withColumn("__row", F.monotonically_increasing_id()), "frequencies")  # written: row numbers stay
    rest = found.select("__row", F.inline("__rest")).join(vocab.select("token", "pieces"), "token")
    sums = rest.groupBy("__row").agg(F.sum(F.col("n") * F.col("pieces")).alias("__sum"))
    return found.drop("__rest").join(sums, "__row", "left").withColumn("n_tokens", F.col("__head") + F.coalesce("__sum", F.lit(0).cast("long"))).drop("__row", "__head", "__sum")


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    """Contract query: tokens of every document."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counted = count_tokens(documents, public_tokenizers.path("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)
