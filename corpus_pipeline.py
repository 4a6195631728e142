"""Training-corpus pipeline: quality rules, SimHash near-dedup, decontamination, mixing, token-id store.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame. ``run`` writes each stage's rows to the shared folder and
reads them again for the next, so a lost executor costs one stage's work at most. All stages but the last return the columns of
documents (doc_id, text, lang, source, n_chars); the last returns what is read back from the token-id files.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import decontamination, mixing, quality_rules, token_store, wide_simhash
from tracewright.llm.common import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that the rules reject go."""
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5, by wide fingerprints: of each group of texts that share 0.8 of their shingles of five words one document stays."""
    return wide_simhash.keep_one(docs).select(COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: contaminated documents go."""
    judged = decontamination.judge(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return judged.where(~F.col("contaminated")).select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents repeat as often as the mix takes their words; of which it takes none leave."""
    return mixing.repeat_documents(docs).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: a row per document of the mix, repeats included, read back from the token-id store."""
    return token_store.read_summaries(spark, token_store.write_store(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("token ids", tokens),
]
#: Fingerprints and the tokenizer's ids have no SQL form; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
