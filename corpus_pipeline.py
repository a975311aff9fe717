"""A corpus pipeline: toxic texts, repeated lines, near-duplicates and benchmark leaks go; the rest is tokenized.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. All
but the last return the columns of documents:

- toxicity: rows that score THRESHOLD or more go.
- line_dedup: lines that occur earlier (or within a word of it) go; a document without any
  text left goes with them. n_chars follows the text.
- near_dup: of each component of 5-word shingles with a similarity of 0.8 the row of the
  smallest doc_id stays.
- decontamination: rows that hold ten consecutive words of a benchmark item go.
- bpe: doc_id, n_tokens, ids and the decoded text of each row.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from typeloom.llm import bpe, decontaminate, line_dedup, near_dup, toxicity
from typeloom.llm.common import remove, shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.thin(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.reject(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_dup", drop_near_duplicates), ("decontamination", drop_leaks), ("bpe", tokenize)]

#: The toxicity model and the tokens are beyond SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; a stage's table goes when the next one stands."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return docs
