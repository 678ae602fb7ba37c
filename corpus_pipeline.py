"""Documents to tokens: quality rules, near duplicates, repeated passages, benchmark leaks, byte-level BPE.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's documents. SQL cannot express the stages (estimated votes, encoding), so there is no check SQL;
``tests/llm/test_pipeline.py`` compares the stages with brute force.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.bpe import encode
from siftline.llm.decontaminate import without_leaks
from siftline.llm.jaccard import one_per_group
from siftline.llm.quality import keep_good
from siftline.llm.substring import without_repeats
from siftline.session import checkpoint_root

ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the posterior quality keep."""
    return keep_good(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates the document with the smallest id."""
    return one_per_group(docs, words=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay only in the document with the smallest id."""
    out = without_repeats(docs, length=50)
    return out.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, their count, and whether they decode to the text."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = encode(docs, ranks, public_tokenizers.PATTERN, bytes_col="decoded", cached=60_000)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return found.withColumn("round_trip", same).select("doc_id", "lang", "source", "n_chars", "n_tokens", "token_ids", "round_trip")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("byte-level BPE encoding and decoding", byte_level_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{checkpoint_root(spark)}/siftline/pipeline-{number}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
