"""The corpus pipeline: five stages from raw documents to packed token files.

Each stage takes (spark, docs, folder of the tables) and returns a DataFrame, which is written and read back as the
next one's documents. All but the last return the columns of ``documents``.

1. quality: documents that the classifier rejects go.
2. near_dedup: of each class of near duplicates the document of the least id stays.
3. decontaminate: documents that contain a benchmark item go.
4. mix: sources are mixed to their target weights; a row is a pass over a document, its text the words taken in it.
5. pack: the texts as token ids in packed files; a row per document with its place, length and checksum, read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tephra.llm import decontaminate, dedup, mixing, packing, quality
from tephra.session import bounded_batches, written


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier does not reject."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return dedup.keep_first(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that contain no benchmark item."""
    bounded_batches(spark)
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents mixed to the sources' target weights, one row for each pass over a document."""
    return mixing.apply_mix(docs, mixing.plan_mix(docs))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token files, read back."""
    bounded_batches(spark)
    return packing.read_tokens(packing.write_tokens(docs, tokenizer="byte_bpe_50k.json", end_id=2))


STAGES = [("quality", filter_quality), ("near_dedup", near_dedup), ("decontaminate", drop_benchmark), ("mix", mix_sources), ("pack", pack_tokens)]

#: No stage but the choice of one document of a class can be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
