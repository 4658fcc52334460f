"""The queries ``opN_<name>``: each applies one operator, with production parameters, to its whole table.

Every function takes (spark, folder of the tables) and returns a DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tephra.llm import chat, decontaminate, dedup, langid, lm, mixing, mpeg, packing, quality, toxicity
from tephra.session import bounded_batches, written

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_lm(spark: SparkSession, folder: str) -> DataFrame:
    """Every text's probability under a trie of three-word runs of the training texts."""
    return lm.rate_documents(table(spark, folder, "documents"))


def op2_mpeg(spark: SparkSession, folder: str) -> DataFrame:
    """Every text stored in MPEG audio frames and read back from them."""
    return mpeg.read_media(mpeg.store_texts(table(spark, folder, "documents")))


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.plan_mix(table(spark, folder, "documents")).drop("spans", "text_sha256")


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document."""
    return quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op5_langid(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document."""
    return langid.classify(table(spark, folder, "documents"))


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, with its nearest labelled examples."""
    return toxicity.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op7_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The class of near duplicates of every document."""
    return dedup.near_classes(table(spark, folder, "documents"))


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's place, length and checksum, read back from the packed files."""
    docs = table(spark, folder, "documents")
    files = packing.write_tokens(docs, tokenizer="byte_bpe_50k.json", end_id=2)
    return packing.read_tokens(files).select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that contain a benchmark item, with the item."""
    return decontaminate.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op10_chat(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation, written as a raw transcript, parsed back into turns: its canonical form and whether all turns came back.

    The model learns from conversations whose crc32(conv_id as text) mod 5 is not 0; the others are held out.
    """
    raw = written(chat.transcripts(table(spark, folder, "conversations")), "transcripts")
    out = quality.held_out(F.col("conv_id"), 5, 0)
    parsed = chat.parse(raw, chat.fit_on(raw.where(~out)), keep=("style", "true_turns"))
    same = F.transform("turns", lambda t: t["role"]) == F.transform("true_turns", lambda t: t["role"])
    whole = same & (F.transform("turns", lambda t: F.trim(t["text"])) == F.transform("true_turns", lambda t: F.trim(t["text"])))
    return parsed.select("conv_id", out.alias("held_out"), "style", "n_turns", F.size("true_turns").alias("n_true"), same.alias("roles_match"), whole.alias("turns_match"), "rendered", "log_prob")


QUERIES: dict[str, Query] = {
    "op1_lm": op1_lm,
    "op2_mpeg": op2_mpeg,
    "op3_mixing": op3_mixing,
    "op4_quality": op4_quality,
    "op5_langid": op5_langid,
    "op6_toxicity": op6_toxicity,
    "op7_near_dedup": op7_near_dedup,
    "op8_packing": op8_packing,
    "op9_decontaminate": op9_decontaminate,
    "op10_chat": op10_chat,
}

ORACLES: dict[str, str] = {}
