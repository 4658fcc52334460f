"""The SQL front end: tables of a folder as views, queries in text, checked column names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def register(spark: SparkSession, folder: str, tables: Sequence[str] = TABLES) -> None:
    """Parquet tables of a folder as temporary views of this session."""
    for name in tables:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)


def sql(spark: SparkSession, folder: str, text: str, **values) -> DataFrame:
    """The result of a query over a folder's tables; ``:name`` in the text takes a value, never pasted into it."""
    register(spark, folder)
    return spark.sql(text, args=values or None)
