"""Streams: windows with watermarks, statistics that grow by batch, merges into tables. Results equal those of the batch operators on the same rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tephra.operators.stats import gram_entries


def _timed(events: DataFrame, time: str, late: str) -> DataFrame:
    """The watermarked stream; times without a zone count in the session's."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def tumbling(events: DataFrame, time: str, size: str, late: str, by: Sequence[str], **aggregates: Column) -> DataFrame:
    """Aggregates by window and key; rows later than ``late`` behind the newest are dropped."""
    return _timed(events, time, late).groupBy(F.window(time, size), *by).agg(*[c.alias(n) for n, c in aggregates.items()])


def sliding(events: DataFrame, time: str, size: str, step: str, late: str, by: Sequence[str], **aggregates: Column) -> DataFrame:
    return _timed(events, time, late).groupBy(F.window(time, size, step), *by).agg(*[c.alias(n) for n, c in aggregates.items()])


def sessions(events: DataFrame, time: str, gap: str, late: str, by: Sequence[str], **aggregates: Column) -> DataFrame:
    """Aggregates by key and session: rows closer than ``gap`` belong together."""
    return _timed(events, time, late).groupBy(*by, F.session_window(time, gap)).agg(*[c.alias(n) for n, c in aggregates.items()])


def distinct(events: DataFrame, time: str, late: str, keys: Sequence[str]) -> DataFrame:
    """The first row of each key within the watermark."""
    return _timed(events, time, late).dropDuplicatesWithinWatermark(list(keys))


def growing_gram(rows: DataFrame, features: Sequence[Column], y: Column, w: Column, path: str, checkpoint: str) -> StreamingQuery:
    """Append each batch's Gram entries under its number; ``total_gram`` adds them up. A batch that runs again writes its own folder again."""

    def add(batch: DataFrame, number: int) -> None:
        gram_entries(batch, features, y, w).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}_")

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def total_gram(spark, path: str) -> DataFrame:
    """The sum of all batches' entries."""
    parts = spark.read.option("recursiveFileLookup", "true").parquet(path)
    return parts.agg(*[F.sum(c).alias(c) for c in parts.columns if c != "batch"])


def merge_into(updates: DataFrame, path: str, key: Sequence[str], order: Column, checkpoint: str) -> StreamingQuery:
    """Keep a table with the newest row of each key: every batch is merged with the table's current version and written as the next."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number:
            batch = spark.read.parquet(f"{path}/v{number - 1}").unionByName(batch)
        newest = batch.groupBy(*key).agg(F.max_by(F.struct(*batch.columns), order).alias("_r")).select("_r.*")
        newest.write.mode("overwrite").parquet(f"{path}/v{number}")

    return updates.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
