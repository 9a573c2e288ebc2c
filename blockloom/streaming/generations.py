"""Streaming extension: each micro-batch of files becomes a generation of an archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from blockloom.operators.archive import Archive, Options


def append_stream(files: DataFrame, path: str, checkpoint: str, options: Options | None = None) -> StreamingQuery:
    """Start appending a stream of files(seq, path, content). A batch that is run again after a failure is written once."""

    def commit(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        batch = batch.persist()
        if number == 0:
            Archive.create(batch, path, options)
        elif Archive(spark, path).generation < number:
            Archive(spark, path).append(batch)
        batch.unpersist()

    return files.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen_within(chunks: DataFrame, time_column: str, delay: str) -> DataFrame:
    """Dedup with bounded state: a hash is forgotten once the watermark has passed it, and later copies count as new."""
    return chunks.withWatermark(time_column, delay).dropDuplicatesWithinWatermark(["hash"])
