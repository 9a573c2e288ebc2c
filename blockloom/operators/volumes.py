"""Volumes: the greedy cut at the first block boundary past a size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom import schema as S
from blockloom.operators import dedup

#: Running sums over blocks are taken within ranges of so many stored bytes.
RANGE_BYTES = 1 << 34


def split_points(blocks: DataFrame, max_size: int) -> DataFrame:
    """volume_no, cut for blocks(offset, len): a cut where a boundary is max_size or more after the last one.

    The cut resets, so it is a fold, not a window: one ordered stream of numbers, no payload. A batch is
    searched once for each cut, not read once for each block.
    """
    if max_size < S.MIN_VOLUME:
        raise ValueError(f"volumes hold {S.MIN_VOLUME} bytes at least")
    ends = blocks.select((F.col("offset") + F.col("len") + S.BLOCK_HEADER_SIZE).cast("long").alias("boundary"))

    def fold(batches):
        start, number = 0, 0
        for pdf in batches:
            ends, cuts = pdf["boundary"].to_numpy(), []
            while (k := int(np.searchsorted(ends, start + max_size))) < len(ends):
                number, start = number + 1, int(ends[k])
                cuts.append((number, start))
            yield pd.DataFrame(cuts, columns=["volume_no", "cut"])

    return ends.repartitionByRange(1, "boundary").sortWithinPartitions("boundary").mapInPandas(fold, "volume_no long, cut long")


def assign(blocks: DataFrame, cuts: DataFrame) -> DataFrame:
    """blocks(offset, len, ...) with volume_no (from 1): one more than the cuts at or before its offset.

    A cut is the end of a block, so it marks that block, and the marks before a block are its running sum.
    """
    ends = F.col("offset") + F.col("len") + S.BLOCK_HEADER_SIZE
    marked = blocks.join(cuts.select("cut", F.lit(1).alias("mark")), ends == F.col("cut"), "left")
    rows = dedup.running(marked, "offset", {"volumes_before": F.coalesce("mark", F.lit(0))}, RANGE_BYTES)
    return rows.withColumn("volume_no", F.col("volumes_before") + 1).drop("volumes_before", "cut", "mark")


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """volume_no, blocks, bytes of the volumes below a folder."""
    rows = spark.read.parquet(f"{folder}/volumes")
    return rows.groupBy(F.col("volume_no").cast("long").alias("volume_no")).agg(F.count("*").alias("blocks"), F.sum("compressed_size").alias("bytes"))


def check(spark: SparkSession, folder: str) -> None:
    """Raise unless every volume that was written is there with all its blocks."""
    want = spark.read.parquet(f"{folder}/inventory")
    bad = want.join(inventory(spark, folder), ["volume_no", "blocks", "bytes"], "left_anti").agg(F.min("volume_no"), F.count("*")).first()
    if bad[1]:
        raise ValueError(f"{bad[1]} volumes are missing or short, the first is {bad[0]}")
