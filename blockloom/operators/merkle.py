"""Merkle root: pairs are hashed together, an odd last node goes up as it is; ten levels a round."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of the tree that one partial aggregate folds: 2^LEVELS leaves are one row then.
LEVELS = 10


def _level(nodes: Column) -> Column:
    """The level above an array of hex digests."""
    left = lambda i: F.get(nodes, 2 * i)
    right = lambda i: F.get(nodes, 2 * i + 1)
    half = F.floor((F.size(nodes) + 1) / 2).cast("int")
    return F.transform(F.sequence(F.lit(0), half - 1), lambda i: F.when(right(i).isNull(), left(i)).otherwise(F.sha2(F.concat(left(i), right(i)), 256)))


def merkle_root(leaves: DataFrame) -> DataFrame:
    """One row, root, for leaves(i, hash): i counts from 0 without gaps. No leaves: no row."""
    level = leaves.select(F.col("i").cast("long"), "hash")
    n = leaves.count()
    while n > 1:
        group = level.groupBy(F.shiftright("i", LEVELS).alias("i")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "hash"))), lambda x: x["hash"]).alias("nodes"))
        top = F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), F.col("nodes"), lambda nodes, _: _level(nodes))
        level = group.select("i", F.get(top, F.lit(0)).alias("hash"))
        n = -(-n // (1 << LEVELS))
    return level.select(F.col("hash").alias("root"))
