"""Content dedup: first-wins unique blocks, references, offsets and groups.

Hashes may be heavily repeated, so the first row of each hash comes from a partial aggregate and a
join, not from a window over the hash. Running sums over the write order are taken in two steps, so
that no task sorts all blocks: sums within ranges of seq, then the ranges' own starts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom import schema as S
from blockloom.scratch import store


def running(df: DataFrame, order: str, sums: dict[str, Column], span: int = 100_000) -> DataFrame:
    """Add, for each name, the sum of its column over all rows before this one by order (0 for the first)."""
    part = df.withColumn("_range", F.floor(F.col(order) / span)).withColumns({f"_{k}": v for k, v in sums.items()})
    totals = part.groupBy("_range").agg(*[F.sum(f"_{k}").alias(f"t_{k}") for k in sums])
    by_range = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range of `span` blocks
    starts = totals.select("_range", *[F.coalesce(F.sum(f"t_{k}").over(by_range), F.lit(0)).alias(f"s_{k}") for k in sums])
    inside = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = part.withColumns({f"i_{k}": F.coalesce(F.sum(f"_{k}").over(inside), F.lit(0)) for k in sums}).join(starts, "_range")
    return out.withColumns({k: (F.col(f"s_{k}") + F.col(f"i_{k}")).cast("long") for k in sums}).drop("_range", *[f"{p}_{k}" for k in sums for p in ("s", "i")], *[f"_{k}" for k in sums])


def by_ranges(df: DataFrame, *order: str) -> DataFrame:
    """df dealt by ranges of its order columns over all tasks, as a stored table with the range's number in _range.

    Stored, because where the borders lie comes from a sample: what is counted and what is numbered must agree.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return store(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def numbered(df: DataFrame, order: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Like running(), over several order columns of any values: nothing depends on how dense they are."""
    placed = by_ranges(df.withColumns({f"_{k}": v for k, v in sums.items()}), *order)
    totals = placed.groupBy("_range").agg(*[F.sum(f"_{k}").alias(f"t_{k}") for k in sums])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each task
    starts = totals.select("_range", *[F.coalesce(F.sum(f"t_{k}").over(before), F.lit(0)).alias(f"s_{k}") for k in sums])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumns({f"i_{k}": F.coalesce(F.sum(f"_{k}").over(inside), F.lit(0)) for k in sums}).join(F.broadcast(starts), "_range")
    return out.withColumns({k: (F.col(f"s_{k}") + F.col(f"i_{k}")).cast("long") for k in sums}).drop("_range", *[f"{p}{k}" for k in sums for p in ("s_", "i_", "_")])


def _words(ids: DataFrame, number: str | None = None) -> DataFrame:
    """ids(_row) packed by 64 rows: _word, its bits and, for a number that each row has, the word's first number; all numbers where they don't follow each other."""
    bits = F.expr("bit_or(shiftleft(1L, cast(_row & 63 AS int)))").alias("_bits")
    by_word = ids.groupBy(F.shiftright("_row", 6).alias("_word"))
    if number is None:
        return by_word.agg(bits)
    rows = by_word.agg(bits, F.min(number).alias("_first"), F.transform(F.sort_array(F.collect_list(F.struct("_row", number))), lambda x: x[number]).alias("_all"))
    follow = F.col("_all") == F.expr("sequence(_first, _first + size(_all) - 1)")
    return rows.withColumn("_all", F.when(~follow, F.col("_all")))


def placed(rows: DataFrame, numbers: DataFrame, number: str) -> DataFrame:
    """The rows(_row, ...) that a table(_row, number) has, with their number. Row ids are distinct.

    What is joined to the rows is a bit for each, and one number for 64 rows where numbers go up with row ids, as they do
    for rows that lie in order. That table is stored, so that the planner knows its size: rows with large values move
    only where it is too large to be sent to all tasks.
    """
    words = store(_words(numbers.select("_row", F.col(number).cast("long").alias(number)), number), "words")
    found = rows.join(words, F.shiftright("_row", 6) == F.col("_word")).filter("(_bits & shiftleft(1L, cast(_row & 63 AS int))) <> 0")
    rank = "bit_count(_bits & ~shiftleft(-1L, cast(_row & 63 AS int)))"
    return found.withColumn(number, F.expr(f"coalesce(get(_all, {rank}), _first + {rank})")).drop("_row", "_word", "_bits", "_first", "_all")


def marked(rows: DataFrame, ids: DataFrame, mark: str) -> DataFrame:
    """All rows(_row, ...) and whether a table(_row) has them; the rows move as little as in placed()."""
    words = store(_words(ids), "words")
    found = rows.join(words, F.shiftright("_row", 6) == F.col("_word"), "left")
    return found.withColumn(mark, F.expr("coalesce(_bits & shiftleft(1L, cast(_row & 63 AS int)), 0) <> 0")).drop("_row", "_word", "_bits")


def first_seen(chunks: DataFrame) -> DataFrame:
    """hash, first_seq, uses of every distinct hash."""
    return chunks.groupBy("hash").agg(F.min("seq").alias("first_seq"), F.count("*").alias("uses"))


def unique_blocks(chunks: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """seq, hash, len, block_seq (from 0), offset of the blocks written, in write order. chunks: seq, hash, len."""
    first = (seen or first_seen(chunks)).select(F.col("first_seq").alias("seq"), "hash", "uses")
    blocks = chunks.select("seq", "hash", "len").join(first, ["seq", "hash"])
    blocks = running(blocks, "seq", {"block_seq": F.lit(1), "bytes_before": F.col("len") + S.BLOCK_HEADER_SIZE})
    return blocks.select("seq", "hash", "len", "uses", "block_seq", (F.col("bytes_before") + S.HEADER_SIZE).alias("offset"))


def block_refs(chunks: DataFrame) -> DataFrame:
    """seq, hash, len, is_new, offset of the block that each chunk refers to."""
    blocks = unique_blocks(chunks).select("hash", F.col("seq").alias("first_seq"), "offset")
    return chunks.select("seq", "hash", "len").join(blocks, "hash").select("seq", "hash", "len", (F.col("seq") == F.col("first_seq")).alias("is_new"), "offset")


def dedup_stats(chunks: DataFrame) -> DataFrame:
    """One row: block_count, unique_blocks, input_bytes, unique_bytes, dedup_savings."""
    by_hash = chunks.groupBy("hash").agg(F.count("*").alias("n"), F.sum("len").alias("bytes"), F.min("len").alias("len"))
    return by_hash.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("block_count"), F.count("*").alias("unique_blocks"), F.sum("bytes").alias("input_bytes"), F.sum("len").alias("unique_bytes"), (F.sum("bytes") - F.sum("len")).alias("dedup_savings"))


def capped_stats(chunks: DataFrame, cap: int) -> DataFrame:
    """What a store that remembers only the first `cap` hashes does: written blocks, hits, overflow."""
    first = running(first_seen(chunks), "first_seq", {"rank": F.lit(1)}).select("hash", "rank", "uses")
    hit = F.col("rank") < cap
    return first.agg(F.sum(F.when(hit, 1).otherwise(F.col("uses"))).alias("written"), F.sum(F.when(hit, F.col("uses") - 1).otherwise(0)).alias("hits"), F.sum(F.when(hit, 0).otherwise(F.col("uses"))).alias("overflow"))


def ecc_plan(blocks: DataFrame, data: int = S.ECC_DATA) -> DataFrame:
    """group_id, shards, shard_size, data_bytes: groups of consecutive unique blocks."""
    return blocks.groupBy(F.floor(F.col("block_seq") / data).alias("group_id")).agg(F.count("*").alias("shards"), F.max("len").alias("shard_size"), F.sum("len").alias("data_bytes"))
