"""Generations, diffs, merges and incremental references as joins on slim tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change (removed, modified, added, unchanged) of two manifests(path, hash, size)."""
    a = old.select("path", F.col("hash").alias("h0"), F.col("size").alias("s0"), F.lit(1).alias("in0"))
    b = new.select("path", F.col("hash").alias("h1"), F.col("size").alias("s1"), F.lit(1).alias("in1"))
    same = F.col("h0").eqNullSafe(F.col("h1")) & F.col("s0").eqNullSafe(F.col("s1"))
    change = F.when(F.col("in1").isNull(), "removed").when(F.col("in0").isNull(), "added").when(same, "unchanged").otherwise("modified")
    return a.join(b, "path", "full").select("path", change.alias("change"))


def diff_order() -> list:
    return [F.when(F.col("change") == "removed", 0).when(F.col("change") == "modified", 1).when(F.col("change") == "added", 2).otherwise(3), F.col("path")]


def merge_winners(a: DataFrame, b: DataFrame) -> DataFrame:
    """path, src, mtime, hash, size: of two manifests the newer entry for each path; a tie goes to a."""
    rows = a.select(F.lit("a").alias("src"), "path", "mtime", "hash", "size").union(b.select(F.lit("b").alias("src"), "path", "mtime", "hash", "size"))
    # a path occurs twice at most: the largest (mtime, a before b)
    best = F.max(F.struct("mtime", F.when(F.col("src") == "a", 1).otherwise(0).alias("own"), "src", "hash", "size")).alias("w")
    return rows.groupBy("path").agg(best).select("path", "w.src", "w.mtime", "w.hash", "w.size")


def merge_conflicts(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: overlaps, and conflicts (overlaps whose entry in b is not older)."""
    both = a.select("path", F.col("mtime").alias("ma")).join(b.select("path", F.col("mtime").alias("mb")), "path")
    return both.agg(F.count("*").alias("overlaps"), F.count_if(F.col("mb") >= F.col("ma")).alias("conflicts"))


def merge_blocks(winners: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """hash, src of the blocks that the winners need; a's copy is preferred."""
    needed = winners.select("hash").distinct()
    rows = a.select("hash", F.lit("a").alias("src")).union(b.select("hash", F.lit("b").alias("src")))
    return rows.groupBy("hash").agg(F.min("src").alias("src")).join(needed, "hash", "left_semi")


def incremental_refs(files: DataFrame, base: DataFrame) -> DataFrame:
    """seq, hash, base_seq, external: references against the first block of each hash in a base."""
    first = base.groupBy("hash").agg(F.min("seq").alias("base_seq"))
    return files.select("seq", "hash", "size").join(first, "hash", "left").select("seq", "hash", "size", "base_seq", F.col("base_seq").isNotNull().alias("external"))


def new_blocks(files: DataFrame, known: DataFrame) -> DataFrame:
    """hash, seq of blocks that are not known: one for each hash."""
    return files.groupBy("hash").agg(F.min("seq").alias("seq")).join(known.select("hash").distinct(), "hash", "left_anti")


def as_of(events: DataFrame, generations: DataFrame) -> DataFrame:
    """Latest event of each path up to the end of each generation's day: generation, path, hash, size, mtime.

    events: path, day, order columns ts and event_id, hash, size. The last event of each path and day is
    found first, so that a generation sees one row for each path and day at most. A row is laid out over the
    days that it is the latest of, within the days of the generations, and joined to them by equality.
    """
    daily = events.groupBy("path", "day").agg(F.max(F.struct("ts", "event_id", "hash", "size")).alias("e"))
    until = F.lead("day").over(Window.partitionBy("path").orderBy("day")) - 1
    low, high = generations.agg(F.min("generation"), F.max("generation")).first()
    first = F.greatest(F.col("day"), F.lit(low).cast("long"))
    last = F.least(F.coalesce(until, F.lit(high).cast("long")), F.lit(high).cast("long"))
    spans = daily.withColumns({"first": first, "last": last}).filter("first <= last")
    live = spans.withColumn("generation", F.explode(F.sequence("first", "last")))
    return live.join(F.broadcast(generations), "generation").select("generation", "path", "e.hash", "e.size", F.col("e.ts").alias("mtime"))
