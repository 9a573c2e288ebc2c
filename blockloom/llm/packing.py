"""Operator 8: best-fit packing after Martello-Toth dominance reduction.

Lengths are whole numbers up to the capacity, so the instance is its histogram: at most
`capacity` counts, however many documents there are. The driver plans on that histogram and
never sees a document. The plan is a list of rank intervals for each length; executors rank the
pieces of each length and look their interval up.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockloom.llm.bpe import encoder
from blockloom.llm.common import emit, id_and_text, slices, store, texts_of

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def piece_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: the first takes what full pieces leave."""
    rest = n % capacity or capacity
    return [rest] + [capacity] * ((n - rest) // capacity)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int = 0) -> DataFrame:
    def run(batches):
        for b in slices(batches):
            rows: list[tuple] = []
            for doc, raw in zip(b.column("doc_id").to_pylist(), encoder(tokenizer_path).id_bytes(texts_of(b)), strict=True):
                raw += end_id.to_bytes(4, "little")
                at = 0
                for k, n in enumerate(piece_lengths(len(raw) // 4, capacity)):
                    rows.append((doc, k, at, n, zlib.crc32(raw[4 * at : 4 * (at + n)])))
                    at += n
            yield emit(PIECES, **dict(zip(PIECES.names, zip(*rows, strict=True), strict=True)))

    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Plan:
    """Sequences of equal content are one group: [count, room, [(length, first rank of that length)]]."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = np.zeros(capacity + 2, np.int64)
        for n, c in histogram.items():
            self.left[n] = c
        self.used = np.zeros(capacity + 2, np.int64)
        self.groups: list[list] = []
        self.open: dict[int, list[int]] = {}
        self.fixed = 0
        self._reduce()
        self._best_fit()

    def _take(self, n: int, count: int) -> tuple[int, int]:
        first = int(self.used[n])
        self.used[n] += count
        self.left[n] -= count
        return n, first

    def _fix(self, sizes: tuple[int, ...], count: int) -> None:
        """Sequences that some optimal packing holds: they close here, whatever room they have."""
        self.groups.append([count, 0, [self._take(n, count) for n in sizes]])
        self.fixed += count

    def _smallest_two(self, but: int) -> int:
        """Sum of the two smallest pieces left beside one piece of length but; large if there are not two."""
        low = np.flatnonzero(self.left[: self.capacity + 1] - (np.arange(self.capacity + 1) == but) > 0)
        if not len(low):
            return 4 * self.capacity
        a = int(low[0])
        if self.left[a] - (a == but) > 1:
            return 2 * a
        return a + int(low[1]) if len(low) > 1 else 4 * self.capacity

    def _reduce(self) -> None:
        """Martello-Toth reduction, for all pieces of a length at once, until nothing more is dominated.

        For a piece j and the room r beside it: nothing fits beside j: {j}. Some k fills r exactly:
        {j, k}, as whatever else shares a sequence with j fits in k's place. No two pieces fit
        beside j: {j, k} with the largest k that fits.
        """
        again = True
        while again:
            again = False
            for j in range(self.capacity, 0, -1):
                while self.left[j]:
                    room = self.capacity - j
                    fits = np.flatnonzero(self.left[: room + 1] - (np.arange(room + 1) == j) > 0)
                    if not len(fits):
                        self._fix((j,), int(self.left[j]) if room < j else 1)
                    elif (k := int(fits[-1])) == room or self._smallest_two(j) > room:
                        self._fix((j, k), int(self.left[j] // 2) if j == k else int(min(self.left[j], self.left[k])))
                    else:
                        break
                    again = True

    def _put(self, n: int, count: int, room: int) -> None:
        """count pieces of length n, one each, into open sequences with that room."""
        stack = self.open[room]
        while count:
            g = stack[-1]
            have, _, content = self.groups[g]
            if have > count:  # only a part of the group takes one
                self.groups.append([count, room, content])
                self.groups[g] = [have - count, room, [(m, first + count) for m, first in content]]
                g, have = len(self.groups) - 1, count
            else:
                stack.pop()
            self.groups[g] = [have, room - n, [*self.groups[g][2], self._take(n, have)]]
            self.open.setdefault(room - n, []).append(g)
            count -= have
        if not stack:
            del self.open[room]

    def _best_fit(self) -> None:
        for n in range(self.capacity, 0, -1):
            while count := int(self.left[n]):
                rooms = sorted(self.open)
                at = bisect.bisect_left(rooms, n)
                if at < len(rooms):
                    there = sum(self.groups[g][0] for g in self.open[rooms[at]])
                    self._put(n, min(count, there), rooms[at])
                    continue
                each = self.capacity // n
                count, each = (count // each, each) if count >= each else (1, count)
                content = [self._take(n, count) for _ in range(each)]
                self.groups.append([count, self.capacity - n * each, content])
                self.open.setdefault(self.capacity - n * each, []).append(len(self.groups) - 1)

    def rows(self) -> list[tuple[int, int, int, int, int]]:
        """(length, first rank, end rank, sequence of rank 0, offset)"""
        out, sequence = [], 0
        for count, _, content in self.groups:
            at = 0
            for n, first in content:
                out.append((n, first, first + count, sequence - first, at))
                at += n
            sequence += count
        return out

    @property
    def sequences(self) -> int:
        return sum(g[0] for g in self.groups)


def ranked(table: DataFrame, key: str, order: list[str], counts: dict[int, int], block_rows: int) -> DataFrame:
    """Add rank: 0, 1, ... in each key. A key of more than block_rows rows (by counts, all keys' numbers of rows) is dealt
    into blocks; what blocks hold adds up to the next blocks' first ranks. Other keys are ranked as they are."""
    spark = table.sparkSession
    hot = [(k, -(-n // block_rows)) for k, n in counts.items() if n > block_rows]
    deals = spark.createDataFrame(hot, f"hot_{key} long, blocks long")  # a row for a length at most
    table = table.join(F.broadcast(deals), F.col(key) == F.col(f"hot_{key}"), "left").drop(f"hot_{key}")
    table = table.withColumn("block", F.coalesce(F.pmod(F.xxhash64(*order), F.col("blocks")), F.lit(0).cast("long")))
    first = table.filter("blocks IS NOT NULL").groupBy(key, "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = first.select(key, "block", before.alias("first"))
    inside = table.withColumn("in_block", F.row_number().over(Window.partitionBy(key, "block").orderBy(*order)) - 1)
    return inside.join(first, [key, "block"], "left").withColumn("rank", F.coalesce("first", F.lit(0)) + F.col("in_block")).drop("block", "blocks", "first", "in_block")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", block_rows: int = 2000) -> DataFrame:
    """Pack documents' token ids, each ended by end_id, into sequences of at most capacity tokens.

    One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Only documents
    longer than capacity are cut. Null or empty text: the end id alone. Repeated rows are packed each;
    rows of equal doc_id and piece number take their places in any order. Other columns are not looked at.
    Empty table: empty result. The broadcast plan has at most some rows for each length, not for each document.
    """
    table = store(pieces(id_and_text(docs, id_col, text_col), tokenizer_path, capacity, end_id), "pieces")
    spark = docs.sparkSession
    histogram = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = spark.createDataFrame(Plan(histogram, capacity).rows(), "p_length long, low long, high long, base long, offset long")
    ranks = ranked(table, "length", ["doc_id", "piece", "ids_crc32"], histogram, block_rows)
    hit = (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    return ranks.join(F.broadcast(plan), hit).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("sequence_id"), "offset")
