"""Operator 7: exact duplicates by distributed MSD radix partitioning.

1. Each task splits its own normalised texts by successive digits of bytes until a group has one text or
   its texts have ended, and keeps one text for each group of equals. A text that makes up a third of all
   rows leaves a task once, or once for each time that the task's memory of texts is full.
2. The kept texts are dealt by their leading bytes. A prefix with more bytes than a task should
   hold is split by further bytes, level after level, until it is small enough or its texts end. One that has
   ended and is still too large is one text that many tasks hold: it is dealt by task as well, and what those
   parts keep is joined in a round more.
3. Each task joins its texts by the same recursion; only small (part, keeper) rows go back.

Texts are compared byte by byte throughout; the SHA-256 in the result is output, not a key.
"""

from __future__ import annotations

import functools
import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import BLANKS, discard, emit, hold, id_and_text, slices, store

TEXTS = [("part", pa.int64()), ("norm", pa.binary()), ("size", pa.int64()), ("points", pa.int64()), ("keep_id", pa.int64()), ("keep_row", pa.int64())]
#: Rows (row, part, doc_id) and texts (no row) of a task.
LOCAL = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), *TEXTS])
#: Texts, and where parts that have no text any more went (whole).
JOINED = pa.schema([*TEXTS, ("whole", pa.int64())])
MERGED = pa.schema([("part", pa.int64()), ("keep_row", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("text_sha256", pa.string())])
_SQL = {pa.int64(): "long", pa.binary(): "binary", pa.string(): "string"}


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_SQL[f.type]}" for f in schema)


def radix_groups(texts: list[bytes], first_digit: int = 8, growth: int = 8, max_digit: int = 1 << 16) -> list[int]:
    """For each text the index of the first equal one. Digits widen from first_digit bytes to max_digit."""
    out = list(range(len(texts)))
    stack = [(out[:], 0, first_digit)]
    while stack:
        rows, at, width = stack.pop()
        parts: dict[bytes, list[int]] = {}
        for i in rows:
            parts.setdefault(texts[i][at : at + width], []).append(i)
        for digit, members in parts.items():
            if len(members) == 1:
                continue
            if len(digit) < width:  # ended
                for i in members:
                    out[i] = members[0]
            else:
                stack.append((members, at + width, min(width * growth, max_digit)))
    return out


def _better(a: tuple, b: tuple) -> bool:
    """Whether row a = (points, doc_id, row) stays rather than b: more code points, then smaller doc_id, null last."""
    return (-a[0], a[1] is None, a[1] or 0, a[2]) < (-b[0], b[1] is None, b[1] or 0, b[2])


class Groups:
    """One of each text seen, with the number of its rows and the row that stays."""

    def __init__(self):
        self.texts: list[bytes] = []
        self.size: list[int] = []
        self.best: list[tuple] = []
        self.bytes = 0

    def add(self, texts: list[bytes], sizes: list[int], rows: list[tuple]) -> list[int]:
        """The group of each text. Equal texts collapse as they arrive."""
        known = len(self.texts)
        place = list(range(known))
        for text, size, row, first in zip(texts, sizes, rows, radix_groups(self.texts + texts)[known:], strict=True):
            if first == len(place):  # its own first
                place.append(len(self.texts))
                self.texts.append(text)
                self.size.append(size)
                self.best.append(row)
                self.bytes += len(text) + 200
                continue
            k = place[first]
            place.append(k)
            self.size[k] += size
            if _better(row, self.best[k]):
                self.best[k] = row
        return place[known:]

    def columns(self, a: int, b: int) -> dict:
        best = self.best[a:b]
        return {"norm": self.texts[a:b], "size": self.size[a:b], "points": [x[0] for x in best], "keep_id": [x[1] for x in best], "keep_row": [x[2] for x in best]}

    def pieces(self, most_bytes: int = 2 << 20):
        """Ranges of groups whose texts have about most_bytes, or one longer text."""
        a = held = 0
        for b, t in enumerate(self.texts):
            if b > a and held + len(t) > most_bytes:
                yield a, b
                a, held = b, 0
            held += len(t) + 200
        if a < len(self.texts):
            yield a, len(self.texts)


def _local(most_bytes: int, batches):
    """Rows of one task with the part that each belongs to, and each part's text once."""
    hold("dedup")
    row = part = TaskContext.get().partitionId() << 36
    groups = Groups()

    def leave():
        for a, b in groups.pieces():
            none = [None] * (b - a)
            yield emit(LOCAL, row=none, doc_id=none, part=range(part + a, part + b), **groups.columns(a, b))

    for s in slices(batches, min(most_bytes, 4 << 20)):
        texts = ["" if t is None else t for t in s.column("text").to_pylist()]
        ids = s.column("doc_id").to_pylist()
        found = groups.add([t.encode().translate(None, BLANKS) for t in texts], [1] * len(texts), [(len(t), i, row + k) for k, (t, i) in enumerate(zip(texts, ids, strict=True))])
        none = [None] * len(texts)
        yield emit(LOCAL, row=range(row, row + len(texts)), doc_id=ids, part=[part + g for g in found], norm=none, size=none, points=none, keep_id=none, keep_row=none)
        row += len(texts)
        if groups.bytes > most_bytes:
            yield from leave()
            part += len(groups.texts)
            groups = Groups()
    yield from leave()


def _gather(batches) -> tuple[Groups, list[list[int]]]:
    """The texts of one radix bucket, and the parts of each. Memory holds distinct texts."""
    hold("dedup")
    groups, parts = Groups(), []
    for s in slices(batches, 4 << 20, "norm"):
        c = {k: s.column(k).to_pylist() for k in ("part", "norm", "size", "points", "keep_id", "keep_row")}
        found = groups.add(c["norm"], c["size"], list(zip(c["points"], c["keep_id"], c["keep_row"], strict=True)))
        parts += [[] for _ in range(len(groups.texts) - len(parts))]
        for p, g in zip(c["part"], found, strict=True):
            parts[g].append(p)
    return groups, parts


def _join(batches):
    """One text of each group of equals under its first part, and the other parts."""
    groups, parts = _gather(batches)
    for a, b in groups.pieces():
        yield emit(JOINED, part=[p[0] for p in parts[a:b]], **groups.columns(a, b), whole=[None] * (b - a))
    moved = [(p, every[0]) for every in parts for p in every[1:]]
    none = [None] * len(moved)
    yield emit(JOINED, part=[p for p, _ in moved], norm=none, size=none, points=none, keep_id=none, keep_row=none, whole=[w for _, w in moved])


def _merge(batches):
    """For each part the row that stays, and its group's size."""
    groups, parts = _gather(batches)
    for a in range(0, len(parts), 5000):
        out = [(p, k) for k in range(a, min(a + 5000, len(parts))) for p in parts[k]]
        sha = {k: hashlib.sha256(groups.texts[k]).hexdigest() for k in range(a, min(a + 5000, len(parts)))}
        yield emit(
            MERGED,
            part=[p for p, _ in out],
            keep_row=[groups.best[k][2] for _, k in out],
            keep_id=[groups.best[k][1] for _, k in out],
            group_size=[groups.size[k] for _, k in out],
            text_sha256=[sha[k] for _, k in out],
        )


def _beside(table: DataFrame, rows: int, depth: int, broadcast_bytes: int) -> DataFrame:
    """A table of prefixes for a join: broadcast if its rows of depth bytes are small enough together."""
    return F.broadcast(table) if rows * (depth + 64) <= broadcast_bytes else table


def _bucketed(texts: DataFrame, target_bytes: int, first_depth: int, broadcast_bytes: int) -> tuple[DataFrame, list[DataFrame], bool]:
    """Add bucket and deals: the shortest prefix, of growing depths, whose texts have at most target_bytes together (deals 1),
    or one that has ended, whose copies have to be dealt over that many tasks. Also the tables that this reads, and whether
    there is a prefix of the second kind."""
    depth, out, read, hot = first_depth, texts.withColumns({"bucket": F.lit(None).cast("binary"), "deals": F.lit(1).cast("long")}), [], False
    while True:
        prefix = F.substring("norm", 1, depth)
        heavy = out.filter("bucket IS NULL").groupBy(prefix.alias("heavy")).agg(F.sum(F.length("norm")).alias("bytes"), F.max(F.length("norm")).alias("longest"))
        heavy = heavy.filter(F.col("bytes") > target_bytes).select("heavy", (F.col("longest") > depth).alias("open"), F.ceil(F.col("bytes") / target_bytes).alias("over"))
        heavy = store(heavy, "heavy")
        read.append(heavy)
        n = heavy.agg(F.count("*").alias("n"), F.count_if("open").alias("open")).first()
        hot = hot or n["n"] > n["open"]
        if not n["n"]:
            return out.withColumn("bucket", F.coalesce("bucket", prefix)), read, hot
        out = out.withColumn("prefix", prefix).join(_beside(heavy, n["n"], depth, broadcast_bytes), F.col("bucket").isNull() & (F.col("prefix") == F.col("heavy")), "left")
        out = out.withColumns({"deals": F.when(F.col("open") | F.col("heavy").isNull(), F.col("deals")).otherwise(F.col("over")), "bucket": F.when(F.col("heavy").isNull() | ~F.col("open"), F.coalesce("bucket", "prefix"))})
        out = out.drop("prefix", "heavy", "open", "over")
        if not n["open"]:
            return out, read, hot
        depth *= 4


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_bytes: int = 24 << 20, first_depth: int = 12, broadcast_bytes: int = 8 << 20, memory_bytes: int = 32 << 20) -> DataFrame:
    """Group rows whose texts are equal without blanks: doc_id, keep_id, group_size, kept, text_sha256.

    The row with the most code points stays, then the smallest doc_id (null is last). Null text is empty;
    all empty texts are one group. Repeated rows (same doc_id, same text) count each in group_size and
    exactly one row of a group has kept = true. Other columns are not looked at. Empty table: empty result.
    A very long text is held whole by one task.
    """
    local = store(id_and_text(docs, id_col, text_col).mapInArrow(functools.partial(_local, memory_bytes), ddl(LOCAL)), "local")
    names = [n for n, _ in TEXTS]
    texts = local.filter(F.col("norm").isNotNull()).select(*names)
    total = texts.agg(F.sum(F.length("norm"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // target_bytes))
    fair = min(target_bytes, max(1 << 16, total // (2 * parts)))  # no prefix takes more than half a task's share
    bucketed, read, hot = _bucketed(texts, fair, first_depth, broadcast_bytes)
    rows = local.filter(F.col("row").isNotNull()).select("row", "part", "doc_id")
    joined = None
    if hot:
        dealt = bucketed.filter("deals > 1").repartition(parts, "bucket", F.pmod(F.shiftright("part", 36), F.col("deals"))).select(*names)
        joined = store(dealt.mapInArrow(_join, ddl(JOINED)), "joined")
        again = joined.filter(F.col("norm").isNotNull()).select(*names, F.col("norm").alias("bucket"))
        bucketed = bucketed.filter("deals = 1").select(*names, "bucket").union(again)
        moved = joined.filter(F.col("whole").isNotNull()).select(F.col("part").alias("from"), "whole")
        rows = rows.join(moved, rows["part"] == moved["from"], "left").select("row", F.coalesce("whole", "part").alias("part"), "doc_id")
    merged = store(bucketed.repartition(parts, "bucket").select(*names).mapInArrow(_merge, ddl(MERGED)), "merged")
    slim = store(rows, "rows")
    discard(local, *read, *([joined] if hot else []))
    return slim.join(merged, "part").select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")
