"""Reed-Solomon parity over GF(256), by groups of blocks."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from blockloom import schema as S
from blockloom.operators import dedup
from blockloom.scratch import store

POLYNOMIAL = 0x11D


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    exp, log = np.zeros(512, np.int64), np.zeros(256, np.int64)
    x = 1
    for k in range(255):
        exp[k], log[x] = x, k
        x <<= 1
        if x & 256:
            x ^= POLYNOMIAL
    exp[255:510] = exp[:255]
    return exp, log


@functools.cache
def products() -> np.ndarray:
    """The whole multiplication table: row a holds a times every byte."""
    exp, log = _tables()
    table = exp[log[:, None] + log[None, :]].astype(np.uint8)
    table[0], table[:, 0] = 0, 0
    return table


def gf_mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return products()[a, b]


def gf_inverse(a: int) -> int:
    exp, log = _tables()
    return int(exp[(255 - log[a]) % 255])


def gf_matmul(m: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """A small matrix times rows of bytes: one look-up in a row of 256 bytes for each coefficient and byte."""
    out = np.zeros((len(m), rows.shape[1]), np.uint8)
    for i in range(len(m)):
        for k in range(m.shape[1]):
            if m[i, k]:
                out[i] ^= products()[m[i, k]][rows[k]]
    return out


def gf_invert(m: np.ndarray) -> np.ndarray:
    n = len(m)
    a = np.concatenate([m.astype(np.uint8), np.eye(n, dtype=np.uint8)], 1)
    for c in range(n):
        p = c + int(np.flatnonzero(a[c:, c])[0])
        a[[c, p]] = a[[p, c]]
        a[c] = gf_mul(a[c], gf_inverse(int(a[c, c])))
        for r in range(n):
            if r != c and a[r, c]:
                a[r] ^= gf_mul(a[c], a[r, c])
    return a[:, n:]


def parity_matrix(parity: int, data: int = S.ECC_DATA) -> np.ndarray:
    """A Cauchy matrix: any `data` rows of it and the identity can be inverted."""
    return np.array([[gf_inverse((data + p) ^ d) for d in range(data)] for p in range(parity)], np.uint8).reshape(parity, data)


def encode(shards: list[bytes], parity: int, data: int = S.ECC_DATA) -> list[bytes]:
    """Parity of up to `data` shards, padded with zeros to the longest and with zero shards to `data`."""
    size = max(map(len, shards), default=0)
    rows = np.zeros((data, size), np.uint8)
    for k, s in enumerate(shards):
        rows[k, : len(s)] = np.frombuffer(s, np.uint8)
    return [r.tobytes() for r in gf_matmul(parity_matrix(parity, data), rows)]


def reconstruct(shards: list[bytes | None], sizes: list[int], parity: list[bytes | None], data: int = S.ECC_DATA) -> list[bytes]:
    """All data shards, from the shards and parity that are there. sizes: true length of each data shard."""
    size = max([len(p) for p in parity if p is not None] + sizes + [0])
    full = np.concatenate([np.eye(data, dtype=np.uint8), parity_matrix(len(parity), data)])
    pad = lambda s: np.frombuffer(s.ljust(size, b"\0"), np.uint8)
    have = {k: pad(s) for k, s in enumerate([*shards, *[b""] * (data - len(shards))]) if s is not None}
    have |= {data + k: pad(p) for k, p in enumerate(parity) if p is not None}
    if len(have) < data:
        raise ValueError(f"{data - len(have)} shards too few to reconstruct")
    use = sorted(have)[:data]
    rows = gf_matmul(gf_invert(full[use]), np.stack([have[k] for k in use]))
    return [rows[k].tobytes()[: sizes[k]] for k in range(len(shards))]


_PARITY = pa.schema([("group_id", pa.int64()), ("parity_idx", pa.int32()), ("shard_size", pa.int64()), ("payload", pa.binary())])
_PARITY_ROWS = "group_id long, parity_idx int, shard_size long, payload binary"


def _parity_rows(group: int, payloads: list[bytes], parity: int) -> list[tuple]:
    return [(group, k, len(x), x) for k, x in enumerate(encode(payloads, parity))]


def _parity_table(rows: list[tuple]) -> dict:
    return {f.name: pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_PARITY)}


def parity_blocks(blocks: DataFrame, parity: int) -> DataFrame:
    """group_id, parity_idx, shard_size, hash, payload for blocks(group_id, block_seq, payload). A group is ten blocks at most."""

    def make(g: pa.Table) -> pa.Table:
        return pa.Table.from_pydict(_parity_table(_parity_rows(g.column("group_id")[0].as_py(), g.sort_by("block_seq").column("payload").to_pylist(), parity)), _PARITY)

    rows = blocks.select(F.col("group_id").cast("long"), "block_seq", "payload").groupBy("group_id").applyInArrow(make, _PARITY_ROWS)
    return rows.withColumn("hash", F.sha2("payload", 256))


def _whole_groups(parity: int, last: int, data: int, batches):
    """Parity of groups that this task reads whole: a group's blocks go once its last one has come."""
    groups: dict[int, dict[int, bytes]] = {}
    for b in batches:
        rows, held = [], 0
        for group, seq, payload in zip(*(b.column(c) for c in ("group_id", "block_seq", "payload")), strict=True):
            g = group.as_py()
            mine = groups.setdefault(g, {})
            mine[seq.as_py()] = payload.as_py()
            if len(mine) == min(data, last + 1 - g * data):
                rows += _parity_rows(g, [x for _, x in sorted(groups.pop(g).items())], parity)
                held += sum(r[2] for r in rows[-parity:])
            if held >= 4 << 20:
                yield pa.RecordBatch.from_pydict(_parity_table(rows), _PARITY)
                rows, held = [], 0
        yield pa.RecordBatch.from_pydict(_parity_table(rows), _PARITY)
    if groups:
        raise RuntimeError(f"{len(groups)} groups of blocks were not read whole by one task")


def parity_of_stored(blocks: DataFrame, parity: int, data: int = S.ECC_DATA) -> DataFrame:
    """parity_blocks() of a table in files whose block_seq has no gaps in its groups: groups that one task reads whole are not moved.

    Which ones these are is asked first, as how a table is cut into tasks doesn't depend on the columns that are read.
    """
    tasks = blocks.select(F.col("group_id").cast("long"), "block_seq", F.spark_partition_id().alias("task")).groupBy("group_id").agg(F.min("task").alias("low"), F.max("task").alias("high"), F.max("block_seq").alias("last"))
    tasks = store(tasks, "tasks")
    groups, cut, last = tasks.agg(F.count("*"), F.count_if(F.col("low") != F.col("high")), F.max("last")).first()
    if 4 * cut > groups:  # blocks that don't lie in order
        return parity_blocks(blocks, parity)
    slim = blocks.select(F.col("group_id").cast("long"), "block_seq", "payload")
    apart = store(tasks.filter("low <> high").select("group_id"), "apart")
    whole = slim.join(apart, "group_id", "left_anti").mapInArrow(functools.partial(_whole_groups, parity, last or 0, data), _PARITY_ROWS)
    return whole.withColumn("hash", F.sha2("payload", 256)).unionByName(parity_blocks(slim.join(apart, "group_id", "left_semi"), parity))


def repair_groups(blocks: DataFrame, parity: DataFrame, groups: DataFrame | None = None, keep: tuple[str, ...] = (), as_is: bool = False) -> DataFrame:
    """block_seq, payload, repaired of damaged blocks, and the columns to keep. blocks: group_id, block_seq, payload, size, intact; size is the
    stored payload's. groups: the damaged ones' group_id, stored, where they are known. as_is: what can't be repaired keeps its payload.

    Blocks and parity are dealt once, by group; groups without damage stay where they are if most have none.
    """
    width, most = parity.agg(F.max("parity_idx") + 1, F.max("group_id") + 1).first()
    width, kinds = width or 0, dict(blocks.dtypes)
    data = blocks.select(F.col("group_id").cast("long"), F.col("block_seq").cast("long").alias("at"), "payload", F.col("size").cast("long"), F.coalesce("intact", F.lit(False)).alias("intact"), F.lit(False).alias("is_parity"), *keep)
    extra = parity.select(F.col("group_id").cast("long"), F.col("parity_idx").cast("long").alias("at"), "payload", F.col("shard_size").alias("size"), F.coalesce(F.sha2("payload", 256) == F.col("hash"), F.lit(False)).alias("intact"), F.lit(True).alias("is_parity"), *[F.lit(None).cast(kinds[k]).alias(k) for k in keep])
    if groups is None or 4 * groups.count() < (most or 0):
        groups = blocks.filter("NOT intact").select("group_id").distinct() if groups is None else groups
        data, extra = (x.join(groups, "group_id", "left_semi") for x in (data, extra))
    out = T.StructType([T.StructField("block_seq", T.LongType()), T.StructField("payload", T.BinaryType()), T.StructField("repaired", T.BooleanType()), *[data.schema[k] for k in keep]])
    schema = to_arrow_schema(out)

    def fix(g: pa.Table) -> pa.Table:
        if all(g.column("intact").to_pylist()):
            return schema.empty_table()
        rows = sorted(g.to_pylist(), key=lambda r: r["at"])
        sound = lambda r: r["payload"] if r["intact"] else None
        own = [r for r in rows if not r["is_parity"]]
        pars: list[bytes | None] = [None] * width
        for r in rows:
            if r["is_parity"]:
                pars[r["at"]] = sound(r)
        try:
            full = reconstruct([sound(r) for r in own], [r["size"] for r in own], pars)
        except ValueError:
            full = [None] * len(own)
        bad = [(r, f) for r, f in zip(own, full, strict=True) if not r["intact"]]
        made = {"block_seq": [r["at"] for r, _ in bad], "payload": [r["payload"] if f is None and as_is else f for r, f in bad], "repaired": [f is not None for _, f in bad]}
        return pa.Table.from_pydict(made | {k: [r[k] for r, _ in bad] for k in keep}, schema)

    return data.union(extra).groupBy("group_id").applyInArrow(fix, out)


def islands(scan: DataFrame) -> DataFrame:
    """group_no of each row of a linear scan(offset, is_parity): a group begins at data after parity.

    Rows are dealt by ranges of offset. What crosses a border is one row for each range: its last row's kind,
    and how many groups began before it.
    """
    placed = dedup.by_ranges(scan, "offset")
    by_range = Window.orderBy("_range")  # one row for each task
    ends = placed.groupBy("_range").agg(F.max_by("is_parity", "offset").alias("last"))
    ends = ends.select("_range", F.lag("last").over(by_range).alias("before"))
    inside = Window.partitionBy("_range").orderBy("offset")
    rows = placed.join(F.broadcast(ends), "_range").withColumn("previous", F.coalesce(F.lag("is_parity").over(inside), "before", F.lit(False)))
    rows = rows.withColumn("begins", (~F.col("is_parity") & F.col("previous")).cast("int"))
    starts = rows.groupBy("_range").agg(F.sum("begins").alias("n"))
    starts = starts.select("_range", F.coalesce(F.sum("n").over(by_range.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    number = F.col("start") + F.sum("begins").over(inside)
    return rows.join(F.broadcast(starts), "_range").withColumn("group_no", number).drop("begins", "previous", "before", "start", "_range")
