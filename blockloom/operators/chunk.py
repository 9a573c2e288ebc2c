"""Chunking: fixed sizes in SQL, content-defined cuts by a normalised gear hash in numpy."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.scratch import small_batches


def fixed_chunks(files: DataFrame, size: int) -> DataFrame:
    """seq, pos, chunk, hash, len: pieces of `size` characters, cut in one pass over each text. Empty or null content has none."""
    pieces = F.regexp_extract_all(F.col("content"), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    rows = files.select("seq", F.posexplode(pieces).alias("pos", "chunk"))
    return rows.select("seq", "pos", "chunk", F.sha2("chunk", 256).alias("hash"), F.octet_length("chunk").cast("long").alias("len"))


def joined(pieces, content: str, kind: str = "binary"):
    """The pieces of an array of structs (pos, content) in order of pos as one value, in time linear in its length."""
    whole = F.array_join(F.transform(F.sort_array(pieces), lambda x: x[content].cast("string")), "")
    return whole.cast(kind)


def gear_table(seed: int = 0x5EED) -> np.ndarray:
    """One random 64-bit word for each byte, from a seeded generator."""
    return np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_GEAR = gear_table()


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """Rolling gear hash at each byte: the sum of the last 64 bytes' words, each shifted by its age."""
    words = _GEAR[data]
    h, shift = words.copy(), 1
    while shift < 64 and shift < len(words):  # doubling: ages below 2 * shift
        moved = h[:-shift] << np.uint64(shift)
        h[shift:] = h[shift:] + moved
        shift *= 2
    return h


#: Bytes that are hashed at once; the 63 before a window reach into it.
WINDOW = 1 << 22


def _marks(data: np.ndarray, *masks: np.uint64) -> list[np.ndarray]:
    """Places where the rolling hash has none of each mask's bits, window by window."""
    found: list[list[np.ndarray]] = [[] for _ in masks]
    for at in range(0, len(data), WINDOW):
        back = min(at, 63)
        h = gear_hashes(data[at - back : at + WINDOW])[back:]
        for k, mask in enumerate(masks):
            found[k].append(np.flatnonzero((h & mask) == 0) + at)
    return [np.concatenate(f) for f in found]


def cut_points(data: bytes, least: int, average: int, most: int) -> list[int]:
    """Ends of content-defined chunks: a harder mask before the average size, an easier one after it."""
    if not data:
        return []
    bits = max(1, int(average).bit_length() - 1)
    mask = lambda n: np.uint64(((1 << n) - 1) << (63 - n))
    if len(data) <= least:
        return [len(data)]
    hard, easy = _marks(np.frombuffer(data, np.uint8), mask(bits + 1), mask(max(1, bits - 1)))
    ends, at, n = [], 0, len(data)
    while n - at > least:
        middle, stop = min(at + average, n), min(at + most, n)
        i, j = np.searchsorted(hard, at + least), np.searchsorted(easy, middle)
        if i < len(hard) and hard[i] < middle:
            at = int(hard[i]) + 1
        elif j < len(easy) and easy[j] < stop:
            at = int(easy[j]) + 1
        else:
            at = stop
        ends.append(at)
    return ends if at == n else [*ends, n]


SCHEMA = pa.schema([("seq", pa.int64()), ("pos", pa.int32()), ("chunk", pa.binary())])


#: Bytes of chunks that a worker gathers before they leave; it holds them twice at that time.
LEAVE = 4 << 20


def _cut(least: int, average: int, most: int, batches):
    """Chunks leave in batches of about LEAVE bytes, in the middle of a file too."""
    seq, pos, chunk, held = [], [], [], 0

    def leave():
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((seq, pos, chunk), SCHEMA, strict=True)], schema=SCHEMA)

    for b in batches:
        for s, value in zip(b.column("seq"), b.column("content"), strict=True):
            data = value.as_py() or b""
            at = 0
            for k, end in enumerate(cut_points(data, least, average, most)):
                seq.append(s.as_py())
                pos.append(k)
                chunk.append(data[at:end])
                held += end - at
                at = end
                if held >= LEAVE:
                    yield leave()
                    seq, pos, chunk, held = [], [], [], 0
    yield leave()


def content_chunks(files: DataFrame, least: int = 64 << 10, average: int = 256 << 10, most: int = 1 << 20) -> DataFrame:
    """seq, pos, chunk, hash, len. Files of up to `least` bytes are one chunk; empty ones have none."""
    small_batches(files.sparkSession)
    rows = files.select(F.col("seq").cast("long"), F.col("content").cast("binary").alias("content")).mapInArrow(partial(_cut, least, average, most), "seq long, pos int, chunk binary")
    return rows.select("seq", "pos", "chunk", F.sha2("chunk", 256).alias("hash"), F.octet_length("chunk").cast("long").alias("len"))
