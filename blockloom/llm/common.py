"""What the text operators share: scratch tables, batch slicing, fixed byte tables."""

from __future__ import annotations

import contextlib
import ctypes
import sys
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.scratch import discard, folder_of, small_batches, store, stored, sweep  # noqa: F401

#: A-Z to a-z on UTF-8 bytes; other bytes stay.
LOWER_AZ = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The six ASCII blanks that the contracts call white space.
BLANKS = b" \t\n\x0b\x0c\r"


class Memory(dict):
    """Values that make gives of words, remembered within a number of bytes; then the memory starts anew. A very long word is not kept."""

    def __init__(self, make: Callable[[Any], Any], most_bytes: int = 32 << 20, entry_bytes: int = 180):
        super().__init__()
        self.make, self.most_bytes, self.entry_bytes, self.held = make, most_bytes, entry_bytes, 0

    def __missing__(self, word):
        value = self.make(word)
        size = self.entry_bytes + sys.getsizeof(word)
        if size <= self.most_bytes >> 6:
            if self.held + size > self.most_bytes:
                self.clear()
                self.held = 0
            self.held += size
            self[word] = value
        return value


#: What the operator that runs in this worker remembers, and how to forget it.
_HELD: dict[str, Callable[[], object]] = {}


def hold(name: str, forget: Callable[[], object] = int) -> None:
    """At a task's start: a reused worker forgets what other operators remember, and gives that memory back."""
    others = [k for k in _HELD if k != name]
    for k in others:
        _HELD.pop(k)()
    if others:
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only glibc has it
            ctypes.CDLL("libc.so.6").malloc_trim(0)
    _HELD[name] = forget


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def slices(batches: Iterable[pa.RecordBatch], max_bytes: int = 2 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each piece holds about max_bytes of text, or one longer row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(lengths) // max_bytes
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [t if t is not None else "" for t in batch.column(column).to_pylist()]


def emit(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
