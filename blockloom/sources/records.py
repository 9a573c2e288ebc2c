"""Blocks as binary files: a header, a record for each block, an index twice, a footer. All numbers are little-endian.

A file is what one task writes. Its reader trusts nothing: header and footer have magic bytes, the header and each
record's head a checksum; without a sound footer the second index is sought, and without any index records are
scanned from the start, as each tells its own length.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import struct
import uuid
import zlib

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom import schema as S
from blockloom.scratch import small_batches
from blockloom.sources.restore import local_path

#: Fixed values of the file form; sizes are in schema.py.
MAGIC, FOOTER_MAGIC, INDEX_MAGIC = b"BLMR", b"BLMF", b"BLMI"
HEAD, HEADER = struct.Struct("<32sIIBBBB"), struct.Struct("<4sHH")
FOOTER = struct.Struct("<QQQQ32sQ4s")
RECORDS = "file string, offset long, hash string, codec int, compressed_size long, uncompressed_size long, payload binary"
_SCHEMA = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("hash", pa.string()), ("codec", pa.int32()), ("compressed_size", pa.int64()), ("uncompressed_size", pa.int64()), ("payload", pa.binary())])


def pack_header(flags: int) -> bytes:
    raw = HEADER.pack(MAGIC, S.FORMAT_VERSION, flags)
    return raw + hashlib.sha256(raw).digest()[:8]


def read_header(raw: bytes) -> int:
    """Flags of a file's header; raises if it is none, of a later version, or damaged."""
    if len(raw) < S.HEADER_SIZE or raw[:4] != MAGIC:
        raise ValueError("not a file of blocks")
    _, version, flags = HEADER.unpack(raw[:8])
    if version > S.FORMAT_VERSION:
        raise ValueError(f"version {version} is later than {S.FORMAT_VERSION}")
    if hashlib.sha256(raw[:8]).digest()[:8] != raw[8:16]:
        raise ValueError("damaged header")
    return flags


def pack_head(hash_: str, compressed: int, uncompressed: int, codec: int, flags: int = 0, shards: int = 0) -> bytes:
    raw = HEAD.pack(bytes.fromhex(hash_), compressed, uncompressed, codec, flags, shards, 0)
    return raw + struct.pack("<I", zlib.crc32(raw))


def read_head(raw: bytes) -> tuple[str, int, int, int, int, int] | None:
    """hash, compressed and uncompressed size, codec, flags, shards; None if the checksum is wrong or there are too few bytes."""
    if len(raw) < S.BLOCK_HEADER_SIZE or zlib.crc32(raw[:44]) != struct.unpack("<I", raw[44:48])[0]:
        return None
    return (raw[:32].hex(), *HEAD.unpack(raw[:44])[1:6])


def pack_footer(index_at: int, index_size: int, again_at: int, blocks: int, root: str, previous: int = 0) -> bytes:
    return FOOTER.pack(index_at, index_size, again_at, blocks, bytes.fromhex(root), previous, FOOTER_MAGIC)


def read_footer(raw: bytes) -> tuple | None:
    """index offset and length, the second index's offset, number of blocks, root, the footer before; None if it is none."""
    if len(raw) != S.FOOTER_SIZE or raw[-4:] != FOOTER_MAGIC:
        return None
    found = FOOTER.unpack(raw)
    return (*found[:4], found[4].hex(), found[5])


def _pack_index(entries: list) -> bytes:
    body = zstandard.ZstdCompressor().compress(json.dumps(entries).encode())
    return INDEX_MAGIC + struct.pack("<I", zlib.crc32(body)) + body


def _read_index(f, at: int, size: int) -> list | None:
    f.seek(at)
    raw = f.read(size)
    if len(raw) < 8 or raw[:4] != INDEX_MAGIC or zlib.crc32(raw[8:]) != struct.unpack("<I", raw[4:8])[0]:
        return None
    return json.loads(zstandard.ZstdDecompressor().decompress(raw[8:], max_output_size=1 << 31))


def _write(folder: str, flags: int, batches):
    """A task's file; it gets its name once it is whole."""
    name = os.path.join(folder, f"{uuid.uuid4().hex}.blocks")
    entries: list = []
    with open(f"{name}.part", "wb") as f:
        f.write(pack_header(flags))
        for b in batches:
            for r in b.to_pylist():
                entries.append([f.tell(), r["hash"]])
                f.write(pack_head(r["hash"], len(r["payload"]), r["uncompressed_size"], r["codec"]))
                f.write(r["payload"])
        index, at = _pack_index(entries), f.tell()
        root = hashlib.sha256("".join(h for _, h in entries).encode()).hexdigest()
        f.write(index + index + pack_footer(at, len(index), at + len(index), len(entries), root))
    if entries:
        os.replace(f"{name}.part", name)
    else:
        os.remove(f"{name}.part")
    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(entries)], pa.int64())], names=["file", "blocks"])


def write_records(blocks: DataFrame, folder: str, flags: int = 0) -> int:
    """Write blocks(hash, codec, uncompressed_size, payload) as files into a folder that every executor sees: number of blocks.

    Files that no finished task named, left by tries that failed, go at the end.
    """
    folder = local_path(folder)
    os.makedirs(folder, exist_ok=True)
    small_batches(blocks.sparkSession)
    rows = blocks.select("hash", "codec", "uncompressed_size", "payload").mapInArrow(functools.partial(_write, folder, flags), "file string, blocks long").collect()  # one row for each task
    named = {os.path.basename(r["file"]) for r in rows if r["blocks"]}
    for name in os.listdir(folder):
        if name not in named:
            os.remove(os.path.join(folder, name))
    return sum(r["blocks"] for r in rows)


def offsets_of(f, size: int) -> list[int] | None:
    """Where records begin, from the footer's index or the second one; None if neither can be read."""
    f.seek(max(0, size - S.FOOTER_SIZE))
    footer = read_footer(f.read(S.FOOTER_SIZE))
    if footer:
        for at in (footer[0], footer[2]):
            if (index := _read_index(f, at, footer[1])) is not None:
                return [offset for offset, _ in index]
    return None


def _scan(folder: str, batches):
    for b in batches:
        for name in b.column("file").to_pylist():
            full, rows, held = os.path.join(folder, name), [], 0
            size = os.path.getsize(full)
            with open(full, "rb") as f:
                read_header(f.read(S.HEADER_SIZE))
                known = offsets_of(f, size)
                todo, at = iter(known or ()), S.HEADER_SIZE
                while True:
                    if known is not None and (at := next(todo, None)) is None:
                        break
                    f.seek(at)
                    head = read_head(f.read(S.BLOCK_HEADER_SIZE))
                    if head is None and known is None:
                        break  # the end of what can be scanned
                    payload = f.read(head[1]) if head else None
                    rows.append((name, at, *((head[0], head[3], head[1], head[2]) if head else (None,) * 4), payload))
                    held += len(payload or b"") + 200
                    at += S.BLOCK_HEADER_SIZE + (head[1] if head else 0)
                    if held >= 4 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
            if rows:
                yield _batch(rows)


def _batch(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def scan_records(spark: SparkSession, folder: str) -> DataFrame:
    """file, offset, hash, codec, compressed_size, uncompressed_size, payload of all records below a folder; a file is one task's.

    A record whose head is damaged has nulls for all that the head tells, if an index tells its place; without an index the
    file's scan ends there. A file without a sound header raises.
    """
    folder = local_path(folder)
    names = sorted(n for n in os.listdir(folder) if n.endswith(".blocks"))
    files = spark.createDataFrame([(n,) for n in names], "file string").repartition(max(1, len(names)))
    return files.mapInArrow(functools.partial(_scan, folder), RECORDS)
