"""Fixed names, flags and table schemas of a content-addressed archive."""

from __future__ import annotations

#: Fixed values of the archive format.
HEADER_SIZE, BLOCK_HEADER_SIZE, FOOTER_SIZE = 16, 48, 76
FORMAT_VERSION = 1
ENCRYPTED, ERASURE_CODED, APPEND_ONLY, INCREMENTAL = 1, 2, 4, 8
FLAG_NAMES = {ENCRYPTED: "encrypted", ERASURE_CODED: "erasure-coded", APPEND_ONLY: "append-only", INCREMENTAL: "incremental"}
REF_EXTERNAL = 1
CODECS = {"none": 0, "store": 0, "zstd": 1, "zstandard": 1, "lz4": 2}
ECC_PARITY = {"low": 2, "medium": 4, "med": 4, "high": 6}
ECC_DATA = 10
SMALL_FILE, TINY_FILE, MIN_VOLUME = 65536, 64, 1024

REF = "struct<hash: string, offset: bigint, slice_start: int, slice_len: int, flags: int>"
MANIFEST = f"generation bigint, seq bigint, path string, kind string, target string, mode int, mtime_ns bigint, uid bigint, gid bigint, size bigint, block_refs array<{REF}>"
BLOCKS = "hash string, block_seq bigint, codec int, compressed_size bigint, uncompressed_size bigint, payload binary, group_id bigint, checksum bigint"
PARITY = "group_id bigint, parity_idx int, shard_size bigint, hash string, payload binary"
