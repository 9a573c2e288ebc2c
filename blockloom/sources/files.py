"""Sources: tables as files, directories, tar files."""

from __future__ import annotations

import contextlib
import functools
import gzip
import io
import json
import os
import re
import stat
import tarfile

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.functions import scalar
from blockloom.operators import dedup
from blockloom.scratch import store

FILES = "seq long, path string, kind string, target string, mode int, mtime_ns long, uid long, gid long, content binary"


def table_files(table: DataFrame, key: str, content: str) -> DataFrame:
    """One file for each row: seq, path, content, size, hash. Null content is an empty file."""
    data = F.coalesce(F.col(content), F.lit("").cast(table.schema[content].dataType))
    return table.select(F.col(key).alias("seq"), F.col(key).cast("string").alias("path"), data.alias("content"), F.octet_length(data).cast("long").alias("size"), F.sha2(data, 256).alias("hash"))


def binary_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """Files below a root in any store that Spark reads: path, mtime, size, content."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    rows = (reader.option("pathGlobFilter", glob) if glob else reader).load(root)
    return rows.select(F.col("path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")


#: An entry of a tree, and what a folder's listing needs: ignore rules from above as JSON, its path below the root.
ENTRIES = "path string, kind string, target string, mode int, mtime_ns long, uid long, gid long, size long"
_RULES = (".gitignore", ".ignore")


def _pattern(line: str, at: str) -> tuple[bool, bool, str] | None:
    """An ignore file's line in folder `at` as (keep, folders only, regular expression of paths below the root)."""
    line = line.rstrip("\n").rstrip()
    if not line or line.startswith("#"):
        return None
    keep, line = line.startswith("!"), line.removeprefix("!").removeprefix("\\")
    only, body = line.endswith("/"), line.strip("/")
    anchored = "/" in line.rstrip("/")
    out, k = "", 0
    while k < len(body):
        if body.startswith("**/", k):
            out, k = out + "(?:[^/]+/)*", k + 3
        elif body.startswith("**", k):
            out, k = out + ".*", k + 2
        elif body[k] == "*":
            out, k = out + "[^/]*", k + 1
        elif body[k] == "?":
            out, k = out + "[^/]", k + 1
        elif body[k] == "[" and "]" in body[k + 2 :]:
            end = body.index("]", k + 2)
            inside = body[k + 1 : end]
            out, k = out + "[" + ("^" + inside[1:] if inside[0] in "!^" else inside).replace("\\", "\\\\") + "]", end + 1
        else:
            out, k = out + re.escape(body[k]), k + 1
    below = re.escape(f"{at}/") if at else ""
    return keep, only, f"{below}{'' if anchored else '(?:.*/)?'}{out}"


def _rules(folder: str, at: str, names: tuple[str, ...]) -> list[tuple[bool, bool, str]]:
    found = []
    for name in names:
        with contextlib.suppress(OSError), open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
            found += [p for p in (_pattern(x, at) for x in f) if p]
    return found


def _ignored(path: str, is_dir: bool, rules: list) -> bool:
    """The last rule that matches decides."""
    for keep, only, pattern in reversed(rules):
        if (is_dir or not only) and re.fullmatch(pattern, path, re.S):
            return not keep
    return False


def _entry(full: str, path: str) -> tuple:
    st = os.lstat(full)
    link = os.readlink(full) if stat.S_ISLNK(st.st_mode) else None
    kind = "symlink" if link is not None else "dir" if stat.S_ISDIR(st.st_mode) else "file" if stat.S_ISREG(st.st_mode) else None
    return path, kind, link, st.st_mode & 0o7777, st.st_mtime_ns, st.st_uid, st.st_gid, st.st_size if kind == "file" else 0


def _list(root: str, names: tuple[str, ...], batches):
    """Entries of some folders, and the rules that hold inside each folder among them."""
    columns = [c.split()[0] for c in ENTRIES.split(", ")]
    for pdf in batches:
        out = []
        for at, text in zip(pdf["at"], pdf["rules"], strict=True):
            folder = os.path.join(root, at)
            rules = json.loads(text) + _rules(folder, at, names)
            try:
                found = sorted(os.listdir(folder))
            except OSError:  # gone or closed: nothing to list
                found = []
            for name in found:
                path = f"{at}/{name}" if at else name
                try:
                    entry = _entry(os.path.join(root, path), path)
                except OSError:
                    continue
                if entry[1] and name != ".git" and not _ignored(path, entry[1] == "dir", rules):
                    out.append((*entry, json.dumps(rules) if entry[1] == "dir" else None))
        yield pd.DataFrame(out, columns=[*columns, "rules"])


def tree(spark: SparkSession, root: str, respect_ignore: bool = True) -> DataFrame:
    """Entries below a root that all executors see: path, kind, target, mode, mtime_ns, uid, gid, size; no contents.

    Folders are listed by tasks, a level of the tree a round. .git is left out; .gitignore, .ignore and the
    repository's own exclude file hold from their folder down, a later rule before an earlier one; links are not
    followed. A root that is a file is its only entry.
    """
    if not os.path.isdir(root):
        return spark.createDataFrame([_entry(root, os.path.basename(root))], ENTRIES)
    names = _RULES if respect_ignore else _RULES[1:]
    first = _rules(root, "", (".git/info/exclude",)) if respect_ignore else []
    level, levels = spark.createDataFrame([("", json.dumps(first))], "at string, rules string"), []
    while level is not None:
        found = store(level.mapInPandas(functools.partial(_list, root, names), ENTRIES + ", rules string"), "level")
        levels.append(found.drop("rules"))
        folders = found.filter("kind = 'dir'").select(F.col("path").alias("at"), "rules")
        n = folders.count()
        level = folders.repartition(max(1, min(n // 16, 8 * spark.sparkContext.defaultParallelism))) if n else None
    return functools.reduce(DataFrame.unionByName, levels)


def _contents(root: str, batches):
    """Contents in batches of about 16 MB. A file that can't be read is left out."""
    for b in batches:
        path, content, held = [], [], 0
        for p in b.column("path").to_pylist():
            with contextlib.suppress(OSError), open(os.path.join(root, p) if os.path.isdir(root) else root, "rb") as f:
                content.append(f.read())
                path.append(p)
                held += len(content[-1])
            if held >= 1 << 24:
                yield pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(content, pa.binary())], names=["path", "content"])
                path, content, held = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(content, pa.binary())], names=["path", "content"])


def walk(spark: SparkSession, root: str, respect_ignore: bool = True) -> DataFrame:
    """tree() with seq in order of path and contents of files, read by the tasks that need them. The root must be seen by all executors."""
    entries = store(tree(spark, root, respect_ignore), "tree")
    numbers = dedup.numbered(entries, ["path"], {"seq": F.lit(1)})
    files = entries.filter("kind = 'file'").select("path")
    tasks = max(1, min(files.count() // 64, 64 * spark.sparkContext.defaultParallelism))
    data = files.repartition(tasks).mapInArrow(functools.partial(_contents, root), "path string, content binary")
    return numbers.join(data, "path", "left").filter("kind <> 'file' OR content IS NOT NULL")


def _kind(m: tarfile.TarInfo) -> str | None:
    return "dir" if m.isdir() else "symlink" if m.issym() else "hardlink" if m.islnk() else "file" if m.isfile() else None


def _opened(raw: io.BufferedIOBase, first: bytes) -> io.BufferedIOBase:
    """The plain tar in a stream that begins with some bytes."""
    if first[:4] == bytes.fromhex("28B52FFD"):
        return zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)
    return gzip.GzipFile(fileobj=raw) if first[:2] == bytes.fromhex("1F8B") else raw


def _tar_entries(name: str, raw: io.BufferedIOBase):
    """Entries of one tar, one after the other: memory holds one entry's content."""
    with tarfile.open(fileobj=raw, mode="r|") as tar:
        for k, m in enumerate(tar):
            if ".." in m.name.split("/"):
                raise ValueError(f"path leaves the archive: {m.name}")
            if kind := _kind(m):
                yield name, k, m.name, kind, m.linkname or None, m.mode, int(m.mtime * 10**9), m.uid, m.gid, tar.extractfile(m).read() if kind == "file" else None


def _tar_rows(batches):
    schema = pa.schema([("tar", pa.string()), ("seq", pa.int64()), ("path", pa.string()), ("kind", pa.string()), ("target", pa.string()), ("mode", pa.int32()), ("mtime_ns", pa.int64()), ("uid", pa.int64()), ("gid", pa.int64()), ("content", pa.binary())])
    leave = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    for b in batches:
        for row in b.to_pylist():
            local = row["tar"].removeprefix("file:") if row["content"] is None else None
            with open(local, "rb") if local else io.BytesIO(row["content"]) as raw:
                first = raw.read(4)
                raw.seek(0)
                rows, held = [], 0
                for entry in _tar_entries(row["tar"], _opened(raw, first)):
                    rows.append(entry)
                    held += len(entry[-1] or b"") + 200
                    if held >= 1 << 24:
                        yield leave(rows)
                        rows, held = [], 0
                if rows:
                    yield leave(rows)


def read_tars(spark: SparkSession, root: str) -> DataFrame:
    """tar, and seq, path, kind, target, mode, mtime_ns, uid, gid, content of all entries of the tar, tar.gz and tar.zst files below a
    root, told by their magic bytes. A task reads one tar at a time, as a stream where the path is a file's; a tar in another
    store comes as one row, which Spark bounds to 2 GB. An entry's content is one value, with that bound too."""
    found = binary_files(spark, root)
    start = found.select("path", F.substring("content", 1, 512).alias("content")).withColumn("format", scalar.legacy_format(F.col("content")))
    tars = start.filter("format IS NOT NULL").select("path")
    local = F.col("path").startswith("file:")
    near = tars.filter(local).select(F.col("path").alias("tar"), F.lit(None).cast("binary").alias("content"))
    far = found.join(tars.filter(~local), "path", "left_semi").select(F.col("path").alias("tar"), "content")
    return near.union(far).mapInArrow(_tar_rows, "tar string, " + FILES)
