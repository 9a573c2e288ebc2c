"""Sink: entries of an archive written below a folder that every executor sees."""

from __future__ import annotations

import contextlib
import functools
import io
import os
import re
import tarfile
import uuid

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.functions import scalar


def link_stays_inside(path: Column, target: Column) -> Column:
    """False for a link whose target is absolute or, resolved from the link's own folder, leaves the root."""
    parent = F.regexp_replace(scalar.normal_path(path), r"[^/]*$", "")
    return ~target.rlike(r"^[/\\]") & scalar.resolve_path(F.concat(parent, target)).isNotNull()


def local_path(folder: str) -> str:
    """A folder's path without the scheme of the file system; other schemes have no paths that os can write to."""
    if re.match(r"[a-z][a-z0-9+.-]+:", folder) and not folder.startswith("file:"):
        raise ValueError(f"not a folder of the file system: {folder}")
    return re.sub(r"^file:(//)?", "", folder)


def _place(folder: str, kind: str):
    """A task may run twice: files get their name by a rename, and what is there already is replaced."""

    def write(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                full = os.path.join(folder, row.path)
                os.makedirs(full if kind == "dir" else os.path.dirname(full), exist_ok=True)
                if kind != "dir":
                    part = f"{full}.{uuid.uuid4().hex}"
                    if kind == "symlink":
                        os.symlink(row.target, part)
                    elif kind == "hardlink":
                        if not os.path.exists(os.path.join(folder, row.target)):
                            continue
                        os.link(os.path.join(folder, row.target), part)
                    else:
                        with open(part, "wb") as f:
                            f.write(row.content or b"")
                        _restore(part, row.mode, row.mtime_ns)
                    os.replace(part, full)
            yield pd.DataFrame({"kind": [kind] * len(pdf)})

    return write


def _restore(path: str, mode: int, mtime_ns: int) -> None:
    with contextlib.suppress(PermissionError):
        os.chmod(path, int(mode))
        if mtime_ns > 0:
            os.utime(path, ns=(int(mtime_ns), int(mtime_ns)))


def _settle(folder: str):
    """Modes and times of folders, once nothing more is written into them."""

    def write(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                _restore(os.path.join(folder, row.path), row.mode, row.mtime_ns)
            yield pd.DataFrame({"kind": ["dir"] * len(pdf)})

    return write


def write_entries(entries: DataFrame, contents: DataFrame, folder: str) -> DataFrame:
    """kind, n of the entries(path, kind, target, mode, mtime_ns), once written; contents(path, mode, mtime_ns, content): a file for each path.

    Unsafe paths and links raise before any write. Of files that share a path, one stays.
    """
    unsafe = ~scalar.safe_path(F.col("path")) | ((F.col("kind") == "symlink") & ~link_stays_inside(F.col("path"), F.col("target"))) | ((F.col("kind") == "hardlink") & ~scalar.safe_path(F.col("target")))
    folder = local_path(folder)
    bad = entries.filter(unsafe).select("path").first()
    if bad:
        raise ValueError(f"entry leaves the folder: {bad[0]}")
    counts = {}
    for kind in ("dir", "file", "hardlink", "symlink"):  # links last: nothing is written through them; a hard link needs its target
        rows = entries.filter(F.col("kind") == kind).select("path", "target", "mode", "mtime_ns")
        if kind == "file":
            contents.mapInPandas(_place(folder, kind), "kind string").count()
        counts[kind] = rows.count() if kind == "file" else rows.mapInPandas(_place(folder, kind), "kind string").count()
    entries.filter("kind = 'dir'").select("path", "mode", "mtime_ns").mapInPandas(_settle(folder), "kind string").count()
    return entries.sparkSession.createDataFrame([(k, n) for k, n in counts.items() if n], "kind string, n long")


def _tar(folder: str, batches):
    """One tar of a task's files; it gets its name once it is whole."""
    name = os.path.join(folder, f"{uuid.uuid4().hex}.tar")
    n = 0
    with tarfile.open(f"{name}.part", "w") as tar:
        for b in batches:
            for row in b.to_pylist():
                info = tarfile.TarInfo(row["path"])
                info.size, info.mtime = len(row["content"]), row["mtime_ns"] / 1e9
                tar.addfile(info, io.BytesIO(row["content"]))
                n += 1
    if n:
        os.replace(f"{name}.part", name)
    else:
        os.remove(f"{name}.part")
    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["tar", "n"])


def write_tars(files: DataFrame, folder: str) -> int:
    """Write files(path, content, mtime_ns) as tar files, one for each task, into a folder that every executor sees: number of files.

    A try that fails leaves a tar without its name; one that runs twice may leave a tar twice, so the folder's tars
    that no finished task named go at the end.
    """
    folder = local_path(folder)
    os.makedirs(folder, exist_ok=True)
    rows = files.select("path", F.col("content").cast("binary").alias("content"), "mtime_ns").mapInArrow(functools.partial(_tar, folder), "tar string, n long").collect()  # one row for each task
    named = {os.path.basename(r["tar"]) for r in rows if r["n"]}
    for name in os.listdir(folder):
        if name not in named:
            os.remove(os.path.join(folder, name))
    return sum(r["n"] for r in rows)
