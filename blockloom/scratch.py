"""Tables for the time of a job in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

#: Folders of the tables that store() wrote; those in _FOLDERS are not deleted yet.
_STORED: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_FOLDERS: dict[str, None] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the session names. Only a session of one machine gets a temporary folder where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="blockloom-")
        spark.sparkContext.setCheckpointDir(root)
    return root


#: Bytes of rows that go to a Python worker at once; the worker and the JVM hold a batch each, the JVM outside its heap.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


#: Bytes of a row group of a stored table.
ROW_GROUP = 8 << 20


def small_batches(spark: SparkSession, most: str = "4m") -> None:
    """A session that leaves BATCH at Spark's own value (64 MB) takes a smaller one from here on; one that has chosen keeps its choice."""
    if spark.conf.get(BATCH, "67108864b") == "67108864b":
        spark.conf.set(BATCH, most)


def new_folder(spark: SparkSession) -> str:
    """A folder of its own that sweep() deletes."""
    folder = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    _FOLDERS[folder] = None
    return folder


def store(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and retries read the same rows."""
    spark = df.sparkSession
    folder = new_folder(spark)
    # small row groups: a task holds one while it writes, and reads a column of one at once
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(f"{folder}/{name}")
    table = spark.read.schema(df.schema).parquet(f"{folder}/{name}")
    _STORED[table] = folder
    return table


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _FOLDERS.pop(folder, None)


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that no later plan reads: all that came from them must have been stored already."""
    for df in tables:
        delete(df.sparkSession, _STORED.pop(df))


def folder_of(table: DataFrame) -> str:
    return _STORED[table]


def stored() -> set[str]:
    """Folders that nobody has deleted."""
    return set(_FOLDERS)


def sweep(spark: SparkSession, keep: Iterable[str] = ()) -> None:
    """Delete all folders but those to keep: for the end of a job whose result is stored or read."""
    for folder in stored().difference(keep):
        delete(spark, folder)
