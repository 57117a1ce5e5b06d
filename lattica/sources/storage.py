"""Tables of a session's own in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession

_fallback: str | None = None
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset (local runs) a temporary one."""
    global _fallback
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _fallback is None:
        _fallback = tempfile.mkdtemp(prefix="lattica-")
        _on_exit(spark, f"file://{_fallback}")
    return f"file://{_fallback}"


def _store(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _on_exit(spark: SparkSession, path: str) -> None:
    """The store deletes the path when the driver's JVM ends, whether or not the session was stopped before."""
    where, store = _store(spark, path)
    store.mkdirs(where)
    store.deleteOnExit(where)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in any store that the session reaches."""
    where, store = _store(spark, path)
    store.delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where, store = _store(spark, path)
    return store.exists(where)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder."""
    where, store = _store(spark, path)
    return [f.getPath().getName() for f in store.listStatus(where)]


def new_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A fresh path in the shared folder, deleted at the end of the scratch() block that it is made in, unless it is kept, else when the driver ends."""
    top = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _on_exit(spark, top)
    if not keep:
        _made.append(top)
    return f"{top}/data"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written to the shared folder and read again: lineage ends there, so a lost executor costs no more than the read, and their size is known from then on."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes what is written to the shared folder inside the block when it ends. Results must have been written or collected by then."""
    mark = len(_made)
    try:
        yield
    finally:
        while len(_made) > mark:
            remove(spark, _made.pop())


def full_address(spark: SparkSession, path: str) -> str:
    """A path with its scheme, as the session's default store gives it."""
    where, store = _store(spark, path)
    return store.makeQualified(where).toString()


def open_store(path: str):
    """For tasks that read or write files of their own: the file system of a full address, and the name of the file there."""
    from pyarrow import fs

    return (fs.LocalFileSystem(), unquote("/" + path[5:].lstrip("/"))) if path.startswith("file:") else fs.FileSystem.from_uri(path)


def fingerprint(spark: SparkSession, path: str) -> str:
    """Newest change and size of what lies at a path, by which a copy tells whether it is still good."""
    where, store = _store(spark, path)
    files = store.listFiles(where, True)
    newest = total = count = 0
    while files.hasNext():
        f = files.next()
        newest, total, count = max(newest, f.getModificationTime()), total + f.getLen(), count + 1
    return f"{newest}:{total}:{count}"
