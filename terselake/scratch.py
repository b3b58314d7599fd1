"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session may go without one, and gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="terselake-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return f"file://{_local[0]}"


_open: list[list[str]] = []


@contextmanager
def written() -> Iterator[list[str]]:
    """The folders of the tables that are written inside, for :func:`drop`."""
    _open.append([])
    try:
        yield _open[-1]
    finally:
        _open.pop()


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Removes scratch tables; results that still read them must have been written before."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    paths.clear()


def path(spark: SparkSession, label: str) -> str:
    """A new folder in there."""
    found = f"{root(spark)}/terselake-{label}-{uuid.uuid4().hex}"
    for paths in _open:
        paths.append(found)
    return found


def materialise(df: DataFrame, label: str, codec: str | None = None, hashes: bool = False) -> DataFrame:
    """Writes ``df`` there and reads it back: later plans start from the table, and its stages aren't run twice.

    A table of ``hashes`` is written without dictionaries, which few of its values would share.
    """
    at = path(df.sparkSession, label)
    options = {"parquet.enable.dictionary": "false"} if hashes else {}
    df.write.options(**options).parquet(at, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(at)
