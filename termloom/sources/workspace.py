"""The folder that the driver and all executors share, and tables in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a local session without that setting gets a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="termloom-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/termloom/{name}-{uuid.uuid4().hex}"


def _hadoop(spark: SparkSession, path: str) -> tuple:
    """A path and the store that it is in, whichever that is."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    hadoop, store = _hadoop(spark, path)
    store.delete(hadoop, True)


def children(spark: SparkSession, path: str, name: str | None = None) -> list[str]:
    """Names of what is in a folder, or of ``name`` alone if it is there; none if there is no such folder."""
    hadoop, store = _hadoop(spark, path)
    if not store.exists(hadoop):
        return []
    names = [status.getPath().getName() for status in store.listStatus(hadoop)]
    return [n for n in names if name is None or n == name]


def stamp(spark: SparkSession, path: str) -> tuple:
    """What tells whether a file, or the files of a folder, have been written anew."""
    hadoop, store = _hadoop(spark, path)
    return tuple(sorted((s.getPath().getName(), s.getModificationTime(), s.getLen()) for s in store.listStatus(hadoop)))
