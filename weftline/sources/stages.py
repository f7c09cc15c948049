"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors see. Only a local session without one gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="weftline-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that is removed when the process ends."""
    path = f"{shared_dir(spark).rstrip('/')}/weftline-{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def create(path: str):
    """A new file of the shared folder, written by a worker through Arrow's file systems."""
    from urllib.parse import urlparse

    import pyarrow.fs as fs

    parts = urlparse(path)
    where, at = (fs.LocalFileSystem(), parts.path) if parts.scheme in ("", "file") else fs.FileSystem.from_uri(path)
    where.create_dir(at.rpartition("/")[0], recursive=True)
    return where.open_output_stream(at, compression=None)


def cut(df: DataFrame, name: str = "step", apart: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: what follows does not depend on executors staying alive.

    apart: a column whose values are written to folders of their own. The table is removed when the process ends.
    """
    spark = df.sparkSession
    path = folder(spark, name)
    (df.write.partitionBy(apart) if apart else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """A folder of the shared folder goes; nothing that is still read may stand there."""
    try:
        jvm = spark.sparkContext._jvm
        there = jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)
    except Exception:  # noqa: BLE001  the session has ended: the folder is the cluster's to clear
        pass
