"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """What the cluster names in spark.checkpoint.dir; a temporary folder only where that is unset."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="strandlake-"))
    return _own[0]


def delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        files = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.delete(p, True)
        for x in files.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}[._]*")) or []:
            files.delete(x.getPath(), True)
    except Exception:  # the session is gone already: nothing to delete with
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is written there, or beside it with an ending, is deleted when the driver exits."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(delete, spark, path)
    return path


def move(spark: SparkSession, old: str, new: str) -> None:
    """Renames a file or folder, also in a remote store."""
    jvm = spark.sparkContext._jvm
    a, b = jvm.org.apache.hadoop.fs.Path(old), jvm.org.apache.hadoop.fs.Path(new)
    if not a.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(a, b):
        raise OSError(f"could not move {old} to {new}")
