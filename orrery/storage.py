"""Intermediate tables in the folder that driver and executors share.

A table written here cuts lineage and survives the loss of executors, as its
files are in shared storage and a lost task of a later stage just reads again.
"""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where no folder is named and driver and executors are one machine, as in tests.
LOCAL_DEFAULT = "/tmp/checkpoints"
_roots: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, a local one, which only a local master can share."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (named or LOCAL_DEFAULT).rstrip("/")


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` as Parquet under the shared folder and returns a reader of it.

    The folder of this application is removed when the driver exits; a table
    that is known to be read out can go earlier with :func:`discard`.
    """
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/orrery-{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots.add(root)
        atexit.register(_remove, spark, root)
    path = f"{root}/{tag}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by :func:`stash` that no later query reads."""
    for t in tables:
        if path := getattr(t, "_stash_path", None):
            _remove(t.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone; there is nothing left to ask
        return
