"""Tables written to the folder the cluster shares, to cut the lineage of a plan."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which driver and executors share.

    Where it is unset, a session on one machine (master ``local`` or ``local[n]``) uses its
    own local folder, since driver and executors are one process there. Any other master
    raises: executors would write to disks that later reads do not see.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return spark.conf.get("spark.local.dir", "/tmp").split(",")[0].rstrip("/")


def session_dir(spark: SparkSession) -> str:
    """The one folder below which all stored tables of this application lie."""
    return f"{shared_root(spark)}/tidemark-{spark.sparkContext.applicationId}"


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder for one stored table."""
    return f"{session_dir(spark)}/{uuid.uuid4().hex}"


_NOTED: list[list[str]] = []


@contextmanager
def noted() -> Iterator[list[str]]:
    """The folders of the tables that are stored inside, for ``drop``."""
    paths: list[str] = []
    _NOTED.append(paths)
    try:
        yield paths
    finally:
        _NOTED.remove(paths)


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` and read it back.

    The table survives lost executors. Plans that use one input in several branches (block
    scans read it for the block totals and for the rows) call this first: without it every
    nested scan would double the work below it.
    """
    path = scratch_dir(df.sparkSession)
    for paths in _NOTED:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, paths: list[str], but: DataFrame | None = None) -> None:
    """Delete stored tables that nothing reads any more; those that ``but`` reads stay."""
    read = but.inputFiles() if but is not None and paths else []
    for path in paths:
        name = path.rsplit("/", 1)[-1]
        if not any(name in f for f in read):
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def clear(spark: SparkSession) -> None:
    """Delete all stored tables of this application; call it when no result is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(session_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
