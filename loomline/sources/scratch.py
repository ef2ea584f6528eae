"""A folder that all executors share, for what a job writes and reads again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one is made only in local mode, where none is set."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        where = sc.getConf().get("spark.checkpoint.dir")
        if not where and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="loomline-"))
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession) -> str:
    """The name of a folder in the shared one that isn't there yet."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df written in the shared folder, so that nothing before it runs again, whatever is lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def file_system(spark: SparkSession, path: str):
    """The file system of a path, and the path as it takes it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = file_system(spark, path)
    return fs.exists(where)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    fs, where = file_system(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(where)) if fs.exists(where) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, where = file_system(spark, path)
    fs.delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A new folder, deleted at the end: what is read from it must be used or cut before."""
    where = new_folder(spark)
    try:
        yield where
    finally:
        delete(spark, where)
