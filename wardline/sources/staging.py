"""Written intermediate tables: they end lineage and outlive an executor."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a row group in written intermediate tables.
ROW_GROUP = 32 << 20


def scratch_dir(spark: SparkSession) -> str:
    """This application's part of the cluster's shared folder; a folder of the machine only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = os.path.join(tempfile.gettempdir(), "wardline-checkpoints")
    return f"{root.rstrip('/')}/wardline/{spark.sparkContext.applicationId}"


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder and what is in it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def clean_scratch(spark: SparkSession) -> None:
    """Delete what this application has staged. To be called once no DataFrame that reads it is used any more."""
    delete(spark, scratch_dir(spark))


_scopes: list[str] = []


@contextmanager
def scope(spark: SparkSession, name: str) -> Iterator[None]:
    """What is staged inside lies in one folder, which is deleted at the end: for a step whose result has been written
    elsewhere by then."""
    _scopes.append(f"{name}-{uuid.uuid4().hex}")
    path = "/".join([scratch_dir(spark), *_scopes])
    try:
        yield
    finally:
        _scopes.pop()
        delete(spark, path)


def new_path(spark: SparkSession, name: str) -> str:
    """A folder of its own, in no scope."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` and read it back. Writers hold a row group each in memory, so these are smaller than usual."""
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and each later use reads it."""
    return write(df, "/".join([scratch_dir(df.sparkSession), *_scopes, f"{name}-{uuid.uuid4().hex}"]))
