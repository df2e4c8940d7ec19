"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; only a local session without that setting (a test) gets one of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = f"{(base or 'file://' + os.path.join(tempfile.gettempdir(), 'loam-shared')).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if path.startswith("file:"):
        atexit.register(shutil.rmtree, path.split(":", 1)[1].replace("//", "/", 1), ignore_errors=True)
    return path


def written(df: DataFrame, name: str = "stage") -> DataFrame:
    """``df`` as a table in the shared folder: evaluated once, and not lost with an executor."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
