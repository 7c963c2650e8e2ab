"""Cutting lineage by files in the shared folder of the session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut by files in the folder of spark.checkpoint.dir; a folder of our own only where the session has none."""
    _folder(df)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df written once as Parquet beside the checkpoints and read again: what reads it has a scan in its plan, not how it was made.

    Smaller than a checkpoint of the same rows. The files go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{_folder(df)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def _folder(df: DataFrame) -> str:
    """The session's folder for checkpoints."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{tempfile.gettempdir()}/cellmill-{uuid.uuid4().hex}")
    return spark.sparkContext.getCheckpointDir()
