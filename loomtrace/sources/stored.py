"""Frames that are written once and read again: their lineage is cut, and they outlive any executor."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir of the session. Only where it is unset and all tasks run on
    this machine, a temporary one; on a cluster it must be set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loomtrace-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


#: Rows of a shuffle that one task takes where their number is known before it.
ROWS_PER_TASK = 500_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df by keys, in as many parts as so many rows need: a task's memory then does not grow with the input, as it does where
    the session's number of shuffle partitions stays. Frames dealt by equal keys for one number of rows meet without more."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // ROWS_PER_TASK)), *keys)


def stored(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """df written and read again; rows that hold hashes take half of the disk with the codec `zstd`."""
    path = f"{shared_folder(df.sparkSession)}/loomtrace/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
