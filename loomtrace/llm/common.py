"""Small helpers that several corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


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


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written once as Parquet in the shared folder and read again: its lineage is cut and it outlives any executor."""
    path = f"{shared_folder(df.sparkSession)}/loomtrace/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_arrow(df: DataFrame, most_bytes: int = 4 << 20) -> DataFrame:
    """df; from now on its session hands Python batches of at most most_bytes (rows of whole documents are long, and both
    sides keep the buffers of the largest batch they have seen). A smaller limit of the session stays."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(\d+)\s*([kmg]?)b?", conf.get(name).lower()).groups()
    if int(number) << {"": 0, "k": 10, "m": 20, "g": 30}[unit] > most_bytes:
        conf.set(name, most_bytes)
    return df


def tidy() -> None:
    """Gives freed memory of this Python worker back to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32(doc_id as text) mod folds; null ids fall into the fold of the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def small_batches(batches: Iterator[pa.RecordBatch], text: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about most_bytes of text (column number `text`), one row at least, so that what a task
    holds does not follow the length of texts; what is freed goes back to the system."""
    for batch in batches:
        column = batch.column(text)
        lengths = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
        start, size = 0, 0
        for k, n in enumerate(lengths):
            if size and size + n > most_bytes:
                yield batch.slice(start, k - start)
                start, size = k, 0
            size += n
        if start < len(lengths):
            yield batch.slice(start)
    tidy()
