"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder's name below ``spark.checkpoint.dir``; where that is unset, as in tests, a temporary folder is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="tocsin-shared-")
        spark.sparkContext.setCheckpointDir(base)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex[:12]}"


_SCRATCH: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are stored within are deleted at the end: for what is done again and again, as in a stream."""
    _SCRATCH.append(paths := [])
    try:
        yield
    finally:
        _SCRATCH.remove(paths)
        for path in paths:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Writes a table and reads it back, so that it is computed once however many branches use it, and lost executors cost nothing."""
    path = shared_folder(df.sparkSession, tag)
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
