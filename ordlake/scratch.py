"""Working folders that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own: list[str] = []


def folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a local one of our own only where that setting is missing (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not base:
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="ordlake-"))
        base = _own[0]
    return f"{base.rstrip('/')}/ordlake-{uuid.uuid4().hex}"


def save(df: DataFrame) -> DataFrame:
    """df written to a new folder and read back; cuts its lineage."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
