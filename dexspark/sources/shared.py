"""The folder that the driver and all executors share, and what is written there between steps."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir. Where that is not set, a temporary folder, but only if driver and executors are one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master or 'the cluster'} share")
        folder = f"file://{tempfile.mkdtemp(prefix='dexspark-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Lets Spark delete the shuffle files of what is written meanwhile as soon as it is written; else they stay until the driver collects garbage."""
    before = spark.conf.get(TIDY, "false")
    spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(TIDY, before)


def stored(rows: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder and read back: what several branches read is made once, and its shuffles go."""
    spark = rows.sparkSession
    path = shared_path(spark, name)
    with tidy(spark):
        rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
