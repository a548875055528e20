"""Tables: reading, writing by key, and lineage cuts in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it is unset, one of this machine's on a local master; on a cluster that is an error."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="gleanery-"))
    return context.getCheckpointDir()


def written(frame: DataFrame) -> DataFrame:
    path = f"{shared(frame.sparkSession)}/rows-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def overwrite_partitions(rows: DataFrame, path: str, *by: str) -> None:
    """Replace the partitions that rows have, and no other; no rows replace nothing."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
