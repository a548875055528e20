"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it is unset, one of this machine's on a local master; on a cluster that is an error."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="gleanery-"))
    return context.getCheckpointDir()


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has written to."""
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"


#: Fixed value: Spark's setting that removes the shuffle files of a query once it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(frame: DataFrame, name: str = "table") -> DataFrame:
    """The frame as a Parquet table in the shared folder: computed once, read whole after a lost executor. Its shuffle files go when it is written."""
    spark = frame.sparkSession
    path = fresh(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        frame.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(frame.schema).parquet(path)
