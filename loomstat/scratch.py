"""Lineage cuts in the shared folder that spark.checkpoint.dir names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _base(spark: SparkSession) -> str:
    """The checkpoint folder. A local session without spark.checkpoint.dir gets a temporary folder; a cluster has to name one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="loomstat-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint of df."""
    _base(df.sparkSession)
    return df.checkpoint()


def dealt(df: DataFrame, partitions: int, *by: str) -> DataFrame:
    """A checkpoint of df dealt by key, which later joins and groups with as many partitions by that key don't move again.

    An adaptive plan wouldn't tell its partitioning, so this one is fixed.
    """
    conf, name = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    was = conf.get(name)
    conf.set(name, "false")
    try:
        return cut(df.repartition(partitions, *by))
    finally:
        conf.set(name, was)


def folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the checkpoint folder, deleted when the driver's JVM ends."""
    path = f"{_base(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path
