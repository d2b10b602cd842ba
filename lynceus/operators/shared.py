"""Tables in the folder that all executors share, where a plan would be computed again for each of its uses."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where all run on this machine."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not spark.sparkContext.master.startswith("local["):  # a local-cluster has executors of its own
        raise ValueError("spark.checkpoint.dir names no folder that the executors share")
    spark.conf.set("spark.checkpoint.dir", folder := tempfile.mkdtemp(prefix="spark-"))
    return folder


def settled(df: DataFrame, name: str) -> DataFrame:
    """The frame, written as a table and read again: what uses it twice computes it once."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def once(value: Column) -> Column:
    """The value, where it stands: as it names the partition, a filter on it is not moved below it with copies of how it is made."""
    return F.when(F.spark_partition_id() >= 0, value)
