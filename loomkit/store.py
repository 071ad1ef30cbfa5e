"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a temporary folder serves if the driver does all the work (tests).

    On a cluster, where executors would write to disks of their own, it must be set.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.loomkit.scratch", None)
    if not folder:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        folder = tempfile.mkdtemp(prefix="spark-loomkit-", dir="/tmp")
        spark.conf.set("spark.loomkit.scratch", folder)
    return folder


def new_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/loomkit-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: later jobs neither recompute it nor depend on any executor."""
    spark, path = df.sparkSession, new_path(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few(df: DataFrame) -> DataFrame:
    """``df``, a small table after a shuffle, in no more partitions than four for each core: tasks and files that hold next to nothing cost more than they do."""
    return df.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism)
