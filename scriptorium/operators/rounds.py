"""Cut points of work that goes in rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, one of our own, in local mode alone: a cluster's machines don't share it."""
    sc = spark.sparkContext
    known = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not known:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        known = tempfile.mkdtemp(prefix="scriptorium-rounds-")
        sc.setCheckpointDir(known)
    return known


def cut(df: DataFrame) -> DataFrame:
    """`df` written as Parquet in the shared folder and read again: computed once, and not again if an executor is lost."""
    path = f"{shared_folder(df.sparkSession)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
