"""Cutting a plan's lineage where all executors can read it again."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, a temporary one is set in local mode, as in tests; elsewhere it is an error, for executors share no local folder."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the executors share")
        folder = tempfile.mkdtemp(prefix="tracelet-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """df by way of checkpoint() in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
