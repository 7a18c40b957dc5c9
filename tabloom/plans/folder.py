"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder where all of Spark is in this process."""
    if not spark.sparkContext.getCheckpointDir():
        name = spark.conf.get("spark.checkpoint.dir", None)
        if not name and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(name or "file://" + tempfile.mkdtemp(prefix="tabloom-"))
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{folder(spark)}/tabloom-{name}-{uuid.uuid4().hex}"


def fixed(df: DataFrame) -> DataFrame:
    """The rows as they are dealt now, kept in the shared folder.

    What is read twice and must be the same both times needs it: a range
    partitioning samples anew on every run.
    """
    folder(df.sparkSession)
    return df.checkpoint(eager=True)
