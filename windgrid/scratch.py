"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir. Where that is unset a local master gets a temporary one; a cluster must set it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="windgrid-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_KEPT: set[str] = set()


def path(spark: SparkSession) -> str:
    """A new path for a table, which goes when the application ends."""
    folder = f"{shared_dir(spark)}/windgrid/{spark.sparkContext.applicationId}"
    if folder not in _KEPT:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
        _KEPT.add(folder)
    return f"{folder}/{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, survives lost executors."""
    to = path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(to)
    return df.sparkSession.read.schema(df.schema).parquet(to)
