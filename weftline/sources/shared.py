"""Working tables in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``; in a temporary one only where that is unset and Spark runs
    in one process (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="weftline-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/weftline/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame | list[DataFrame], name: str) -> DataFrame:
    """``df`` from a table of its own: its plan ends there, and lost executors take nothing with them.

    Of a list, whose frames have the same columns, each is written by a plan of its own, so that the driver never holds
    the plan of all of them.
    """
    parts = df if isinstance(df, list) else [df]
    path = shared_folder(parts[0].sparkSession, name)
    for part in parts:
        part.write.mode("append").parquet(path)
    return parts[0].sparkSession.read.schema(parts[0].schema).parquet(path)


def version(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """Time of change, files and bytes of a table: another value for a table that was written anew."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return 0, 0, 0
    size = fs.getContentSummary(at)
    return fs.getFileStatus(at).getModificationTime(), size.getFileCount(), size.getLength()
