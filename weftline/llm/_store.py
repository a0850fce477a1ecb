"""Working tables in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, with its file system; a temporary one only where that is unset and
    Spark runs in one process (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="weftline-"))
        root = spark.sparkContext.getCheckpointDir()
    return qualified(spark, root).rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme under which Spark resolves it, so that tasks and Spark mean the same place."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/weftline/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back: later steps neither recompute it nor depend on its lineage."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def on_driver(df: DataFrame):
    """A result of bounded size as a pandas table, by way of Arrow: rows as Python objects take ten times as much."""
    return df.toArrow().to_pandas()


def filesystem(path: str):
    """(pyarrow filesystem, path inside it) for a URI or a plain path; used inside tasks."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
